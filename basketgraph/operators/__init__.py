"""Jobs on baskets, graphs and vectors."""
