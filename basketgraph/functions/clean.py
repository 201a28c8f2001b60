"""Cleaning of free-text item lists: column functions, and versioned rule cascades.

A cascade is a list of steps, tried in order; the first that matches an item decides. Dictionaries are looked up by
broadcast joins with the few rows of a step, so expressions stay small enough for generated code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "array<struct<standard:string,category:string,action:string,reason:string>>"

#: Items of the ear, and their keys.
EAR = {
    "(ear) shenmen": "EAR_SHENMEN", "ear shenmen": "EAR_SHENMEN", "shenmen(ear)": "EAR_SHENMEN", "shenmen(tf4)": "EAR_SHENMEN",
    "(ear) zhenjing": "EAR_ZHENJING", "heart": "EAR_HEART", "kidney": "EAR_KIDNEY", "liver": "EAR_LIVER", "spleen": "EAR_SPLEEN",
    "lung": "EAR_LUNG", "occiput": "EAR_OCCIPUT", "subcortex": "EAR_SUBCORTEX", "gallbladder": "EAR_GALLBLADDER",
    "stomach": "EAR_STOMACH", "endocrine": "EAR_ENDOCRINE", "sympathetic": "EAR_SYMPATHETIC", "cortical areas": "EAR_CORTICAL_AREAS",
    "small intestine": "EAR_SMALL_INTESTINE", "large intestine": "EAR_LARGE_INTESTINE", "sanjiao": "EAR_SANJIAO",
}
EAR_2016 = EAR | {"shenmen": "EAR_SHENMEN", "brain": "EAR_BRAIN", "hypothysis": "EAR_HYPOPHYSIS"}
EAR_2020 = EAR_2016 | {"sympathetic autonomic": "EAR_SYMPATHETIC"}
#: Items of the body that have names.
NAMED = {"sishencong": "SISHENCONG", "anmian": "ANMIAN", "yintang": "YINTANG", "taiyang": "TAIYANG"}
#: What can't be identified.
REJECTED = ("hands(unspecified)", "multiple acupoints(경혈 명시x)", "경혈 명시x", "1 inch above medial malleolus", "bailing", "족태양방광경(bl)", "독맥(gv)의 모든 경혈: bl1")
REJECTED_2016 = ("bl20 or bl15", "pc7 or ki1")
#: Notes that a code may carry, the form of a code, and other names of two prefixes.
CODE_NOTES = r"(?i)\((bilateral|bilaterally|unilateral|unilaterally|논문에는 h7이라고 되어있음)\)"
CODE = r"^([A-Z]{1,3}(?:-[A-Z]{2})?)(\d+)$"
PREFIX_NAMES = {"DU": "GV", "RN": "CV"}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trim_text(text: Column, one_line: bool = False) -> Column:
    """Without outer white space; with one_line newlines become spaces first. Null stays null."""
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")) if one_line else text)


def coerce_int(text: Column) -> Column:
    """A number cut to its whole part; null where the text is no number."""
    return text.try_cast("double").try_cast("bigint")


def split_items(text: Column) -> Column:
    parts = F.transform(F.split(F.translate(text, "\n;", " ,"), ","), strip)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def normalize_key(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def canonical_code(text: Column) -> Column:
    """Upper-case code with its standard prefix, or null."""
    bare = F.upper(strip(F.regexp_replace(strip(text), CODE_NOTES, "")))
    prefix = F.regexp_extract(bare, CODE, 1)
    named = prefix
    for old, new in PREFIX_NAMES.items():
        named = F.when(prefix == old, new).otherwise(named)
    return F.when(bare.rlike(CODE), F.concat(named, F.regexp_extract(bare, CODE, 2)))


def strip_notes(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\([^)]*\)", ""))


def strip_prefix(key: Column, prefix: str) -> Column:
    """The key without a prefix that it starts with."""
    return F.when(key.startswith(prefix), normalize_key(F.substring(key, F.lit(len(prefix) + 1), F.length(key)))).otherwise(key)


def after_colon(text: Column) -> Column:
    at = F.instr(text, ":")
    return F.when(at > 0, strip(F.substring(text, at + 1, F.length(text))))


def infer_category(item: Column, prefixes: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for prefix, category in reversed(prefixes.items()):
        out = F.when(item.startswith(prefix), category).otherwise(out)
    return out


def parse_list(text: Column) -> Column:
    """A JSON list of strings; anything that is no list raises."""
    out = F.from_json(text, "array<string>")
    return F.when(F.assert_true(out.isNotNull(), F.concat(F.lit("not a list: "), F.coalesce(text, F.lit("null")))).isNull(), out)


def encode_list(items: Column) -> Column:
    return F.to_json(items)


def distinct_items(items: Column) -> Column:
    """Items once each, in order of first occurrence, without empty ones."""
    return F.array_distinct(F.filter(items, lambda x: x != ""))


@dataclass
class Exact:
    """Looks a key column up in a table: key -> (outputs, category, action, reason)."""

    column: str
    entries: dict[str, tuple[list[str], str, str, str]] = field(default_factory=dict)


@dataclass
class Code:
    """Takes the code in a column, where there is one (and the stripped key starts with `only`)."""

    column: str
    reason: str
    only: str = ""


@dataclass
class Prefix:
    start: str
    output: str
    category: str
    reason: str


def _entries(table: dict[str, str], category: str, reason: str) -> dict:
    return {k: ([v], category, "map", reason) for k, v in table.items()}


def _rejected(keys) -> dict:
    return {k: ([""], "unknown", "drop", "not one item") for k in keys}


_V2012 = [
    Exact("key", {"occiput and subcortex": (["EAR_OCCIPUT", "EAR_SUBCORTEX"], "ear", "split", "two items in one")} | _rejected(REJECTED) | _entries(EAR, "ear", "ear item")),
    Code("code", "code"),
]
_V2016 = [
    Exact("key", {"lr3. yintang": (["LR3", "YINTANG"], "body", "split", "two items in one")}),
    Code("moxa_code", "treatment prefix removed", only="moxa:"),
    Exact("stripped", _rejected(REJECTED_2016) | _entries(NAMED, "body", "named item") | _entries(EAR_2016, "ear", "ear item")),
    *_V2012,
]
_V2020 = [
    Prefix("ex-hn1(", "EX-HN1", "body", "note removed"),
    Code("code", "code"),
    Exact("noteless", _entries(EAR_2020, "ear", "ear item")),
    *_V2016,
]
RULESETS = {"2012": _V2012, "2016": _V2016, "2020": _V2020}


def _result(standard: Column, category: Column, action: Column, reason: str) -> Column:
    return F.array(F.struct(standard.alias("standard"), category.alias("category"), action.alias("action"), F.lit(reason).alias("reason"))).cast(RESULT)


def match_keys(items: DataFrame, item: str) -> DataFrame:
    """Adds the columns that steps look at: value, key, stripped, noteless, code, moxa_code."""
    rows = items.withColumn("value", strip(F.col(item)))
    rows = rows.withColumn("key", normalize_key(F.col("value")))
    return rows.withColumns({"stripped": strip_prefix(F.col("key"), "ear points:"), "noteless": normalize_key(strip_notes(F.col("value"))), "code": canonical_code(F.col("value")), "moxa_code": canonical_code(after_colon(F.col("value")))})


def lookup_table(items: DataFrame, step: Exact) -> DataFrame:
    rows = [(k, [(o, category, action, reason) for o in outputs]) for k, (outputs, category, action, reason) in step.entries.items()]
    return items.sparkSession.createDataFrame(rows, f"entry string, found {RESULT}")


def standardize(items: DataFrame, item: str = "item", ruleset: list | str = "2020") -> DataFrame:
    """Adds value (the trimmed item) and results: what the first matching step makes of it; review_needed if none does."""
    steps = RULESETS[ruleset] if isinstance(ruleset, str) else ruleset
    keep = [*items.columns, "value"]
    rows, found = match_keys(items, item), []
    for i, step in enumerate(steps):
        name = f"step_{i}"
        if isinstance(step, Exact):
            table = lookup_table(items, step).select(F.col("entry").alias(f"entry_{i}"), F.col("found").alias(name))
            rows = rows.join(F.broadcast(table), F.col(step.column) == F.col(f"entry_{i}"), "left")
        elif isinstance(step, Prefix):
            rows = rows.withColumn(name, F.when(F.col("key").startswith(step.start), _result(F.lit(step.output), F.lit(step.category), F.lit("map"), step.reason)))
        else:
            code = F.col(step.column)
            fits = code.isNotNull() & F.col("stripped").startswith(step.only)
            rows = rows.withColumn(name, F.when(fits, _result(code, F.lit("body"), F.when(code == F.col("value"), "keep").otherwise("map"), step.reason)))
        found.append(F.col(name))
    review = _result(F.lit(""), F.lit("unknown"), F.lit("review_needed"), "no rule")
    return rows.select(*keep, F.coalesce(*found, review).alias("results"))


def mapping_log(baskets: DataFrame, keys: list[str], items: str = "items", ruleset: list | str = "2020") -> DataFrame:
    """A row for each output item in order: keys, pos, part, original, standard, category, action, reason."""
    raw = baskets.select(*keys, F.posexplode(items).alias("pos", "item"))
    return standardize(raw, "item", ruleset).select(*keys, "pos", F.col("value").alias("original"), F.posexplode("results").alias("part", "r")).select(*keys, "pos", "part", "original", "r.*")


def regroup(baskets: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Baskets with standard_items and dropped_items, each once in order; baskets without items stay."""
    used = F.col("action").isin("keep", "map", "split")
    grouped = log.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(used, F.struct("pos", "part", F.col("standard").alias("item"))))).alias("good"),
        F.array_sort(F.collect_list(F.when(~used, F.struct("pos", "part", F.col("original").alias("item"))))).alias("bad"),
    )
    empty = F.array().cast("array<string>")
    out = baskets.join(grouped, keys, "left")
    return out.withColumns({name: F.coalesce(distinct_items(F.col(c)["item"]), empty) for name, c in (("standard_items", "good"), ("dropped_items", "bad"))}).drop("good", "bad")


def review_gate(log: DataFrame) -> DataFrame:
    """Log rows that need review; see require_reviewed."""
    return log.filter(F.col("action") == "review_needed")


def require_reviewed(log: DataFrame) -> DataFrame:
    n = review_gate(log).count()
    if n:
        raise ValueError(f"{n} items need review")
    return log


def split_empty(baskets: DataFrame, items: str = "standard_items") -> tuple[DataFrame, DataFrame]:
    """(baskets with items, baskets without)"""
    has = F.coalesce(F.size(items) > 0, F.lit(False))
    return baskets.filter(has), baskets.filter(~has)


def action_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "action")
