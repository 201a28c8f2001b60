"""Covariance and principal components of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def center_vectors(vectors: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    """Vectors less their mean."""
    v = F.col(vector).cast("array<double>")
    mean = vectors.agg(F.array(*[F.avg(F.get(v, F.lit(i))) for i in range(size)]).alias("mean_vector"))
    return vectors.crossJoin(F.broadcast(mean)).withColumn(vector, F.zip_with(v, "mean_vector", lambda x, m: x - m)).drop("mean_vector")  # one row


def covariance(vectors: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    """i, j, covariance (by n - 1, 1 at least): each batch adds up its own products of centred vectors."""
    rows = center_vectors(vectors, size, vector).select(F.col(vector).alias("v"))

    def products(batches):
        i, j = np.divmod(np.arange(size * size), size)
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, size)
                yield pa.RecordBatch.from_arrays([pa.array(i + 1), pa.array(j + 1), pa.array((x.T @ x).ravel()), pa.array(np.full(size * size, b.num_rows))], ["i", "j", "s", "n"])

    sums = rows.mapInArrow(products, "i long, j long, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("i", "j", (F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))).alias("covariance"))


def pca_projection(vectors: DataFrame, size: int, k: int = 2, key: str = "node", vector: str = "vector") -> DataFrame:
    """key, pca_x, pca_y, ...: centred vectors on the first components, each with its largest loading positive."""
    rows = center_vectors(vectors, size, vector).select(key, array_to_vector(F.col(vector)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    loads = model.pc.toArray()
    sign = np.sign(loads[np.abs(loads).argmax(0), np.arange(k)])
    names = ["pca_x", "pca_y", "pca_z"][:k] if k <= 3 else [f"pca_{i + 1}" for i in range(k)]
    out = model.transform(rows).select(key, vector_to_array("p").alias("p"))
    return out.select(key, *[(F.get("p", F.lit(i)) * float(sign[i])).alias(n) for i, n in enumerate(names)])
