"""Fingerprints in fewer dimensions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Components:
    """Mean and principal directions of a population: as many numbers as dimensions, times components."""

    mean: list[float]
    directions: list[list[float]]
    explained: list[float]

    def of(self, vector: Column) -> Column:
        """The centred vector along each direction."""
        centred = F.zip_with(vector, F.lit(self.mean), lambda x, m: x - m)
        along = [F.aggregate(F.zip_with(centred, F.lit(d), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for d in self.directions]
        return F.array(*along)


def fit(vectors: DataFrame, components: int, column: str = "vector") -> Components:
    """Principal directions, each with its largest entry positive; rows without a vector are left out.

    Spark's fit sums outer products per partition, so only dimension x dimension numbers move.
    """
    known = vectors.where(F.col(column).isNotNull())
    means = known.select(F.posexplode(column).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).collect()
    if not 1 <= components <= len(means):
        raise ValueError(f"components is 1 to the {len(means)} dimensions")
    model = PCA(k=components, inputCol="v", outputCol="p").fit(known.select(array_to_vector(column).alias("v")))
    found = model.pc.toArray().T
    found = found * np.sign(found[np.arange(components), np.abs(found).argmax(1)])[:, None]
    return Components([r.m for r in sorted(means, key=lambda r: r.d)], found.tolist(), model.explainedVariance.toArray().tolist())


def reduced(vectors: DataFrame, fitted: Components, column: str = "vector") -> DataFrame:
    """The table with its vectors along the fitted directions; null stays null."""
    return vectors.withColumn(column, F.when(F.col(column).isNotNull(), fitted.of(F.col(column))))
