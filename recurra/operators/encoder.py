"""From windows to the vectors that are compared: warp, fingerprint, normalise, reduce.

An encoder that isn't fitted gives raw fingerprints; one that is normalises with
the statistics of the population it was fitted to, and reduces with its
principal directions if it has some.  Batches and single windows are alike.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, normalize, reduction
from .windows import KEY


@dataclass(frozen=True)
class Encoder:
    """Settings, and what fitting adds: one row of statistics, and principal directions."""

    window: int = 60
    warp: bool = True
    length: int = 100
    warp_drops_time: bool = True
    method: str = "combined"
    fitted: DataFrame | None = None
    components: reduction.Components | None = None

    def raw(self, windows: DataFrame) -> DataFrame:
        """(ticker, timeframe, k, vector) of 49 slots; warped windows have no time, so their cycle slots are 0 unless told otherwise."""
        if not self.warp:
            return features.fingerprint(windows, self.window).select(*KEY, "vector")
        ends = windows.where(F.col("i") < self.window).groupBy(*KEY).agg(F.max("ts").alias("ts"))
        warped = features.time_warp(windows, self.length, self.window)
        if self.warp_drops_time:
            return features.fingerprint(warped.withColumn("ts", F.lit(None).cast("timestamp")), self.length).select(*KEY, "vector")
        return features.fingerprint(warped.join(ends, list(KEY)), self.length).select(*KEY, "vector")

    def fit(self, windows: DataFrame) -> Encoder:
        """This encoder, fitted to a population of windows."""
        return replace(self, fitted=normalize.fit(self.raw(windows)))

    def with_directions(self, windows: DataFrame, components: int) -> Encoder:
        """This encoder with principal directions of what it makes of a population."""
        vectors = replace(self, components=None).encode(windows).select("vector").persist()  # a row a window, read several times
        found = replace(self, components=reduction.fit(vectors, components))
        vectors.unpersist()
        return found

    def encode(self, windows: DataFrame) -> DataFrame:
        """(ticker, timeframe, k, vector) of each window."""
        found = self.raw(windows)
        if self.fitted is not None:
            found = normalize.transform(found, self.fitted, self.method)
        return reduction.reduced(found, self.components) if self.components is not None else found
