"""The pattern archive: bars, patterns and series' states under one folder, one numbered ingest at a time.

    <path>/<kind>/ingest=N/timeframe=T/slot=S/...     bars, patterns
    <path>/<kind>/ingest=N/...                        tails, spans, cuts
    <path>/commits/ingest=N/...                       one row, written last

A slot is a hash of the ticker, so a filter by timeframe or ticker is a choice of
folders; within a folder rows are in order of ticker and time, so the smallest
and largest values that Parquet keeps leave out the rest.  What an ingest writes
counts once its commit is there: a failed one is written over when it is tried
again, and one that is done is not done twice.

Bars that come late move all windows after them.  An ingest then writes those
windows anew and a cut that says from which window on the older rows of the
series are dead; readers leave them out.  `spans` has the first and last window
that an ingest wrote of each series, so patterns are counted without a look at
them.  `compact` writes what is alive as one ingest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = ["ticker", "timeframe"]
BAR = "ticker string, ts timestamp, open double, high double, low double, close double, volume double"
PLACED = "ingest long, timeframe string, slot int"
PATTERN = (
    "pattern_id long, ticker string, k long, window_size int, start_time timestamp, end_time timestamp, first_open double, last_close double, max_high double, min_low double, "
    "forward_return double, max_drawdown double, max_runup double, time_to_resolution int, outcome_label string, vector array<double>, "
    "volatility_profile string, momentum_profile string, volume_profile string"
)
KINDS = {
    "bars": f"{BAR}, {PLACED}",
    "patterns": f"{PATTERN}, {PLACED}",
    # next_k is the first window that is not cut yet; bars are those from its start on.
    "tails": "ticker string, timeframe string, next_k long, last_ts timestamp, bars array<struct<ts:timestamp,open:double,high:double,low:double,close:double,volume:double>>, ingest long",
    "spans": "ticker string, timeframe string, first_k long, last_k long, first_time timestamp, last_time timestamp, ingest long",
    "cuts": "ticker string, timeframe string, from_k long, ingest long",
    "commits": "base long, slots int, newest long, n_patterns long, n_cuts long, ingest long",
}
SORTED = {"bars": "ts", "patterns": "start_time"}


class Archive:
    """One folder of patterns.  The number of slots is that of the first commit; `newest` is its last bar's time in microseconds."""

    def __init__(self, spark: SparkSession, path: str, slots: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        done = self._read("commits").orderBy(F.desc("ingest")).first()
        self.slots = done.slots if done else slots
        self.last = done.ingest if done else None
        self.base = done.base if done else 0
        self.newest = done.newest if done else None

    def _read(self, kind: str) -> DataFrame:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        there = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        return self.spark.read.schema(KINDS[kind]).parquet(f"{self.path}/{kind}") if there else self.spark.createDataFrame([], KINDS[kind])

    def read(self, kind: str) -> DataFrame:
        """All rows of the ingests that count."""
        return self._read(kind).where(F.col("ingest").between(self.base, -1 if self.last is None else self.last))

    def slot(self, ticker: Column) -> Column:
        return F.pmod(F.xxhash64(ticker), F.lit(self.slots)).cast("int")

    def within(self, rows: DataFrame, timeframe: str | None = None, ticker: str | None = None) -> DataFrame:
        """Rows of a timeframe or ticker, by folder first."""
        if timeframe:
            rows = rows.where(F.col("timeframe") == timeframe)
        if ticker:
            rows = rows.where(F.col("ticker") == ticker)
            rows = rows.where(F.col("slot") == self.slot(F.lit(ticker))) if "slot" in rows.columns else rows
        return rows

    def bars(self, timeframe: str | None = None, ticker: str | None = None, slots: list[int] | None = None) -> DataFrame:
        """Every bar once, as the last ingest that had it gave it; those of some slots alone if given."""
        rows = self.within(self.read("bars"), timeframe, ticker)
        rows = rows if slots is None else rows.where(F.col("slot").isin(slots))
        values = F.struct("open", "high", "low", "close", "volume")
        last = rows.groupBy("ticker", "timeframe", "ts").agg(F.max_by(values, "ingest").alias("b"))
        return last.select("ticker", "timeframe", "ts", "b.*")

    def cuts(self) -> DataFrame | None:
        """(ticker, timeframe, from_k, cut_at), or None if no series was ever cut."""
        if not self.read("commits").where("n_cuts > 0").limit(1).count():
            return None
        return self.read("cuts").select(*SERIES, "from_k", F.col("ingest").alias("cut_at"))

    def patterns(self, timeframe: str | None = None, ticker: str | None = None, limit: int | None = None) -> DataFrame:
        """Patterns that are alive; with a limit, those with the least ids."""
        rows, cuts = self.within(self.read("patterns"), timeframe, ticker), self.cuts()
        if cuts is not None:
            c = self.within(cuts, timeframe, ticker).alias("c")
            dead = (F.col("p.ticker") == F.col("c.ticker")) & (F.col("p.timeframe") == F.col("c.timeframe")) & (F.col("p.k") >= F.col("c.from_k")) & (F.col("p.ingest") < F.col("c.cut_at"))
            rows = rows.alias("p").join(c, dead, "left_anti")
        rows = rows.drop("ingest", "slot")
        return rows.orderBy("pattern_id").limit(limit) if limit else rows

    def counts(self) -> DataFrame:
        """(ticker, timeframe, n, first_time) of patterns that are alive, from the spans alone."""
        spans, cuts = self.read("spans"), self.cuts()
        if cuts is not None:
            s, c = spans.alias("s"), cuts.alias("c")
            later = (F.col("s.ticker") == F.col("c.ticker")) & (F.col("s.timeframe") == F.col("c.timeframe")) & (F.col("s.ingest") < F.col("c.cut_at"))
            least = s.join(c, later, "left").groupBy("s.ticker", "s.timeframe", "s.ingest", "s.first_k", "s.last_k", "s.first_time").agg(F.min("c.from_k").alias("from_k"))
            spans = least.withColumn("last_k", F.least("last_k", F.coalesce(F.col("from_k") - 1, F.col("last_k"))))
        n = F.greatest(F.lit(0), F.col("last_k") - F.col("first_k") + 1)
        found = spans.withColumn("n", n).where("n > 0")
        return found.groupBy(*SERIES).agg(F.sum("n").alias("n"), F.min("first_time").alias("first_time"))

    def tails(self) -> DataFrame:
        """The state of every series: what its last ingest left of it."""
        state = F.struct("next_k", "last_ts", "bars")
        return self.read("tails").groupBy(*SERIES).agg(F.max_by(state, "ingest").alias("t")).select(*SERIES, "t.*")

    def put(self, kind: str, rows: DataFrame, number: int) -> DataFrame:
        """Write a kind's rows of an ingest, over what a failed try has left; returns them as written."""
        at = f"{self.path}/{kind}/ingest={number}"
        if kind in SORTED:
            rows = rows.withColumn("slot", self.slot(F.col("ticker")))
            names = [f.split()[0] for f in KINDS[kind].split(", ") if not f.startswith("ingest")]
            rows = rows.select(*names).repartition("timeframe", "slot").sortWithinPartitions("timeframe", "slot", "ticker", SORTED[kind])
            rows.write.mode("overwrite").partitionBy("timeframe", "slot").parquet(at)
        else:
            rows.write.mode("overwrite").parquet(at)
        return self._read(kind).where(F.col("ingest") == number)

    def commit(self, number: int, newest: int | None, n_patterns: int, n_cuts: int, base: int | None = None) -> None:
        base = self.base if base is None else base
        row = [(base, self.slots, newest, n_patterns, n_cuts)]
        schema = KINDS["commits"].removesuffix(", ingest long")
        self.spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/ingest={number}")
        self.last, self.base, self.newest = number, base, newest

    def compact(self, number: int) -> None:
        """Write all that is alive as one ingest; older ones are not read any more."""
        if self.last is None or number <= self.last:
            return
        self.put("bars", self.bars(), number)
        kept = self.put("patterns", self.patterns(), number)
        self.put("tails", self.tails(), number)
        self.put("spans", spans_of(kept), number)
        n = self.put_none("cuts", number)
        self.commit(number, self.newest, kept.count(), n, base=number)

    def put_none(self, kind: str, number: int) -> int:
        schema = KINDS[kind].removesuffix(", ingest long")
        self.put(kind, self.spark.createDataFrame([], schema), number)
        return 0


def spans_of(patterns: DataFrame) -> DataFrame:
    """First and last window of each series of one ingest, which cuts them without a gap."""
    return patterns.groupBy(*SERIES).agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time"))
