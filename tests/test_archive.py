"""Archive, incremental ingest, results and the streamed scan: any cut into pieces gives what one piece gives."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.config import EngineConfig
from recurra.operators import windows as W
from recurra.plans import incremental
from recurra.plans import scan as plans
from recurra.sources import results
from recurra.sources.archive import Archive
from recurra.streaming import live

BARS = "ticker string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"
START = dt.datetime(2024, 1, 1)


def walks(spark, lengths, seed=0, timeframe="1h"):
    rng, rows = np.random.default_rng(seed), []
    for ticker, n in lengths.items():
        close = 100 * np.exp(np.cumsum(rng.normal(0.001, 0.02, n)))
        rows += [(ticker, timeframe, START + dt.timedelta(hours=i), float(c), float(c * 1.01), float(c * 0.99), float(c), float(rng.lognormal(3, 0.5))) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, BARS)


def shown(patterns):
    names = ["ticker", "k", "start_time", "pattern_id", "forward_return", "outcome_label", "vector"]
    return sorted((r.ticker, r.k, r.start_time, r.pattern_id, round(r.forward_return, 9), r.outcome_label, tuple(round(x, 9) for x in r.vector)) for r in patterns.select(*names).collect())


def once(bars):
    return shown(plans.patterns_of(bars))


def test_growing_prefixes_equal_one_ingest(spark, tmp_path):
    bars = walks(spark, {"A": 260, "B": 171, "C": 60, "D": 300}).cache()
    archive = Archive(spark, f"{tmp_path}/a", slots=4)
    written = []
    for hours in (70, 91, 175, 301):
        # D begins to trade later, and no prefix adds a bar to all series.
        prefix = bars.where(F.col("ts") < F.lit(START + dt.timedelta(hours=hours))).where((F.col("ticker") != "D") | F.lit(hours > 100))
        new = incremental.arrivals(prefix, Archive(spark, f"{tmp_path}/a")) if hours not in (175,) else prefix.join(archive.bars(), ["ticker", "timeframe", "ts"], "left_anti")
        archive = Archive(spark, f"{tmp_path}/a", slots=4)
        written.append(incremental.ingest(new, archive))
    assert archive.slots == 4 and shown(archive.patterns()) == once(bars)
    assert sum(written) == len(once(bars)) and archive.cuts() is None
    counted = {r.ticker: r.n for r in archive.counts().collect()}
    assert counted == {r.ticker: r["count"] for r in archive.patterns().groupBy("ticker").count().collect()}


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1], [1, 2, 0]])
def test_late_bars_and_gaps(spark, tmp_path, order):
    bars = walks(spark, {"A": 250, "B": 200}, 3).cache()
    hour = F.floor((F.unix_seconds("ts") - 1704067200) / 3600)
    parts = [bars.where(hour % 7 != 3).where(hour < 180), bars.where(hour >= 180), bars.where(hour % 7 == 3).where(hour < 180)]
    archive = Archive(spark, f"{tmp_path}/a")
    for p in order:
        incremental.ingest(parts[p], archive)
    assert shown(archive.patterns()) == once(bars)
    assert sorted(map(tuple, archive.bars().select(*bars.columns).collect())) == sorted(map(tuple, bars.collect()))
    counted = {r.ticker: r.n for r in archive.counts().collect()}
    assert counted == {r.ticker: r["count"] for r in archive.patterns().groupBy("ticker").count().collect()}
    # Late bars that come before the first window is cut make nothing void.
    assert (archive.cuts() is None) == (order == [2, 0, 1])
    assert archive.cuts() is None or archive.read("patterns").count() > archive.patterns().count()
    if order != [0, 1, 2]:
        return
    archive.compact(3)
    again = Archive(spark, f"{tmp_path}/a")
    assert again.base == 3 and shown(again.patterns()) == once(bars) and again.read("patterns").count() == again.patterns().count()
    more = walks(spark, {"A": 320, "B": 200}, 3).where(hour >= 250)
    incremental.ingest(more, again)
    assert shown(again.patterns()) == once(bars.unionByName(more))


def test_corrections_win_and_repeats_change_nothing(spark, tmp_path):
    bars = walks(spark, {"A": 200}, 5).cache()
    archive = Archive(spark, f"{tmp_path}/a")
    incremental.ingest(bars, archive)
    assert incremental.ingest(bars, archive, 0) == 0
    assert incremental.arrivals(bars, archive).count() == 0
    fixed = bars.withColumn("close", F.when(F.col("ts") == F.lit(START + dt.timedelta(hours=150)), F.col("close") * 1.5).otherwise(F.col("close")))
    change = incremental.arrivals(fixed, archive)
    assert change.count() == 1
    incremental.ingest(change, archive)
    assert shown(archive.patterns()) == once(fixed)
    # Windows that end before the changed bar were not written again.
    assert archive.read("patterns").where("ingest = 1").agg(F.min("k")).first()[0] == (150 - 80) // 30 + 1


def test_a_failed_ingest_does_not_count(spark, tmp_path, monkeypatch):
    bars = walks(spark, {"A": 200}, 6)
    archive = Archive(spark, f"{tmp_path}/a")
    commit = Archive.commit

    def broken(self, *a, **b):
        raise RuntimeError("lost")

    monkeypatch.setattr(Archive, "commit", broken)
    with pytest.raises(RuntimeError):
        incremental.ingest(bars, archive)
    assert Archive(spark, f"{tmp_path}/a").patterns().count() == 0
    monkeypatch.setattr(Archive, "commit", commit)
    incremental.ingest(bars, Archive(spark, f"{tmp_path}/a"))
    assert shown(Archive(spark, f"{tmp_path}/a").patterns()) == once(bars)


def test_nothing_to_ingest(spark, tmp_path):
    archive = Archive(spark, f"{tmp_path}/a")
    assert archive.patterns().count() == 0 and archive.counts().count() == 0
    assert incremental.ingest(walks(spark, {"A": 10}).limit(0), archive) == 0
    assert incremental.ingest(walks(spark, {"A": 79}), Archive(spark, f"{tmp_path}/a")) == 0
    assert Archive(spark, f"{tmp_path}/a").tails().first().next_k == 0


def files_read(df):
    """How many files the scans of a plan read, and its pushed filters."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return plan, text


def test_filters_choose_folders_and_row_groups(spark, tmp_path):
    bars = walks(spark, {f"T{i}": 110 for i in range(12)}, 7)
    archive = Archive(spark, f"{tmp_path}/a", slots=8)
    incremental.ingest(bars, archive)
    incremental.ingest(bars.withColumn("timeframe", F.lit("1d")), archive)
    every, one = archive.patterns(), archive.patterns("1h", "T3")
    assert len(one.inputFiles()) <= len(every.inputFiles())
    wanted = {f for f in every.select(F.input_file_name().alias("f")).where("timeframe = '1h' AND ticker = 'T3'").distinct().toPandas()["f"]}
    read = one.select(F.input_file_name().alias("f"), "ticker")
    _, text = files_read(one)
    assert re.search(r"PartitionFilters: \[.*slot.* = \d+\)", text) and "EqualTo(ticker,T3)" in text
    # Only the folder of the ticker's slot is listed for the scan.
    slot = every.sparkSession.range(1).select(archive.slot(F.lit("T3"))).first()[0]
    scanned = archive.read("patterns").where(f"timeframe = '1h' AND slot = {slot}")
    assert {f for f in read.select("f").distinct().toPandas()["f"]} == wanted and all(f"slot={slot}/" in f and "timeframe=1h" in f for f in wanted)
    assert scanned.select("ticker").distinct().count() < 12
    limited = archive.patterns("1h", limit=5).collect()
    assert [r.pattern_id for r in limited] == sorted(r.pattern_id for r in archive.patterns("1h").collect())[:5]


def test_an_ingest_scans_new_bars_alone(spark, tmp_path):
    path = f"{tmp_path}/bars"
    bars = walks(spark, {"A": 900}, 8)
    bars.where(F.col("ts") < F.lit(START + dt.timedelta(hours=800))).coalesce(1).write.parquet(path)
    archive = Archive(spark, f"{tmp_path}/a")
    incremental.ingest(incremental.arrivals(spark.read.parquet(path), archive), archive)
    bars.where(F.col("ts") >= F.lit(START + dt.timedelta(hours=800))).coalesce(1).write.mode("append").parquet(path)
    new = incremental.arrivals(spark.read.schema(BARS).parquet(path), archive)
    assert new.count() == 100
    _, text = files_read(new)
    assert text.count("GreaterThanOrEqual(ts,") >= 2
    assert incremental.ingest(new, archive) == 3 and shown(archive.patterns()) == once(bars)


def echoes_by_series(rows):
    return {(r.ticker, r.timeframe): (r.as_of, r.n_matches, r.echo_type, round(r.similarity, 9), round(r.confidence, 9), tuple((m["rank"], m.pattern_id, round(m.composite, 9)) for m in r.matches)) for r in rows.collect()}


def test_results_are_written_once_a_batch(spark, tmp_path):
    bars = walks(spark, {"A": 260, "B": 220, "C": 30}, 9).cache()
    patterns = plans.patterns_of(bars).cache()
    path = f"{tmp_path}/r"
    early = bars.where(F.col("ts") < F.lit(START + dt.timedelta(hours=180)))
    for batch, rows in ((0, early), (1, bars.where("ticker <> 'B'")), (1, bars.where("ticker <> 'B'"))):
        results.write_results(plans.echoes(W.latest_window(rows), patterns), path, batch)
    found = results.read_results(spark, path)
    assert sorted((r.ticker, r.batch) for r in found.collect()) == [("A", 0), ("A", 1), ("B", 0)]
    newest = {(r.ticker): r for r in results.latest(found).collect()}
    assert newest["A"].batch == 1 and newest["B"].batch == 0
    assert newest["A"].n_matches == len(newest["A"].matches) > 0 and [m["rank"] for m in newest["A"].matches] == [*range(1, newest["A"].n_matches + 1)]
    assert newest["A"].similarity == newest["A"].matches[0].composite
    _, text = files_read(results.read_results(spark, path, "A", "1h"))
    assert "EqualTo(ticker,A)" in text and "EqualTo(timeframe,1h)" in text


def test_windows_without_matches_have_a_result(spark):
    bars = walks(spark, {"A": 100}, 10)
    found = plans.echoes(W.latest_window(bars), plans.patterns_of(bars).limit(0)).first()
    assert found.n_matches == 0 and found.matches == [] and found.similarity == 0.0 and found.echo_type == "insufficient_data"


@pytest.mark.parametrize("pieces", [1, 5])
def test_streamed_scan_equals_the_scan_of_all(spark, tmp_path, pieces):
    """Cut into batches with late and repeated bars, and stopped halfway."""
    bars = walks(spark, {"A": 200, "B": 130, "C": 59, "D": 61}, 11).cache()
    patterns = plans.patterns_of(bars).cache()
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    # Late ones stand where a hash puts them, within ten bars of their turn.
    turn = F.unix_seconds("ts") + F.when(F.pmod(F.xxhash64("ticker", "ts"), F.lit(5)) == 0, 36000).otherwise(0)
    low, high = bars.agg(F.min(turn), F.max(turn)).first()
    piece = F.least(F.floor((turn - low) * pieces / (high - low)), F.lit(pieces - 1))

    def feed(numbers):
        for p in numbers:
            bars.where(piece == p).unionByName(bars.where(piece == p).limit(3)).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(source)
        q = live.scan_stream(stream, out, lambda s: patterns).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    feed(range(pieces // 2 + 1))
    run()
    feed(range(pieces // 2 + 1, pieces))
    run()
    found = results.read_results(spark, f"{out}/results")
    want = echoes_by_series(plans.echoes(W.latest_window(bars), patterns))
    assert echoes_by_series(results.latest(found)) == want and {t for t, _ in want} == {"A", "B", "D"}
    assert found.groupBy("ticker", "batch").count().where("count > 1").isEmpty()
    if pieces > 1:
        assert found.select("batch").distinct().count() > 1


def test_a_batch_that_is_tried_again_is_not_added(spark, tmp_path):
    bars = walks(spark, {"A": 200}, 12)
    patterns = plans.patterns_of(bars)
    sink = live.scan_sink(f"{tmp_path}/o", lambda s: patterns)
    windows = W.latest_window(bars)
    sink(windows, 5)
    sink(windows, 5)
    assert [(r.ticker, r.batch) for r in results.read_results(spark, f"{tmp_path}/o/results").collect()] == [("A", 5)]


def test_scan_reads_the_archive(spark, tmp_path):
    bars = walks(spark, {"A": 200, "B": 200}, 13)
    config = EngineConfig(min_similarity=0.1)
    archive = Archive(spark, f"{tmp_path}/a")
    incremental.ingest(bars, archive)
    got = echoes_by_series(incremental.echoes_of(bars, archive, config=config))
    assert got == echoes_by_series(plans.echoes(W.latest_window(bars), plans.patterns_of(bars), config))
    same = incremental.echoes_of(bars, archive, config=config, cross_asset=False)
    assert all({m.ticker for m in r.matches} == {r.ticker} for r in same.collect())
    full = incremental.scan_archive(bars, archive, config=config).collect()
    assert {r.query_id for r in full} == {"A", "B"} and all(r.n_matches > 0 for r in full)
