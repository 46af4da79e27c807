"""Every operator as a query over the driver's tables, with DuckDB SQL where SQL can say it.

Floats are rounded to six places on both sides; timestamps are given as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import records, tiles
from .operators import encoder, features, labels, normalize, outcomes, projection, reduction, replay, signals, similarity, warping
from .operators import windows as W
from .plans import incremental
from .plans import scan as plans
from .sources import bars as B
from .sources import results, store
from .sources.archive import Archive
from .sources.folders import settled, shared_folder
from .streaming import live

PLACES = 6
AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(df: DataFrame) -> DataFrame:
    """Rounded doubles, timestamps as text."""
    kinds = dict(df.dtypes)
    def one(c: str) -> Column:
        if kinds[c] == "double":
            return (F.round(c, PLACES) + 0.0).alias(c)
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kinds[c].startswith("timestamp") else F.col(c)
    return df.select(*(one(c) for c in df.columns))


def shown_pairs(df: DataFrame) -> DataFrame:
    """The same of likenesses, which are many and small, as SQL rounds: the product with a power of ten, half away from zero."""
    near = lambda x: F.when(F.isnan(x), x).otherwise(F.signum(x) * F.floor(F.abs(x) * 10**PLACES + 0.5) / 10**PLACES) + 0.0
    return df.withColumns({c: near(F.col(c)) for c, kind in df.dtypes if kind == "double"})


def rounded(expr: str, name: str) -> str:
    return f"round({expr}, {PLACES}) + 0.0 AS {name}"


# --- shared parts of the SQL ---------------------------------------------------------------------------------------
TICKS = "SELECT event_type AS ticker, ts, {price} AS price, regexp_extract(props, '-?[0-9][0-9.]*')::DOUBLE AS size, event_id FROM events"
RUNNING = "avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"


def bars_sql(price: str = RUNNING, unit: str = "time_bucket(INTERVAL '1 hour', ts)") -> str:
    return f"""t AS ({TICKS.format(price=price)}),
bars AS (SELECT ticker, {unit} AS ts, min_by(price, event_id) AS open, max(price) AS high, min(price) AS low,
  max_by(price, event_id) AS close, sum(size) AS volume FROM t GROUP BY 1, 2)"""


# The rules of the survey, written out again for the SQL side.
OUTCOME_CASE = """CASE WHEN forward_return > 0.05 AND max_drawdown > -0.03 THEN 'explosive_continuation'
  WHEN forward_return > 0.02 AND abs(max_drawdown) < 0.03 THEN 'slow_grind_continuation'
  WHEN forward_return < -0.03 THEN 'full_reversal'
  WHEN max_runup > 0.03 AND forward_return < 0 THEN 'fake_breakout_failure'
  WHEN abs(forward_return) < 0.02 AND abs(max_drawdown) > 0.03 THEN 'volatility_expansion_directionless'
  WHEN forward_return > 0 AND max_drawdown < -0.04 THEN 'whipsaw_continuation' ELSE 'mixed_regime' END"""
CLUSTER_CASE = """CASE WHEN avg_return > 0.05 AND avg_drawdown > -0.03 THEN 'explosive_continuation'
  WHEN avg_return > 0.02 AND avg_drawdown > -0.02 THEN 'slow_grind_continuation'
  WHEN avg_return < -0.03 THEN 'full_reversal'
  WHEN abs(avg_return) < 0.02 AND avg_runup > 0.03 AND avg_drawdown < -0.03 THEN 'volatility_expansion_directionless'
  WHEN avg_runup > 0.03 AND avg_return < 0 THEN 'fake_breakout_failure'
  WHEN avg_return > 0 AND avg_drawdown < -0.04 THEN 'whipsaw_continuation' ELSE 'mixed_regime' END"""
ECHO_CASE = """CASE WHEN r > 0.05 AND d > -0.03 THEN 'explosive_continuation' WHEN r > 0.02 AND s < 0.05 THEN 'slow_grind_continuation'
  WHEN r < -0.02 AND d < -0.05 THEN 'full_reversal' WHEN abs(r) < 0.02 AND s > 0.05 THEN 'volatility_expansion_directionless'
  WHEN r > 0 AND d < -0.04 THEN 'whipsaw_continuation' WHEN r < 0 AND d < -0.02 THEN 'late_stage_compression' ELSE 'mixed_regime' END"""
FAILURE_CASE = """CASE WHEN max_runup > 0.03 AND forward_return < 0 THEN {0}
  WHEN max_drawdown < -0.08 THEN {1}
  WHEN forward_return < -0.03 AND abs(max_drawdown) < 0.05 THEN {2}
  WHEN abs(max_runup) > 0.03 AND abs(max_drawdown) > 0.03 AND abs(forward_return) < 0.02 THEN {3} END"""
WINDOWS = """pos AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars),
wb AS (SELECT *, pos - k * 30 AS i FROM (SELECT *, unnest(range(greatest(0, ceil((pos - 79) / 30.0)::BIGINT), pos // 30 + 1)) AS k FROM pos) WHERE k * 30 + 80 <= n)"""
OUTCOMES = f"""ent AS (SELECT *, max(CASE WHEN i = 59 THEN close END) OVER (PARTITION BY ticker, k) AS e FROM wb),
mv AS (SELECT *, (close - e) / e AS m FROM ent),
oc AS (SELECT ticker, k, min(CASE WHEN i = 0 THEN ts END) AS start_time, max(CASE WHEN i = 59 THEN ts END) AS end_time,
  max_by(m, i) FILTER (i >= 60) AS forward_return, min(m) FILTER (i >= 60) AS max_drawdown, max(m) FILTER (i >= 60) AS max_runup,
  (min_by(i, (-abs(m), i)) FILTER (i >= 60) - 59)::INT AS time_to_resolution FROM mv GROUP BY ticker, k),
lab AS (SELECT *, {OUTCOME_CASE} AS outcome_label FROM oc)"""
STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"



def windowed_sql(select: str, more: str = "", price: str = RUNNING) -> str:
    return f"WITH {bars_sql(price)}, {WINDOWS}{', ' + more if more else ''} {select}"


def smooth(spark: SparkSession, d: str) -> DataFrame:
    return B.bars_smooth(table(spark, d, "events"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    return W.rolling_windows(smooth(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return W.forward_outcomes(windows(spark, d)).withColumn("outcome_label", labels.outcome_label())


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as patterns; their ticker is the label."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("pattern_id"), F.col("label").cast("string").alias("ticker"), F.col("embedding").cast("array<double>").alias("vector")
    )


#: The stated query set: every pattern whose id is divisible by 20, against all patterns but itself.
ASKED = "pattern_id % 20 = 0"
PAIRS = "FROM v AS q, v WHERE q.pattern_id % 20 = 0 AND v.pattern_id <> q.pattern_id"


def asked(spark: SparkSession, d: str) -> DataFrame:
    found = vectors(spark, d).where(ASKED)
    return found.select(F.col("pattern_id").alias("query_id"), F.col("ticker").alias("q_ticker"), F.col("vector").alias("q_vector"))


V_SQL = "v AS (SELECT vec_id AS pattern_id, label::VARCHAR AS ticker, embedding::DOUBLE[] AS vector FROM embeddings)"
COS = "list_cosine_similarity(q.vector, v.vector)"
EUC = "exp(-list_distance(q.vector, v.vector) / (sqrt(len(v.vector)) + 1e-10))"


def matched(spark: SparkSession, d: str) -> DataFrame:
    """The queries' best embeddings, each with the outcome of a window chosen by its id.

    With t tickers and n windows of the (id mod t)-th, it is that ticker's window (id div t) mod n.  Matches, top_n a
    query, are written to the shared folder, as all that is said of them reads them; so are the windows' outcomes.
    """
    found = similarity.find_matches_batch(vectors(spark, d), asked(spark, d), 20, 0.3, True)
    past = labelled(spark, d).select(F.col("ticker").alias("o_ticker"), F.col("k").alias("slot"), "forward_return", "max_drawdown", "max_runup", "time_to_resolution", "outcome_label")
    past = settled(past, "outcomes")
    owners = past.groupBy("o_ticker").agg(F.count("*").alias("n"))
    owners = owners.withColumn("turn", F.row_number().over(Window.orderBy("o_ticker")) - 1)  # a row for each ticker, no more
    rows = found.join(F.broadcast(owners.agg(F.count("*").alias("t"))))
    rows = rows.withColumn("turn", (F.col("pattern_id") % F.col("t")).cast("int")).join(owners, "turn")
    rows = rows.withColumn("slot", (F.floor(F.col("pattern_id") / F.col("t")) % F.col("n")).cast("int")).join(past, ["o_ticker", "slot"])
    return settled(rows.select("query_id", "pattern_id", "ticker", "composite", "rank", "forward_return", "max_drawdown", "max_runup", "time_to_resolution", "outcome_label"), "matches")


MATCHES = f"""{V_SQL}, sc AS (SELECT q.pattern_id AS query_id, v.pattern_id, v.ticker, 0.6 * {COS} + 0.4 * {EUC} AS composite {PAIRS}),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, pattern_id) AS rank FROM sc WHERE composite >= 0.3 QUALIFY rank <= 20),
ow AS (SELECT ticker AS o_ticker, count(*) AS n, row_number() OVER (ORDER BY ticker) - 1 AS turn, count(*) OVER () AS t FROM lab GROUP BY ticker),
m AS (SELECT rk.*, forward_return, max_drawdown, max_runup, time_to_resolution, outcome_label
  FROM rk JOIN ow ON rk.pattern_id % t = turn JOIN lab ON lab.ticker = o_ticker AND lab.k = (rk.pattern_id // t) % n)"""


def matches_sql(select: str) -> str:
    return windowed_sql(select, f"{OUTCOMES}, {MATCHES}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# --- bars and windows ----------------------------------------------------------------------------------------------
LABEL_COLUMNS = ("ticker", "k", "start_time", "end_time", "forward_return", "max_drawdown", "max_runup", "time_to_resolution", "outcome_label")
LABEL_SQL = ", ".join([
    "ticker", "k::BIGINT AS k", STAMP.format(c="start_time"), STAMP.format(c="end_time"), *(rounded(c, c) for c in ("forward_return", "max_drawdown", "max_runup")),
    "time_to_resolution", "outcome_label",
])


@query("outcome_labels", windowed_sql(f"SELECT {LABEL_SQL} FROM lab", OUTCOMES))
def outcome_labels(spark, d):
    return shown(labelled(spark, d).withColumn("k", F.col("k").cast("long")).select(*LABEL_COLUMNS))


BAR_SQL = f"SELECT ticker, {STAMP.format(c='ts')}, {', '.join(rounded(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars"


@query("bars_events", f"WITH {bars_sql('value')} {BAR_SQL}")
def bars_events(spark, d):
    return shown(B.bars_events(table(spark, d, "events")).drop("timeframe"))


#: Means of up to 200 amounts of cents that end, end within nine places, so no engine has to break a tie there.
EXACT = f"SELECT ticker, {STAMP.format(c='ts')}, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars"


@query("bars_smooth", f"WITH {bars_sql()} {EXACT}")
def bars_smooth(spark, d):
    found = smooth(spark, d).drop("timeframe").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return found.withColumns({c: F.round(c, 9) + 0.0 for c in ("open", "high", "low", "close", "volume")})


@query("bars_4h", f"WITH {bars_sql('value', chr(32).join(['time_bucket(INTERVAL', chr(39) + '4 hours' + chr(39) + ', ts, TIMESTAMP', chr(39) + '1970-01-01' + chr(39) + ')']))} {BAR_SQL}")
def bars_4h(spark, d):
    return shown(B.bars_events(table(spark, d, "events"), "4h").drop("timeframe"))


@query("bars_all_timeframes", f"""WITH t AS ({TICKS.format(price='value')}), f(timeframe, s) AS (VALUES ('1m', 60), ('2m', 120), ('5m', 300), ('10m', 600), ('15m', 900), ('30m', 1800), ('1h', 3600), ('2h', 7200), ('4h', 14400), ('1d', 86400), ('1w', 604800)),
bars AS (SELECT ticker, timeframe, make_timestamp(epoch_us(ts) // (s * 1000000::BIGINT) * s * 1000000) AS ts, min_by(price, event_id) AS open, max(price) AS high, min(price) AS low, max_by(price, event_id) AS close, sum(size) AS volume FROM t, f GROUP BY 1, 2, 3)
SELECT timeframe, {BAR_SQL.removeprefix('SELECT ')}""")
def bars_all_timeframes(spark, d):
    return shown(B.bars_of_all(B.event_ticks(table(spark, d, "events")), ["event_id"]))


LINEITEM_BARS = """t AS (SELECT l_suppkey::VARCHAR AS ticker, date_trunc('day', l_shipdate) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size,
  (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS o FROM lineitem),
bars AS (SELECT ticker, ts, min_by(price, o) AS open, max(price) AS high, min(price) AS low, max_by(price, o) AS close, sum(size) AS volume FROM t GROUP BY 1, 2)"""


@query("bars_lineitem", f"WITH {LINEITEM_BARS} {BAR_SQL}")
def bars_lineitem(spark, d):
    return shown(B.bars_lineitem(table(spark, d, "lineitem")).drop("timeframe"))


@query("tail_n", f"WITH {bars_sql()} {BAR_SQL} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bars.ts DESC) <= 50")
def tail_n(spark, d):
    return shown(B.tail(smooth(spark, d), 50).drop("timeframe"))


@query("symbols", "SELECT DISTINCT event_type AS ticker, upper(event_type) AS symbol FROM events UNION ALL SELECT 'btc-usd', 'X:BTCUSD'")
def symbols(spark, d):
    names = table(spark, d, "events").select(F.col("event_type").alias("ticker")).distinct().unionByName(spark.range(1).select(F.lit("btc-usd").alias("ticker")))
    return names.select("ticker", B.symbol(F.col("ticker")).alias("symbol"))


@query("rolling_windows", windowed_sql(f"SELECT ticker, k::BIGINT AS k, i::BIGINT AS i, {rounded('close', 'close')} FROM wb"))
def rolling_windows(spark, d):
    return shown(windows(spark, d).select("ticker", F.col("k").cast("long"), F.col("i").cast("long"), "close"))


@query("latest_window", f"WITH {bars_sql()} {BAR_SQL} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bars.ts DESC) <= 60")
def latest_window(spark, d):
    return shown(W.latest_window(smooth(spark, d)).select("ticker", "ts", "open", "high", "low", "close", "volume"))


# --- fingerprints --------------------------------------------------------------------------------------------------
def group_query(group: str):
    """Over raw bars: comparisons of running means would hang on how an engine adds."""

    def run(spark, d):
        raw = W.rolling_windows(B.bars_events(table(spark, d, "events")))
        return shown(features.features(raw, (group,)).drop("timeframe").withColumn("k", F.col("k").cast("long")))

    return run


_RET = "rr AS (SELECT *, ln(greatest(close, 1e-10)) - ln(greatest(lag(close) OVER w, 1e-10)) AS r FROM wb WHERE i < 60 WINDOW w AS (PARTITION BY ticker, k ORDER BY i))"
_E = "1e-10"


def _rolled(kind: str) -> str:
    return ", ".join(
        f"CASE WHEN i >= {n} THEN {kind}(r) OVER (PARTITION BY ticker, k ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS x{n}" for n in (5, 10, 20)
    )


def _differences(by: str, source: str) -> str:
    return ", ".join(f"{source}{n} - lag({source}{n}) OVER (PARTITION BY ticker, k ORDER BY i) AS {by}{n}" for n in (5, 10, 20))


def _last(c: str) -> str:
    return f"arg_max({c}, i) FILTER ({c} IS NOT NULL)"


def _first(c: str) -> str:
    return f"arg_min({c}, i) FILTER ({c} IS NOT NULL)"


FEATURE_SQL = {
    "volatility": (
        f"{_RET}, a AS (SELECT *, {_rolled('stddev_samp')} FROM rr), b AS (SELECT *, {_differences('d', 'x')} FROM a)",
        "b",
        {f"{name}_{n}": e.format(x=f"x{n}", d=f"d{n}", last=_last(f"x{n}")) for n in (5, 10, 20) for name, e in (
            ("vol_z", "({last} - avg({x})) / (stddev_pop({x}) + 1e-10)"), ("vol_slope", "regr_slope({x}, i) / (avg({x}) + 1e-10)"), ("vol_of_vol", "stddev_pop({d}) / (avg({x}) + 1e-10)"))},
    ),
    "momentum": (
        f"{_RET}, a AS (SELECT *, {_rolled('avg')} FROM rr), b AS (SELECT *, {_differences('d', 'x')} FROM a), c AS (SELECT *, {_differences('j', 'd')} FROM b)",
        "c",
        {f"{name}_{n}": e.format(d=f"d{n}", j=f"j{n}", last=_last(f"d{n}"), first=_first(f"d{n}")) for n in (5, 10, 20) for name, e in (
            ("mean_accel", "avg({d})"), ("accel_trend", "({last} - {first}) / (count({d}) + 1e-10)"), ("mean_jerk", "avg({j})"))},
    ),
    "compression": (
        "a AS (SELECT *, lag(close) OVER (PARTITION BY ticker, k ORDER BY i) AS pc FROM wb WHERE i < 60), "
        "b AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM a), "
        "c AS (SELECT *, CASE WHEN i >= 5 THEN avg(tr) OVER (PARTITION BY ticker, k ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS a5, "
        "CASE WHEN i >= 19 THEN stddev_samp(close) OVER w / (abs(avg(close) OVER w) + 1e-10) END AS bw FROM b WINDOW w AS (PARTITION BY ticker, k ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), "
        "e AS (SELECT *, a5 - lag(a5) OVER (PARTITION BY ticker, k ORDER BY i) AS da FROM c)",
        "e",
        {
            "atr_ratio": "avg(tr) FILTER (i >= 50) / (avg(tr) + 1e-10)",
            "compression_ratio": "count(*) FILTER (da < 0) / (count(*) FILTER (da < 0) + count(*) FILTER (da > 0) + 1e-10)",
            "expansion_ratio": "count(*) FILTER (da > 0) / (count(*) FILTER (da < 0) + count(*) FILTER (da > 0) + 1e-10)",
            "bw_current": _last("bw"),
            "bw_slope": f"({_last('bw')} - {_first('bw')}) / (count(bw) + 1e-10)",
            "compression_bars": "count(*) FILTER (da < 0)::DOUBLE",
        },
    ),
    "direction": (
        "a AS (SELECT *, (close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w + 1e-10) AS y, (i - 29.5) * (i - 29.5) - 3599 / 12.0 AS q FROM wb WHERE i < 60 WINDOW w AS (PARTITION BY ticker, k))",
        "a",
        {
            "slope": "regr_slope(y, i)", "r2": "CASE WHEN stddev_pop(y) = 0 THEN 0 ELSE regr_r2(y, i) END", "curvature": "sum(q * y) / sum(q * q)",
            "endpoint_dev": f"{_last('y')} - (regr_slope(y, i) * 59 + regr_intercept(y, i))",
        },
    ),
    "volume": (
        f"{_RET}, a AS (SELECT *, volume / (avg(volume) OVER (PARTITION BY ticker, k) + 1e-10) AS y FROM rr)",
        "a",
        {
            "volume_slope": "regr_slope(y, i)", "volume_r2": "CASE WHEN stddev_pop(y) = 0 THEN 0 ELSE regr_r2(y, i) END",
            "volume_accel": "(max(y) FILTER (i = 59) - max(y) FILTER (i = 58) - max(y) FILTER (i = 1) + max(y) FILTER (i = 0)) / 58",
            "pv_corr": "CASE WHEN stddev_pop(volume) FILTER (r IS NOT NULL) > 0 AND stddev_pop(abs(r)) > 0 THEN covar_pop(abs(r), volume) FILTER (r IS NOT NULL) / (stddev_pop(abs(r)) * stddev_pop(volume) FILTER (r IS NOT NULL)) ELSE 0 END",
            "volume_z": f"({_last('y')} - 1) / (stddev_pop(y) + 1e-10)", "concentration": "sum(y) FILTER (i >= 48) / (sum(y) + 1e-10)",
        },
    ),
    "symmetry": (
        "a AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker, k ORDER BY i) AS dc, max(CASE WHEN i < 30 THEN close END) OVER (PARTITION BY ticker, k, i % 30) AS p FROM wb WHERE i < 60)",
        "a",
        {
            "range_ratio": "(max(close) FILTER (i >= 30) - min(close) FILTER (i >= 30)) / (max(close) FILTER (i < 30) - min(close) FILTER (i < 30) + 1e-10)",
            "vol_ratio": "stddev_pop(dc) FILTER (i > 30) / (stddev_pop(dc) FILTER (i > 0 AND i < 30) + 1e-10)",
            "dir_symmetry": "CASE WHEN abs(max(close) FILTER (i = 29) - max(close) FILTER (i = 0)) < 3e-11 OR abs(max(close) FILTER (i = 59) - max(close) FILTER (i = 30)) < 3e-11 THEN 0 ELSE sign(max(close) FILTER (i = 29) - max(close) FILTER (i = 0)) * sign(max(close) FILTER (i = 59) - max(close) FILTER (i = 30)) END::DOUBLE",
            "half_corr": "coalesce(covar_pop(p, close) FILTER (i >= 30) / nullif(stddev_pop(p) FILTER (i >= 30) * stddev_pop(close) FILTER (i >= 30), 0), 0)",
        },
    ),
    "breakout": (
        "a AS (SELECT *, max(CASE WHEN i < 30 THEN high END) OVER w AS t, min(CASE WHEN i < 30 THEN low END) OVER w AS b, max(CASE WHEN i = 59 THEN close END) OVER w AS z FROM wb WHERE i < 60 WINDOW w AS (PARTITION BY ticker, k))",
        "a",
        {
            "upside_ratio": "count(*) FILTER (i >= 30 AND close > t) / (30 + 1e-10)", "downside_ratio": "count(*) FILTER (i >= 30 AND close < b) / (30 + 1e-10)",
            "failed_score": "CASE WHEN count(*) FILTER (i >= 30 AND (close > t OR close < b)) > 0 AND max(z) BETWEEN max(b) AND max(t) THEN 1.0 WHEN count(*) FILTER (i >= 30 AND close > t) > 0 AND max(z) < max(t) THEN 0.5 WHEN count(*) FILTER (i >= 30 AND close < b) > 0 AND max(z) > max(b) THEN 0.5 ELSE 0.0 END::DOUBLE",
            "max_up_exc": "greatest(0, (max(high) FILTER (i >= 30) - max(t)) / (max(t) - max(b) + 1e-10))", "max_dn_exc": "greatest(0, (max(b) - min(low) FILTER (i >= 30)) / (max(t) - max(b) + 1e-10))",
        },
    ),
    "position": (
        "a AS (SELECT *, max(CASE WHEN i = 59 THEN close END) OVER (PARTITION BY ticker, k) AS z FROM wb WHERE i < 60)",
        "a",
        {
            "position": "(max(z) - min(low)) / (max(high) - min(low) + 1e-10)",
            "vwap_distance": "(max(z) - sum(close * volume) / (sum(volume) + 1e-10)) / (max(high) - min(low) + 1e-10)",
            "percentile": "(count(*) FILTER (close < z) + count(*) FILTER (close <= z) + 1) * 50.0::DOUBLE / 60 / 100", "mean_rev_z": "(max(z) - avg(close)) / (stddev_pop(close) + 1e-10)",
        },
    ),
    "cycle": (
        "a AS (SELECT *, epoch_us(ts) AS u FROM wb WHERE i < 60)",
        "a",
        {f"cycle_{f}": f"{f}(2 * pi() * ((max(u) - epoch_us(TIMESTAMP '2021-01-27')) / 86400e6) / 147)" for f in ("sin", "cos")},
    ),
}
for _group, (_more, _from, _exprs) in FEATURE_SQL.items():
    _select = ", ".join(rounded(e, n) for n, e in _exprs.items())
    query(f"feat_{_group}", windowed_sql(f"SELECT ticker, k::BIGINT AS k, {_select} FROM {_from} GROUP BY ticker, k", _more, "value"))(group_query(_group))


def _joined(groups: tuple[str, ...], select: str, bars: str = "") -> str:
    """Several groups' SQL side by side, each with its own common tables."""
    parts = []
    for g in groups:
        more, source, exprs = FEATURE_SQL[g]
        names = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
        parts.append(f"g_{g} AS (WITH {more} SELECT ticker, k, {names} FROM {source} GROUP BY ticker, k)")
    first, *rest = (f"g_{g}" for g in groups)
    return f"WITH {bars or bars_sql('value')}, {WINDOWS}, {', '.join(parts)} {select} FROM {first} {' '.join(f'JOIN {g} USING (ticker, k)' for g in rest)}"


def raw_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.rolling_windows(B.bars_events(table(spark, d, "events")))


SLOTS = [n for g in features.GROUPS for n in FEATURE_SQL[g][2]]


_SLOTS_SQL = f"SELECT ticker, k::BIGINT AS k, unnest(range(49))::INT AS slot, round(unnest([{', '.join(f'({n})::DOUBLE' for n in SLOTS)}]), 6) + 0.0 AS value"


@query("fingerprint_lineitem", _joined(tuple(features.GROUPS), _SLOTS_SQL, LINEITEM_BARS))
def fingerprint_lineitem(spark, d):
    found = features.fingerprint(W.rolling_windows(B.bars_lineitem(table(spark, d, "lineitem"))))
    return shown(found.select("ticker", F.col("k").cast("long"), F.posexplode("vector").alias("slot", "value")))


@query("fingerprint", _joined(tuple(features.GROUPS), _SLOTS_SQL))
def fingerprint(spark, d):
    found = features.fingerprint(raw_windows(spark, d))
    return shown(found.select("ticker", F.col("k").cast("long"), F.posexplode("vector").alias("slot", "value")))


@query("encoded")
def encoded(spark, d):
    """Warped, fitted to all windows, normalised and along eight principal directions."""
    found = windows(spark, d)
    fitted = encoder.Encoder().fit(found).with_directions(found, 8)
    return shown(fitted.encode(found).select("ticker", "k", F.posexplode("vector").alias("slot", "value")))


@query("fingerprint_warped")
def fingerprint_warped(spark, d):
    warped = features.time_warp(windows(spark, d)).withColumn("ts", F.lit(None).cast("timestamp"))
    found = features.features(warped, tuple(g for g in features.GROUPS if g != "cycle"), window=100)
    return shown(found)


@query("time_warp", windowed_sql(
    f"SELECT ticker, k::BIGINT AS k, j::INT AS i, {rounded('max(CASE WHEN i = lo THEN close END) + (max(CASE WHEN i = lo + 1 THEN close END) - max(CASE WHEN i = lo THEN close END)) * (max(p) - max(lo))', 'close')} FROM g GROUP BY ticker, k, j",
    "g AS (SELECT * FROM (SELECT *, j * 59 / 99.0::DOUBLE AS p, least(floor(j * 59 / 99.0::DOUBLE), 58) AS lo FROM wb, range(100) AS r(j) WHERE i < 60) WHERE i = lo OR i = lo + 1)",
))
def time_warp(spark, d):
    return shown(features.time_warp(windows(spark, d)).select("ticker", F.col("k").cast("long"), "i", "close"))


@query("profiles", _joined(("volatility", "momentum", "volume"), """SELECT ticker, k::BIGINT AS k, CASE WHEN vol_z_5 < -0.5 THEN 'contracting' WHEN vol_z_5 > 0.5 THEN 'expanding' ELSE 'stable' END AS volatility_profile,
CASE WHEN mean_accel_5 > 0.01 THEN 'accelerating' WHEN mean_accel_5 < -0.01 THEN 'decelerating' ELSE 'neutral' END AS momentum_profile,
CASE WHEN concentration > 0.35 AND volume_slope > 0.1 THEN 'climactic' WHEN volume_slope < -0.05 THEN 'dry' WHEN volume_slope > 0.05 THEN 'accumulating' ELSE 'neutral' END AS volume_profile"""))
def profiles(spark, d):
    found = plans.patterns_of(B.bars_events(table(spark, d, "events")))
    return found.select("ticker", F.col("k").cast("long").alias("k"), "volatility_profile", "momentum_profile", "volume_profile")


# --- normalisers and similarity ------------------------------------------------------------------------------------
_LONG = f"{V_SQL}, l AS (SELECT pattern_id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS d FROM v), s AS (SELECT d, avg(x) AS mean, stddev_pop(x) + 1e-10 AS std, min(x) AS low, max(x) AS high FROM l GROUP BY d)"
_NORM = {
    "zscore": "(x - mean) / std", "minmax": "(x - low) / (high - low + 1e-10)", "combined": "1 / (1 + exp(-(x - mean) / std))",
    "rank": "(rank() OVER (PARTITION BY l.d ORDER BY x) + (count(*) OVER (PARTITION BY l.d, x) - 1) / 2.0) / (count(*) OVER (PARTITION BY l.d) + 1)",
}


def norm_query(method: str):
    def run(spark, d):
        found = normalize.normalised(vectors(spark, d), method)
        return shown(found.select("pattern_id", F.posexplode("vector").alias("d", "value")))

    return run


for _method, _rule in _NORM.items():
    query(f"norm_{_method}", f"WITH {_LONG} SELECT pattern_id, l.d::INT AS d, {rounded(f'({_rule})::DOUBLE', 'value')} FROM l JOIN s ON l.d = s.d")(norm_query(_method))


_FITTED = _NORM | {"rank": _NORM["combined"]}


def fitted_query(method: str):
    def run(spark, d):
        asked_ = vectors(spark, d).where(ASKED)
        found = normalize.transform(asked_, normalize.fit(vectors(spark, d)), method)
        return shown(found.select("pattern_id", F.posexplode("vector").alias("d", "value")))

    return run


for _method, _rule in _FITTED.items():
    query(f"fitted_{_method}", f"WITH {_LONG} SELECT pattern_id, l.d::INT AS d, {rounded(f'({_rule})::DOUBLE', 'value')} FROM l JOIN s ON l.d = s.d WHERE pattern_id % 20 = 0")(fitted_query(_method))


@query("sim_pairs", f"WITH {V_SQL} SELECT q.pattern_id AS query_id, v.pattern_id, {rounded(COS, 'cosine')}, {rounded(EUC, 'euclidean')} {PAIRS}")
def sim_pairs(spark, d):
    return shown_pairs(similarity.listed(vectors(spark, d), asked(spark, d), tiles.likenesses, ("cosine", "euclidean"), True))


@query("sim_xcorr", f"""WITH {V_SQL}, z AS (SELECT pattern_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v),
s AS (SELECT pattern_id, avg(x) AS m, stddev_pop(x) + 1e-10 AS sd FROM z GROUP BY pattern_id), n AS (SELECT pattern_id, i, (x - m) / sd AS x FROM z JOIN s USING (pattern_id)),
c AS (SELECT a.pattern_id AS query_id, b.pattern_id, a.i - b.i AS lag, sum(a.x * b.x) AS dot FROM n AS a, n AS b WHERE a.pattern_id % 20 = 0 AND a.pattern_id <> b.pattern_id GROUP BY 1, 2, 3),
e AS (SELECT pattern_id, sum(x * x) AS q FROM n GROUP BY pattern_id)
SELECT query_id, c.pattern_id, {rounded('greatest(0, least(1, max(dot) / (sqrt(max(e.q) * max(f.q)) + 1e-10)))', 'xcorr')} FROM c JOIN e ON c.pattern_id = e.pattern_id JOIN e AS f ON f.pattern_id = query_id GROUP BY query_id, c.pattern_id""")
def sim_xcorr(spark, d):
    return shown_pairs(similarity.listed(vectors(spark, d), asked(spark, d), tiles.correlations, ("xcorr",), True, True))


@query("sim_dtw")
def sim_dtw(spark, d):
    return shown_pairs(similarity.listed(vectors(spark, d), asked(spark, d), tiles.warpings, ("dtw",), True, True))


def window_series(spark: SparkSession, d: str) -> DataFrame:
    """The closes of each window as a series of its own."""
    closes = F.array_sort(F.collect_list(F.when(F.col("i") < 60, F.struct("i", "close"))))["close"]
    found = windows(spark, d).groupBy("ticker", "k").agg(closes.alias("vector"))
    return found.select(F.concat_ws("/", "ticker", "k").alias("pattern_id"), "ticker", "k", "vector")


# Warping along anti-diagonals, one a step: cell i of diagonal g is that of the i-th and the (g - i)-th point.
@query("topk_warped", f"""WITH RECURSIVE {bars_sql(RUNNING)}, {WINDOWS},
ser AS (SELECT ticker || '/' || k AS pattern_id, k, list(close ORDER BY i) AS x FROM wb WHERE i < 60 GROUP BY ticker, k),
mom AS (SELECT *, list_avg(x) AS m, list_stddev_pop(x) + 1e-10 AS sd FROM ser),
z AS (SELECT pattern_id, k, list_transform(x, lambda v: (v - m) / sd) AS z FROM mom),
dg(query_id, pattern_id, s, t, g, two, before) AS (
  SELECT q.pattern_id, p.pattern_id, q.z, p.z, 1, list_transform(range(0, 61), lambda i: CASE WHEN i = 0 THEN 0::DOUBLE ELSE 'inf'::DOUBLE END), list_transform(range(0, 61), lambda i: 'inf'::DOUBLE)
  FROM z AS q, z AS p WHERE q.k % 20 = 0 AND q.pattern_id <> p.pattern_id
  UNION ALL SELECT query_id, pattern_id, s, t, g + 1, before, list_transform(range(0, 61), lambda i: CASE WHEN i >= 1 AND g + 1 - i BETWEEN 1 AND 60
    THEN (s[i] - t[g + 1 - i]) * (s[i] - t[g + 1 - i]) + least(before[i], before[i + 1], two[i]) ELSE 'inf'::DOUBLE END) FROM dg WHERE g < 120),
sc AS (SELECT query_id, pattern_id, exp(-sqrt(before[61]) / 60) AS warp FROM dg WHERE g = 120)
SELECT query_id, pattern_id, {rounded('warp', 'warp')}, row_number() OVER (PARTITION BY query_id ORDER BY warp DESC, pattern_id)::INT AS rank FROM sc QUALIFY rank <= 20""")
def topk_warped(spark, d):
    patterns = window_series(spark, d)
    asked_ = patterns.where("k % 20 = 0").select(F.col("pattern_id").alias("query_id"), F.col("vector").alias("q_vector"))
    return shown(warping.find_warped(patterns, asked_, but_itself=True).select("query_id", "pattern_id", "warp", "rank"))


def _topk_sql(threshold: float, n: int) -> str:
    return f"""WITH {V_SQL}, sc AS (SELECT q.pattern_id AS query_id, v.pattern_id, 0.6 * {COS} + 0.4 * {EUC} AS composite {PAIRS}),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, pattern_id) AS rank FROM sc WHERE composite >= {threshold})
SELECT query_id, pattern_id, {rounded('composite', 'composite')}, rank::INT AS rank FROM rk WHERE rank <= {n}"""


@query("topk_batch", _topk_sql(0.5, 20))
def topk_batch(spark, d):
    found = similarity.find_matches_batch(vectors(spark, d), asked(spark, d), but_itself=True)
    return shown(found.select("query_id", "pattern_id", "composite", "rank"))


@query("topk_per_query", _topk_sql(0.2, 5))
def topk_per_query(spark, d):
    found = similarity.find_matches_batch(vectors(spark, d), asked(spark, d), 5, 0.2, True)
    return shown(found.select("query_id", "pattern_id", "composite", "rank"))


@query("topk_exact", f"""WITH {V_SQL}, z AS (SELECT pattern_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v),
s AS (SELECT pattern_id, avg(x) AS m, stddev_pop(x) + 1e-10 AS sd FROM z GROUP BY pattern_id), n AS (SELECT pattern_id, i, (x - m) / sd AS x FROM z JOIN s USING (pattern_id)),
c AS (SELECT a.pattern_id AS query_id, b.pattern_id, a.i - b.i AS lag, sum(a.x * b.x) AS dot FROM n AS a, n AS b WHERE a.pattern_id % 20 = 0 AND a.pattern_id <> b.pattern_id GROUP BY 1, 2, 3),
e AS (SELECT pattern_id, sum(x * x) AS q FROM n GROUP BY pattern_id),
x AS (SELECT query_id, c.pattern_id, greatest(0, least(1, max(dot) / (sqrt(max(e.q) * max(f.q)) + 1e-10))) AS dtw FROM c JOIN e ON c.pattern_id = e.pattern_id JOIN e AS f ON f.pattern_id = query_id GROUP BY query_id, c.pattern_id),
p AS (SELECT q.pattern_id AS query_id, v.pattern_id, {COS} AS cosine, {EUC} AS euclidean {PAIRS}),
r AS (SELECT *, 0.5 * cosine + 0.3 * euclidean + 0.2 * dtw AS composite FROM p JOIN x USING (query_id, pattern_id))
SELECT query_id, pattern_id, {', '.join(rounded(c, c) for c in ('cosine', 'euclidean', 'dtw', 'composite'))}, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, pattern_id)::INT AS rank
FROM r WHERE composite >= 0.4 QUALIFY rank <= 20""")
def topk_exact(spark, d):
    found = similarity.find_matches(vectors(spark, d), asked(spark, d), 20, 0.4, but_itself=True)
    return shown(found.select("query_id", "pattern_id", "cosine", "euclidean", "dtw", "composite", "rank"))


@query("cross_asset_filter", f"WITH {V_SQL} SELECT q.pattern_id AS query_id, v.pattern_id {PAIRS} AND q.ticker = v.ticker")
def cross_asset_filter(spark, d):
    return similarity.scored(vectors(spark, d), asked(spark, d), False, True).select("query_id", "pattern_id")


# --- ranking and outcomes ------------------------------------------------------------------------------------------
@query("rerank", matches_sql("""SELECT query_id, pattern_id, row_number() OVER (PARTITION BY query_id ORDER BY composite + CASE WHEN share < 0.3 THEN 0.05 * (1 - share) ELSE 0 END DESC, rank)::INT AS rank
FROM (SELECT *, count(*) OVER (PARTITION BY query_id, ticker) / count(*) OVER (PARTITION BY query_id) AS share FROM m)"""))
def rerank(spark, d):
    return similarity.rerank(matched(spark, d)).select("query_id", "pattern_id", "rank")


@query("confidence", matches_sql(f"SELECT query_id, {rounded('greatest(0, least(1, 0.5 * min_by(composite, rank) + 0.3 * avg(composite) + 0.2 * (1 - least(stddev_pop(composite), 1))))', 'confidence')} FROM m GROUP BY query_id"))
def confidence(spark, d):
    return shown(similarity.confidence(matched(spark, d)))


@query("echo_type", matches_sql(f"SELECT query_id, {ECHO_CASE} AS echo_type FROM (SELECT query_id, avg(forward_return) AS r, avg(max_drawdown) AS d, stddev_pop(forward_return) AS s FROM m WHERE rank <= 10 GROUP BY query_id)"))
def echo_type(spark, d):
    top = matched(spark, d).where("rank <= 10").groupBy("query_id").agg(F.avg("forward_return").alias("r"), F.avg("max_drawdown").alias("d"), F.stddev_pop("forward_return").alias("s"))
    return top.select("query_id", labels.echo_type("r", "d", "s").alias("echo_type"))


_STATS = {
    "weighted_return": "sum(composite * forward_return) / (sum(composite) + 1e-10)", "continuation": "avg((forward_return > 0)::INT)", "reversal": "avg((forward_return < -0.02)::INT)",
    "failure": "avg((max_drawdown < -0.05 AND forward_return < 0)::INT)", "mean_return": "avg(forward_return)", "median_return": "median(forward_return)",
    "mean_resolution": "avg(time_to_resolution)", "median_resolution": "median(time_to_resolution)", "worst_drawdown": "min(max_drawdown)", "best_runup": "max(max_runup)",
    "return_std": "stddev_pop(forward_return)", "sharpe": "avg(forward_return) / (stddev_pop(forward_return) + 1e-10)", "win_rate": "avg((forward_return > 0)::INT)",
    "profit_factor": "coalesce(sum(forward_return) FILTER (forward_return > 0), 0) / coalesce(abs(sum(forward_return) FILTER (forward_return < 0)), 1e-10)",
}


@query("outcome_stats", matches_sql(f"SELECT query_id, count(*)::BIGINT AS n_matches, {', '.join(rounded(e, n) for n, e in _STATS.items())} FROM m GROUP BY query_id"))
def outcome_stats(spark, d):
    return shown(outcomes.statistics(matched(spark, d)))


_CONT = "'explosive_continuation', 'slow_grind_continuation', 'whipsaw_continuation'"
_CLASSES = {
    "continuation": f"label IN ({_CONT})", "reversal": "label = 'full_reversal'", "failure": "label = 'fake_breakout_failure'",
    "neutral": f"label NOT IN ({_CONT}, 'full_reversal', 'fake_breakout_failure')",
}
_DIST = {
    "mean_return": "avg(forward_return)", "median_return": "median(forward_return)",
    "std_return": "stddev_pop(forward_return)", "skew": "sum((forward_return - mu) ** 3) / count(*) / stddev_pop(forward_return) ** 3", "kurtosis": "kurtosis_pop(forward_return)",
    **{f"percentile_{q}": f"quantile_cont(forward_return, {q / 100})" for q in (5, 25, 75, 95)},
}
_CLUSTERED = f"""ca AS (SELECT query_id, outcome_label AS cluster_id, count(*)::BIGINT AS n_members, avg(forward_return) AS avg_return, avg(max_drawdown) AS avg_drawdown, avg(max_runup) AS avg_runup,
  avg(time_to_resolution) AS avg_time_to_resolution, quantile_cont(forward_return, 0.1) AS return_low, quantile_cont(forward_return, 0.9) AS return_high FROM m GROUP BY query_id, outcome_label),
cl AS (SELECT *, n_members / sum(n_members) OVER (PARTITION BY query_id) AS probability, {CLUSTER_CASE} AS label FROM ca)"""


@query("distribution_stats", windowed_sql(f"""SELECT query_id, {', '.join(rounded(f"CASE WHEN n < 2 THEN {int(c == 'neutral')} ELSE {c} END", c) for c in _CLASSES)}, {', '.join(rounded(f"CASE WHEN n < 2 THEN 0 ELSE {c} END", c) for c in _DIST)}
FROM (SELECT query_id, {', '.join(f"coalesce(sum(probability) FILTER ({e}), 0) AS {c}" for c, e in _CLASSES.items())} FROM cl GROUP BY query_id)
JOIN (SELECT query_id, count(*) AS n, {', '.join(f"{e} AS {c}" for c, e in _DIST.items())} FROM (SELECT *, avg(forward_return) OVER (PARTITION BY query_id) AS mu FROM m) GROUP BY query_id) USING (query_id)""", f"{OUTCOMES}, {MATCHES}, {_CLUSTERED}"))
def distribution_stats(spark, d):
    """The outcome classes stand in for clusters, since numbers of clusters hang on a random generator."""
    return shown(outcomes.distribution(matched(spark, d).withColumn("cluster_id", F.col("outcome_label"))))


_KIND = FAILURE_CASE.format("'false_breakout'", "'severe_drawdown'", "'slow_bleed'", "'whipsaw'")
_SEVERITY = FAILURE_CASE.format(
    "least(1, abs(forward_return - max_runup) / 0.1)", "least(1, abs(max_drawdown) / 0.15)", "least(1, abs(forward_return) / 0.08)", "least(1, (abs(max_runup) + abs(max_drawdown)) / 0.15)"
)
_BAD = f"(SELECT *, {_KIND} AS failure_type, {_SEVERITY} AS severity FROM m)"


@query("failure_cases", matches_sql(f"SELECT query_id, pattern_id, failure_type, {rounded('severity', 'severity')}, time_to_resolution AS divergence_bar FROM {_BAD} WHERE failure_type IS NOT NULL"))
def failure_cases(spark, d):
    return shown(outcomes.failure_cases(matched(spark, d)).select("query_id", "pattern_id", "failure_type", "severity", "divergence_bar"))


_FAILURES = f"""SELECT query_id, {rounded('count(failure_type) / count(*)', 'failure_rate')}, {rounded('coalesce(avg(severity), 0)', 'avg_severity')}, {rounded('coalesce(max(severity), 0)', 'max_severity')},
{rounded('greatest(0, least(1, 0.4 * count(failure_type) / count(*) + 0.3 * coalesce(avg(severity), 0) + 0.3 * least(1, stddev_pop(forward_return) / 0.1)))', 'failure_risk_score')}, count(failure_type)::BIGINT AS n_failure_cases FROM {_BAD} GROUP BY query_id"""


@query("failure_summary", matches_sql(_FAILURES))
def failure_summary(spark, d):
    return shown(outcomes.failure_summary(matched(spark, d)))


_OMNIBUS = """n1 AS (SELECT query_id, count(*)::DOUBLE AS n, stddev_pop(forward_return) AS sd, avg(forward_return) AS mu, avg((max_drawdown < -0.03 AND forward_return > 0)::INT) AS rescued,
  count(*) FILTER (rank <= 5 AND forward_return < -0.03) AS lost FROM m GROUP BY query_id),
n2 AS (SELECT query_id, sum((forward_return - mu) ** 3) / any_value(n) / any_value(sd) ** 3 AS g1, sum((forward_return - mu) ** 4) / any_value(n) / any_value(sd) ** 4 - 3 AS g2 FROM m JOIN n1 USING (query_id) GROUP BY query_id),
n3 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
  (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM n1 JOIN n2 USING (query_id) WHERE n >= 10 AND sd > 0),
n4 AS (SELECT query_id, asinh(y / sqrt(2 / (sqrt(2 * (b2 - 1)) - 2))) / sqrt(0.5 * ln(sqrt(2 * (b2 - 1)) - 1)) AS z1, x, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / sb ** 2)) AS a FROM n3),
n5 AS (SELECT query_id, exp(-(z1 ** 2 + ((1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))) ** 2) / 2) AS p FROM n4),
nl AS (SELECT query_id, count(*) AS clusters, max(c) AS largest FROM (SELECT query_id, outcome_label, count(*) AS c FROM m GROUP BY ALL) GROUP BY query_id),
nt AS (SELECT query_id, count(*) AS tickers, max(r) AS best, min(r) AS worst FROM (SELECT query_id, ticker, avg(forward_return) AS r FROM m GROUP BY ALL) GROUP BY query_id)"""


_WARNINGS = """SELECT query_id, concat_ws('; ', CASE WHEN p < 0.05 THEN 'return distribution is not normal' END, CASE WHEN sd > 0.08 THEN 'outcomes are widely spread' END,
  CASE WHEN clusters >= 2 AND largest / n < 0.4 THEN 'no outcome prevails' END, CASE WHEN rescued > 0.3 THEN 'gains came after drawdowns' END) AS signals,
concat_ws('; ', CASE WHEN n >= 5 AND g1 < -0.5 THEN 'left-skewed returns' END, CASE WHEN lost >= 3 THEN 'best matches lost' END, CASE WHEN tickers > 1 AND best > 0.03 AND worst < -0.03 THEN 'instruments disagree' END) AS risks
FROM n1 JOIN n2 USING (query_id) LEFT JOIN n5 USING (query_id) JOIN nl USING (query_id) JOIN nt USING (query_id)"""


@query("warnings", windowed_sql(_WARNINGS, f"{OUTCOMES}, {MATCHES}, {_OMNIBUS}"))
def warnings(spark, d):
    found = outcomes.warnings(matched(spark, d))
    return found.select("query_id", F.array_join("signals", "; ").alias("signals"), F.array_join("risks", "; ").alias("risks"))


@query("failure_analysis", windowed_sql(f"""SELECT query_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('failure_rate', 'avg_severity', 'max_severity', 'failure_risk_score', 'n_failure_cases'))},
coalesce(signals, 'too few precedents for a failure analysis') AS signals, coalesce(risks, '') AS risks
FROM (SELECT unnest([pattern_id, -1 - pattern_id]) AS query_id FROM v WHERE pattern_id % 20 = 0) LEFT JOIN ({_FAILURES}) USING (query_id) LEFT JOIN ({_WARNINGS}) USING (query_id)""", f"{OUTCOMES}, {MATCHES}, {_OMNIBUS}"))
def failure_analysis(spark, d):
    """All queries, those of another market too, which nothing matches."""
    matches = matched(spark, d)
    more = asked(spark, d).select(F.col("query_id")).unionByName(asked(spark, d).select((-1 - F.col("query_id")).alias("query_id")))
    found = outcomes.failure_analysis(matches, more)
    return shown(found.withColumns({c: F.array_join(c, "; ") for c in ("signals", "risks")}))


_CLUSTER = ("probability", "avg_return", "avg_drawdown", "avg_runup", "avg_time_to_resolution", "return_low", "return_high")


@query("cluster_summary", windowed_sql(f"SELECT query_id, cluster_id, n_members, {', '.join(rounded(c, c) for c in _CLUSTER)}, {rounded('least(1, probability * n_members / 5)', 'confidence')}, label FROM cl", f"{OUTCOMES}, {MATCHES}, {_CLUSTERED}"))
def cluster_summary(spark, d):
    return shown(outcomes.cluster_summary(matched(spark, d).withColumn("cluster_id", F.col("outcome_label"))))


@query("clusters")
def clusters(spark, d):
    return shown(outcomes.cluster_summary(outcomes.clustered(matched(spark, d))))


def _summed(ids: str) -> str:
    """Clusters of matches by `cluster_id` of a table, with label, as `ck`."""
    return f"""cj AS (SELECT m.*, w.cluster_id FROM m JOIN {ids} AS w USING (query_id, pattern_id)),
cs AS (SELECT query_id, cluster_id, count(*)::BIGINT AS n_members, avg(forward_return) AS avg_return, avg(max_drawdown) AS avg_drawdown, avg(max_runup) AS avg_runup,
  avg(time_to_resolution) AS avg_time_to_resolution, quantile_cont(forward_return, 0.1) AS return_low, quantile_cont(forward_return, 0.9) AS return_high FROM cj GROUP BY query_id, cluster_id),
ck AS (SELECT *, n_members / sum(n_members) OVER (PARTITION BY query_id) AS probability, {CLUSTER_CASE} AS label FROM cs)"""


# Groups are merged one pair a step: the cheapest, of equals that with the earliest members.
_COST = " + ".join(f"(g[i].c[{d}] - g[j].c[{d}]) * (g[i].c[{d}] - g[j].c[{d}])" for d in (1, 2, 3, 4))
_MEAN = ", ".join(f"(g[b.i].c[{d}] * g[b.i].n + g[b.j].c[{d}] * g[b.j].n) / (g[b.i].n + g[b.j].n)" for d in (1, 2, 3, 4))
_POINT = ", ".join(f"round(({c} - avg({c}) OVER w) / (CASE WHEN stddev_pop({c}) OVER w > 0 THEN stddev_pop({c}) OVER w ELSE 1 END), 9)" for c in ("forward_return", "max_drawdown", "max_runup", "time_to_resolution"))
WARD = f"""pt AS (SELECT query_id, pattern_id, rank, [{_POINT}] AS c FROM m WINDOW w AS (PARTITION BY query_id)),
wd AS (SELECT query_id, CASE WHEN count(*) < 3 THEN 1 ELSE least(count(*), greatest(2, least(5, count(*) // 3))) END AS k, count(*) < 3 AS few,
  list({{'n': 1.0::DOUBLE, 'c': c, 'm': [pattern_id]}} ORDER BY rank) AS g FROM pt GROUP BY query_id
  UNION ALL SELECT query_id, k, few, list_transform(list_filter(range(1, len(g) + 1), lambda x: x <> b.j),
    lambda x: CASE WHEN x = b.i THEN {{'n': g[b.i].n + g[b.j].n, 'c': [{_MEAN}], 'm': list_concat(g[b.i].m, g[b.j].m)}} ELSE g[x] END)
  FROM (SELECT *, list_min(flatten(list_transform(range(1, len(g)), lambda i: list_transform(range(i + 1, len(g) + 1),
    lambda j: {{'cost': ({_COST}) * (g[i].n * g[j].n / (g[i].n + g[j].n)), 'i': i, 'j': j}})))) AS b FROM wd WHERE len(g) > k)),
wi AS (SELECT query_id, (x - 1)::INT AS cluster_id, unnest(g[x].m) AS pattern_id FROM (SELECT query_id, g, unnest(range(1, len(g) + 1)) AS x FROM wd WHERE len(g) = k))"""


def ward_sql(select: str, more: str = "") -> str:
    return windowed_sql(select, f"{OUTCOMES}, {MATCHES}, {WARD}, {_summed('wi')}{', ' + more if more else ''}").replace("WITH ", "WITH RECURSIVE ", 1)


@query("clusters_hierarchical", ward_sql(f"SELECT query_id, cluster_id, n_members, {', '.join(rounded(c, c) for c in _CLUSTER)}, {rounded('least(1, probability * n_members / 5)', 'confidence')}, label FROM ck"))
def clusters_hierarchical(spark, d):
    return shown(outcomes.cluster_summary(outcomes.clustered(matched(spark, d), method="hierarchical")))


_SAID = """CASE label WHEN 'explosive_continuation' THEN 'Precedents ran on strongly with little drawdown' WHEN 'slow_grind_continuation' THEN 'Precedents drifted on with little movement against them'
  WHEN 'full_reversal' THEN 'Precedents broke down' WHEN 'fake_breakout_failure' THEN 'Precedents rose first and then gave it all back' WHEN 'volatility_expansion_directionless' THEN 'Precedents swung both ways without a result'
  WHEN 'whipsaw_continuation' THEN 'Precedents went on after a deep drawdown' ELSE 'Precedents ended in different ways' END"""


@query("scenarios_hierarchical", ward_sql(f"""SELECT query_id, cluster_id, label, {rounded('probability', 'probability')}, {rounded('avg_return', 'expected_return')}, {rounded('return_low', 'return_low')}, {rounded('return_high', 'return_high')},
round_even(avg_time_to_resolution, 0)::BIGINT || ' bars' AS resolution, {rounded('least(1, probability * n_members / 5)', 'confidence')},
{_SAID} || ': mean return ' || printf('%+.1f%%', round_even(avg_return * 100, 1)) || ', mean drawdown ' || printf('%.1f%%', round_even(avg_drawdown * 100, 1)) || ', ' || n_members || ' cases.' AS description FROM ck"""))
def scenarios_hierarchical(spark, d):
    return shown(projection.scenarios(outcomes.clustered(matched(spark, d), method="hierarchical")))


@query("scenarios")
def scenarios(spark, d):
    return shown(projection.scenarios(outcomes.clustered(matched(spark, d))))


def projected(spark, d):
    queries = asked(spark, d).select("query_id", "q_ticker")
    return projection.projections(matched(spark, d), queries)


@query("projections")
def projections(spark, d):
    found = projected(spark, d).withColumn("alternatives", F.size("alternatives"))
    return shown(found.select("query_id", "primary.label", "primary.probability", "primary.expected_return", "alternatives", "overall_confidence", "time_horizon", "narrative"))


_HORIZON = """CASE WHEN h < 60 THEN round_even(h, 0)::BIGINT || ' minutes' WHEN h < 1440 THEN round_even(h / 60, 0)::BIGINT || ' hours'
  WHEN h < 10080 THEN round_even(h / 1440, 0)::BIGINT || '-' || round_even(h / 1440 + 1, 0)::BIGINT || ' sessions' ELSE round_even(h / 10080, 0)::BIGINT || '-' || round_even(h / 10080 + 1, 0)::BIGINT || ' weeks' END"""


@query("projections_hierarchical", ward_sql(f"""SELECT query_id, label, {rounded('probability', 'probability')}, {rounded('avg_return', 'expected_return')}, alternatives,
{rounded('0.6 * conf + 0.4 * (1 - failure_risk_score)', 'overall_confidence')}, {_HORIZON} AS time_horizon FROM px""",
f"""pf AS (SELECT query_id, greatest(0, least(1, 0.4 * count(failure_type) / count(*) + 0.3 * coalesce(avg(severity), 0) + 0.3 * least(1, stddev_pop(forward_return) / 0.1))) AS failure_risk_score FROM {_BAD} GROUP BY query_id), pg AS (SELECT query_id, avg(time_to_resolution) * 60 AS h, greatest(0, least(1, 0.5 * min_by(composite, rank) + 0.3 * avg(composite) + 0.2 * (1 - least(stddev_pop(composite), 1)))) AS conf FROM m GROUP BY query_id),
px AS (SELECT *, (count(*) OVER (PARTITION BY query_id) - 1)::INT AS alternatives FROM ck JOIN pg USING (query_id) JOIN pf USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, cluster_id) = 1)"""))
def projections_hierarchical(spark, d):
    matches = matched(spark, d)
    queries = asked(spark, d).select("query_id", "q_ticker").join(matches.select("query_id").distinct(), "query_id", "left_semi")
    found = projection.projections(matches, queries, method="hierarchical").withColumn("alternatives", F.size("alternatives"))
    return shown(found.select("query_id", "primary.label", "primary.probability", "primary.expected_return", "alternatives", "overall_confidence", "time_horizon"))


@query("trade_cards")
def trade_cards(spark, d):
    cards = signals.trade_cards(projected(spark, d).withColumn("price", F.lit(100.0)), F.to_timestamp(F.lit(AS_OF)), ("1", "2"))
    return cards


@query("pca")
def pca(spark, d):
    found = vectors(spark, d)
    near = reduction.reduced(found, reduction.fit(found, 8))
    return shown(near.select("pattern_id", F.posexplode("vector").alias("component", "value")))


# --- signals and replay --------------------------------------------------------------------------------------------
_DAY = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(TIMESTAMP '2021-01-27')) / 86400e6) % 147"


def _scored(spark, d):
    m = matched(spark, d)
    g = m.groupBy("query_id").agg(F.min_by("composite", "rank").alias("similarity"), F.avg("forward_return").alias("mean"), F.stddev_pop("forward_return").alias("std"), outcomes.share(F.col("forward_return") > 0).alias("p"), F.avg("max_drawdown").alias("dd"))
    day = signals.cycle_day(F.to_timestamp(F.lit(AS_OF)))
    return g.join(similarity.confidence(m), "query_id").withColumn("score", signals.score(F.col("similarity"), F.col("mean"), F.col("std"), F.col("p"), day, F.col("confidence")))


_SCORE = f"""g AS (SELECT query_id, min_by(composite, rank) AS sim, avg(forward_return) AS mean, stddev_pop(forward_return) AS std, avg((forward_return > 0)::INT) AS p, avg(max_drawdown) AS dd,
  greatest(0, least(1, 0.5 * min_by(composite, rank) + 0.3 * avg(composite) + 0.2 * (1 - least(stddev_pop(composite), 1)))) AS conf FROM m GROUP BY query_id),
s AS (SELECT *, round(30 * sim + 0.25 * greatest(0, least(100, mean / greatest(0.01, std) * 50)) + 20 * p + 0.15 * greatest(0, 100 - least({_DAY}, 147 - {_DAY}) * (100 / 30.0::DOUBLE)) + 10 * conf, 1) AS score FROM g)"""


@query("signals", windowed_sql(f"SELECT query_id, score, CASE WHEN score >= 93 THEN 'A+' WHEN score >= 87 THEN 'A' WHEN score >= 83 THEN 'B+' WHEN score >= 75 THEN 'B' WHEN score >= 67 THEN 'C+' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, {rounded('100 * (1 + mean)', 'target')}, {rounded('CASE WHEN mean > 0 THEN 100 * (1 - greatest(0.02, dd * 1.5)) ELSE 100 * (1 + greatest(0.02, dd * 1.5)) END', 'stop')}, {rounded('abs(mean / greatest(0.02, dd * 1.5))', 'reward_risk')} FROM s", f"{OUTCOMES}, {MATCHES}, {_SCORE}"))
def signal_scores(spark, d):
    s = _scored(spark, d)
    return shown(s.select("query_id", "score", signals.grade(F.col("score")).alias("grade"), *signals.directives(F.lit(100.0), F.col("mean"), F.col("dd"))))


@query("cycle_phase", f"SELECT DISTINCT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CASE WHEN least(c, 147 - c) < 5 THEN 'critical_convergence' WHEN least(c, 147 - c) < 15 THEN 'elevated_cohesion' WHEN c < 73.5 THEN 'expanding_gap' ELSE 'contracting_gap' END AS phase FROM (SELECT ts, ((epoch_us(date_trunc('day', ts)) - epoch_us(TIMESTAMP '2021-01-27')) / 86400e6) % 147 AS c FROM events)")
def cycle_phase(spark, d):
    days = table(spark, d, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).distinct()
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), signals.cycle_phase(signals.cycle_day(F.col("day"))).alias("phase"))


@query("direction_colors", windowed_sql("SELECT ticker, k::BIGINT AS k, CASE WHEN forward_return > 0 THEN 65416 WHEN forward_return < 0 THEN 16729156 ELSE 8947848 END AS color FROM lab", OUTCOMES))
def direction_colors(spark, d):
    return labelled(spark, d).select("ticker", F.col("k").cast("long").alias("k"), signals.direction_color(F.col("forward_return")).alias("color"))


@query("rank_tiers", "SELECT p_partkey, CASE WHEN p_retailprice / 5 BETWEEN 1 AND 15 THEN 'ALPHA' WHEN p_brand IN ('Brand#11', 'Brand#12') OR p_retailprice / 5 > 350 THEN 'BENCHMARK' ELSE 'BETA' END AS tier FROM part")
def rank_tiers(spark, d):
    tier = signals.rank_tier(F.col("p_brand"), F.col("p_retailprice") / 5, ("Brand#11", "Brand#12"))
    return table(spark, d, "part").select("p_partkey", tier.alias("tier"))


@query("setup_names", windowed_sql("""SELECT DISTINCT outcome_label, CASE outcome_label WHEN 'explosive_continuation' THEN 'Structural Surge' WHEN 'slow_grind_continuation' THEN 'Absorption Grind'
  WHEN 'full_reversal' THEN 'Regime Rejection' WHEN 'fake_breakout_failure' THEN 'Expansion Trap' WHEN 'volatility_expansion_directionless' THEN 'Volatility Squeeze'
  WHEN 'whipsaw_continuation' THEN 'Shakeout Resolution' ELSE 'Structural Recurrence' END AS setup FROM lab""", OUTCOMES))
def setup_names(spark, d):
    return labelled(spark, d).select("outcome_label", signals.setup_name(F.col("outcome_label")).alias("setup")).distinct()


def _candidates(spark, d):
    o = table(spark, d, "orders")
    price, place = F.col("o_totalprice") / 1000, F.col("o_orderkey")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("ticker"), (place % 20).alias("cycle"), (place % 100 / 100).alias("confidence"), (place % 97 + 0.0).alias("score"), price.alias("price"), "o_orderkey")


@query("alert_gate", """WITH c AS (SELECT 'c' || (o_custkey % 50) AS ticker, o_orderkey % 20 AS cycle, o_orderkey % 100 / 100.0::DOUBLE AS confidence, o_orderkey % 97 + 0.0 AS score, o_totalprice / 1000 AS price, o_orderkey FROM orders),
g AS (SELECT ticker, cycle, max(confidence) AS confidence, max(score)::DOUBLE AS score, max(price) AS price FROM c GROUP BY 1, 2),
k AS (SELECT *, ticker IN ('c1', 'c2', 'c3') AS mega FROM g WHERE confidence >= 0.6 AND score >= 67 AND (price <= 350 OR score >= 93))
SELECT ticker, cycle, score, score >= 90 AS special FROM k QUALIFY NOT mega OR row_number() OVER (PARTITION BY cycle, mega ORDER BY ticker) = 1""")
def alert_gate(spark, d):
    best = _candidates(spark, d).groupBy("ticker", "cycle").agg(F.max("confidence").alias("confidence"), F.max("score").alias("score"), F.max("price").alias("price"))
    return signals.alert_gate(best, ("c1", "c2", "c3")).select("ticker", "cycle", "score", "special")


_SCANS = """SELECT 'c' || (user_id % 40) AS ticker, epoch(date_trunc('hour', ts))::BIGINT // 3600 AS cycle, date_trunc('hour', ts) AS ts,
  max(0.5 + event_id % 50 / 100.0::DOUBLE) AS confidence, max(60.0::DOUBLE + event_id % 40) AS score, max(value * 3) AS price FROM events GROUP BY 1, 2, 3"""


@query("alert_history", f"""WITH RECURSIVE s AS ({_SCANS}), g AS (SELECT *, ticker IN ('c1', 'c2', 'c3') AS mega, CASE WHEN ticker IN ('c1', 'c2', 'c3') THEN '' ELSE ticker END AS chain,
  CASE WHEN confidence < 0.6 THEN 'confidence' WHEN score < 67 THEN 'grade' WHEN price > 350 AND score < 93 THEN 'price' ELSE 'sent' END AS fate FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY ts, ticker) AS n FROM g WHERE fate = 'sent'),
r AS (SELECT chain, n, ticker, ts, 'sent' AS fate, MAP {{ticker: ts}} AS sent, cycle AS taken FROM k WHERE n = 1
  UNION ALL SELECT chain, n, ticker, ts, f, CASE WHEN f = 'sent' THEN map_concat(sent, MAP {{ticker: ts}}) ELSE sent END, CASE WHEN f = 'sent' THEN cycle ELSE taken END
  FROM (SELECT k.*, r.sent, r.taken, CASE WHEN k.ts < r.sent[k.ticker] + INTERVAL 8 HOUR THEN 'cooldown' WHEN k.mega AND r.taken = k.cycle THEN 'throttle' ELSE 'sent' END AS f
    FROM r JOIN k ON k.chain = r.chain AND k.n = r.n + 1)),
q AS (SELECT ticker, ts FROM r WHERE fate = 'sent')
SELECT ticker, cycle, mega, CASE WHEN EXISTS (SELECT 1 FROM q WHERE q.ticker = g.ticker AND q.ts < g.ts AND g.ts < q.ts + INTERVAL 8 HOUR) THEN 'cooldown' WHEN r.fate IS NOT NULL THEN r.fate ELSE g.fate END AS fate
FROM g LEFT JOIN r USING (ticker, ts)""")
def alert_history(spark, d):
    e = table(spark, d, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    scans = e.groupBy(F.concat(F.lit("c"), F.col("user_id") % 40).alias("ticker"), hour.alias("ts")).agg(
        F.max(0.5 + F.col("event_id") % 50 / 100).alias("confidence"), F.max(60.0 + F.col("event_id") % 40).alias("score"), F.max(F.col("value") * 3).alias("price")
    )
    scans = scans.withColumn("cycle", F.floor(F.unix_seconds("ts") / 3600))
    return signals.alert_history(scans, ("c1", "c2", "c3")).select("ticker", "cycle", "mega", "fate")


@query("cooldown", f"""WITH RECURSIVE e AS (SELECT DISTINCT event_type AS ticker, ts FROM events), s AS (SELECT ticker, min(ts) AS ts FROM e GROUP BY ticker
  UNION ALL SELECT n.ticker, n.ts FROM (SELECT s.ticker, (SELECT min(e.ts) FROM e WHERE e.ticker = s.ticker AND e.ts >= s.ts + INTERVAL 8 HOUR) AS ts FROM s) AS n WHERE n.ts IS NOT NULL)
SELECT ticker, {STAMP.format(c='ts')} FROM s""")
def cooldown(spark, d):
    found = signals.cooled_down(table(spark, d, "events").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts")))
    return shown(found)


@query("scan_universe", "SELECT symbol, min(priority)::BIGINT AS priority FROM (SELECT upper(event_type) AS symbol, user_id % 7 AS priority FROM events) GROUP BY symbol ORDER BY 2, 1 LIMIT 3")
def scan_universe(spark, d):
    found = table(spark, d, "events").select(F.upper("event_type").alias("symbol"), (F.col("user_id") % 7).alias("priority"))
    return signals.scan_universe(found, 3)


@query("universe_turn", """WITH q AS (SELECT 's' || (o_custkey % 23) AS symbol, min(o_orderkey % 7) AS priority FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY priority, symbol) - 1 AS place, count(*) OVER () AS size FROM q),
u AS (SELECT symbol, priority FROM q UNION ALL SELECT symbol, priority + 1000000 FROM n WHERE place // 5 = 7 % ceil(size / 5) UNION ALL SELECT 'SPY', 2000000)
SELECT symbol, min(priority)::BIGINT AS priority FROM u GROUP BY symbol ORDER BY 2, 1 LIMIT 30""")
def universe_turn(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    found = urgent.select(F.concat(F.lit("s"), F.col("o_custkey") % 23).alias("symbol"), (F.col("o_orderkey") % 7).alias("priority"))
    due = spark.range(1).select(F.lit(True).alias("beta"), F.lit(True).alias("benchmark"))
    return signals.scan_universe(found, 30, cycle=7, tiers=due)


@query("time_horizons", windowed_sql("""SELECT DISTINCT time_to_resolution AS bars, timeframe, CASE WHEN m < 60 THEN m || ' minutes' WHEN m < 1440 THEN round_even(m / 60, 0)::BIGINT || ' hours'
  WHEN m < 10080 THEN round_even(m / 1440, 0)::BIGINT || '-' || round_even(m / 1440 + 1, 0)::BIGINT || ' sessions' ELSE round_even(m / 10080, 0)::BIGINT || '-' || round_even(m / 10080 + 1, 0)::BIGINT || ' weeks' END AS horizon
FROM (SELECT time_to_resolution, timeframe, time_to_resolution * minutes AS m FROM lab, (VALUES ('1m', 1), ('5m', 5), ('15m', 15), ('1h', 60), ('4h', 240), ('1d', 1440), ('1w', 10080)) AS f(timeframe, minutes))""", OUTCOMES))
def time_horizons(spark, d):
    frames = F.explode(F.array(*(F.lit(x) for x in ("1m", "5m", "15m", "1h", "4h", "1d", "1w")))).alias("timeframe")
    rows = labelled(spark, d).select(F.col("time_to_resolution").alias("bars")).distinct().select("bars", frames)
    return rows.select("bars", "timeframe", signals.time_horizon(F.col("bars"), F.col("timeframe")).alias("horizon"))


@query("replay_timeline", windowed_sql(f"SELECT ticker, '1h' AS timeframe, k::INT AS index, {STAMP.format(c='start_time')}, {STAMP.format(c='end_time')}, {rounded('round_even(forward_return, 4)', 'forward_return')}, {rounded('round_even(max_drawdown, 4)', 'max_drawdown')}, outcome_label, NULL::VARCHAR AS volatility_profile, NULL::VARCHAR AS momentum_profile FROM lab WHERE k < 100", OUTCOMES))
def replay_timeline(spark, d):
    return shown(replay.timeline(labelled(spark, d)))


@query("regime_transitions", windowed_sql(f"SELECT ticker, '1h' AS timeframe, k::INT AS index, {STAMP.format(c='start_time')}, before AS from_label, outcome_label AS to_label FROM (SELECT *, lag(outcome_label) OVER (PARTITION BY ticker ORDER BY k) AS before FROM lab) WHERE before <> outcome_label", OUTCOMES))
def regime_transitions(spark, d):
    return shown(replay.transitions(labelled(spark, d)))


@query("count_patterns", windowed_sql("SELECT ticker, count(*)::BIGINT AS n FROM lab GROUP BY ticker", OUTCOMES))
def count_patterns(spark, d):
    return labelled(spark, d).groupBy("ticker").agg(F.count("*").alias("n"))


@query("scan")
def scan(spark, d):
    bars = smooth(spark, d)
    found = plans.scan(bars, plans.patterns_of(bars)).withColumn("alternatives", F.size("alternatives"))
    flat = found.select("query_id", "n_matches", "weighted_return", "win_rate", "sharpe", "echo_type", "confidence", "failure_rate", "failure_risk_score", "overall_confidence", "primary.label", "primary.probability", "primary.expected_return", "alternatives", "distribution.*", "score", "grade", "narrative")
    return shown(flat)


# --- the archive, stored results and the stream --------------------------------------------------------------------
def archived(spark: SparkSession, d: str) -> Archive:
    """Event bars in an archive, ingested in three parts: most, what came after, and every seventh hour of the first ten days, late."""
    bars = B.bars_events(table(spark, d, "events"))
    held_back = (F.col("ts") < "2024-01-11") & (F.floor(F.unix_seconds("ts") / 3600) % 7 == 3)
    archive = Archive(spark, shared_folder(spark, "archive"))
    for part in ((F.col("ts") < "2024-01-19") & ~held_back, F.col("ts") >= "2024-01-19", held_back):
        incremental.ingest(bars.where(part), archive)
    return archive


@query("archive_patterns", windowed_sql(f"SELECT {LABEL_SQL} FROM lab", OUTCOMES, "value"))
def archive_patterns(spark, d):
    """What three ingests with late bars have left is what one cut of all bars gives."""
    return shown(archived(spark, d).patterns("1h").select(*LABEL_COLUMNS))


@query("archive_counts", windowed_sql(f"SELECT ticker, count(*)::BIGINT AS n, {STAMP.format(c='first_time')} FROM (SELECT ticker, min(start_time) OVER (PARTITION BY ticker) AS first_time FROM lab) GROUP BY ticker, first_time", OUTCOMES, "value"))
def archive_counts(spark, d):
    """Counted from what the archive says of its ingests, without a look at patterns."""
    return shown(archived(spark, d).counts().drop("timeframe"))


def echo_sql(newest: str) -> str:
    """Results with a row a match, of windows (k < 0) beside the patterns' windows; `newest` selects which bars they are cut from."""
    groups = tuple(features.GROUPS)
    rolled = WINDOWS.replace("wb AS", "w0 AS")
    cut = f"""nb AS ({newest}), nw AS (SELECT *, row_number() OVER (PARTITION BY ticker, k ORDER BY ts DESC) AS r, count(*) OVER (PARTITION BY ticker, k) AS n FROM nb),
wb AS (SELECT ticker, ts, open, high, low, close, volume, k, i FROM w0 UNION ALL SELECT ticker, ts, open, high, low, close, volume, k, 60 - r FROM nw WHERE r <= 60 AND n >= 60)"""
    parts = []
    for g in groups:
        more, source, exprs = FEATURE_SQL[g]
        parts.append(f"g_{g} AS (WITH {more} SELECT ticker, k, {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {source} GROUP BY ticker, k)")
    slots = ", ".join(f"coalesce(({n})::DOUBLE, 0)" for n in SLOTS)
    joined = f"g_{groups[0]} {' '.join(f'JOIN g_{g} USING (ticker, k)' for g in groups[1:])}"
    return f"""WITH {bars_sql('value')}, {rolled}, {cut}, {', '.join(parts)}, {OUTCOMES},
fp AS (SELECT ticker, k, [{slots}] AS vector FROM {joined}), ends AS (SELECT ticker, k, max(ts) AS as_of FROM wb WHERE k < 0 GROUP BY ticker, k),
fz AS (SELECT ticker, k, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM fp), fs AS (SELECT ticker, k, avg(x) AS m, stddev_pop(x) + 1e-10 AS sd FROM fz GROUP BY ticker, k),
fn AS (SELECT ticker, k, i, (x - m) / sd AS x FROM fz JOIN fs USING (ticker, k)), fe AS (SELECT ticker, k, sum(x * x) AS e FROM fn GROUP BY ticker, k),
xc AS (SELECT a.ticker AS q, a.k AS qk, b.ticker, b.k, a.i - b.i AS lag, sum(a.x * b.x) AS dot FROM fn a, fn b WHERE a.k < 0 AND b.k >= 0 GROUP BY ALL),
xd AS (SELECT q, qk, xc.ticker, xc.k, greatest(0, least(1, max(dot) / (sqrt(any_value(u.e) * any_value(v.e)) + 1e-10))) AS dtw FROM xc JOIN fe u ON u.ticker = q AND u.k = qk JOIN fe v ON v.ticker = xc.ticker AND v.k = xc.k GROUP BY q, qk, xc.ticker, xc.k),
pr AS (SELECT q.ticker AS q, q.k AS qk, v.ticker, v.k, {COS} AS cosine, {EUC} AS euclidean FROM fp q, fp v WHERE q.k < 0 AND v.k >= 0),
sc AS (SELECT *, 0.5 * cosine + 0.3 * euclidean + 0.2 * dtw AS composite FROM pr JOIN xd USING (q, qk, ticker, k)),
tp AS (SELECT *, row_number() OVER (PARTITION BY q, qk ORDER BY composite DESC, ticker, k) AS first FROM sc WHERE composite >= 0.5 QUALIFY first <= 20),
sh AS (SELECT *, count(*) OVER (PARTITION BY q, qk, ticker) / count(*) OVER (PARTITION BY q, qk) AS share FROM tp),
rr AS (SELECT *, row_number() OVER (PARTITION BY q, qk ORDER BY composite + CASE WHEN share < 0.3 THEN 0.05 * (1 - share) ELSE 0 END DESC, first)::INT AS rank FROM sh),
mm AS (SELECT rr.*, lab.start_time, forward_return, max_drawdown FROM rr JOIN lab USING (ticker, k)),
sm AS (SELECT q, qk, count(*)::INT AS n_matches, min_by(composite, rank) AS similarity, greatest(0, least(1, 0.5 * min_by(composite, rank) + 0.3 * avg(composite) + 0.2 * (1 - least(stddev_pop(composite), 1)))) AS confidence,
  avg(forward_return) FILTER (rank <= 10) AS r, avg(max_drawdown) FILTER (rank <= 10) AS d, stddev_pop(forward_return) FILTER (rank <= 10) AS s FROM mm GROUP BY q, qk),
la AS (SELECT ticker AS q, max(k) AS qk FROM ends GROUP BY ticker)
SELECT q AS ticker, strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, n_matches, {ECHO_CASE} AS echo_type, {rounded('similarity', 'similarity')}, {rounded('confidence', 'confidence')},
  rank, mm.ticker AS match, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, {rounded('composite', 'composite')}, {rounded('forward_return', 'forward_return')}
FROM la JOIN sm USING (q, qk) JOIN mm USING (q, qk) JOIN ends ON ends.ticker = q AND ends.k = qk"""


def with_matches(found: DataFrame) -> DataFrame:
    """A row for each match of each result."""
    rows = found.select("ticker", "as_of", "n_matches", "echo_type", "similarity", "confidence", F.explode("matches").alias("m"))
    return shown(rows.select("ticker", "as_of", "n_matches", "echo_type", "similarity", "confidence", "m.rank", F.col("m.ticker").alias("match"), "m.start_time", "m.composite", "m.forward_return"))


@query("scan_results", echo_sql("SELECT *, -2 AS k FROM bars WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT *, -1 FROM bars WHERE ticker <> (SELECT min(ticker) FROM bars)"))
def scan_results(spark, d):
    """Two batches of results, the second, without one ticker, written twice; the newest of each series."""
    bars = B.bars_events(table(spark, d, "events"))
    archive = Archive(spark, shared_folder(spark, "archive"))
    incremental.ingest(bars, archive)
    path = shared_folder(spark, "results")
    results.write_results(incremental.echoes_of(bars.where("ts < '2024-01-20'"), archive), path, 0)
    least = bars.agg(F.min("ticker").alias("ticker"))
    for _ in range(2):
        results.write_results(incremental.echoes_of(bars.join(least, "ticker", "left_anti"), archive), path, 1)
    return with_matches(results.latest(results.read_results(spark, path)))


@query("streamed_scan", echo_sql("SELECT *, -1 AS k FROM bars"))
def streamed_scan(spark, d):
    """Bars as a stream of four files, scanned batch by batch against the archive; the newest result of each series."""
    bars = B.bars_events(table(spark, d, "events"))
    archive = Archive(spark, shared_folder(spark, "archive"))
    incremental.ingest(bars, archive)
    source, out = shared_folder(spark, "bars"), shared_folder(spark, "stream")
    bars.repartitionByRange(4, "ts").write.parquet(source)
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = live.scan_stream(stream, out, lambda s: archive.patterns("1h")).trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return with_matches(results.latest(results.read_results(spark, f"{out}/results")))


@query("scan_records")
def scan_records(spark, d):
    """JSON of each series' whole scan; no SQL, since engines write numbers differently: tests hold it against Python's rounding."""
    bars = smooth(spark, d)
    return plans.scan_records(bars, plans.patterns_of(bars), method="hierarchical").select("ticker", "record")


@query("pattern_records", windowed_sql(f"""SELECT ticker, k::BIGINT AS k, {{'ticker': ticker, 'start_time': strftime(start_time, '%Y-%m-%dT%H:%M:%S'), 'outcome_label': outcome_label, 'time_to_resolution': time_to_resolution}}::JSON::VARCHAR AS record FROM lab""", OUTCOMES))
def pattern_records(spark, d):
    """The unrounded fields of stored patterns as JSON records."""
    fields = tuple(f for f in records.PATTERN if f[0] in ("ticker", "start_time", "outcome_label")) + (("time_to_resolution", "time_to_resolution"),)
    return labelled(spark, d).select("ticker", F.col("k").cast("long").alias("k"), records.as_json(fields).alias("record"))


@query("ingest_counts", windowed_sql("SELECT ticker, count(*)::BIGINT AS n_rows, count(DISTINCT start_time)::BIGINT AS n_ids FROM lab GROUP BY ticker", OUTCOMES))
def ingest_counts(spark, d):
    """Patterns as they would be stored, with the ids that keep a second ingest from counting twice."""
    found = store.with_ids(labelled(spark, d).withColumn("window_size", F.lit(60)))
    return found.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.count_distinct("pattern_id").alias("n_ids"))


@query("synthetic_bars")
def synthetic_bars(spark, d):
    return B.synthetic_bars(spark, ["AAA", "BBB"], 200, "volatile")
