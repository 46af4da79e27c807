"""What filters remove in every order of them, by walking the trie of their permutations.

Orders that share a prefix share a path of the trie, and prefixes with the same
filters leave the same rows, so of n! orders there are 2^n states.  The walk is
depth first.  A state's survivors are a persisted DataFrame, made by applying
one filter to those of the state above; at each state the rows that every
further filter removes are counted in one aggregate, which is what the edges out
of the state show.  A state met again by another prefix is not entered a second
time.  When all below a state is done its rows are let go, so at most n+1 are
held at once, and each can be made again from the written flags if an executor
is lost.

The counts of edges go to a table in the shared folder; the report of all orders
is a join with it, so nothing that grows with rows or parts meets in the driver.

Edge cases: null texts and parts are empty strings; a null id is never smaller
or greater than another, so such rows are no copies; rows that repeat an id and
its text are not copies of each other; several labels of an id count if one of
them does; parts that a state leaves empty count 0; other columns are ignored;
no rows give no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, scratch, table

EDGES = "part string, state string, filter string, n long, removed long, good_lost long, toxic_lost long"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by itself."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    return {
        "words": words,
        "A": n < 50,
        "B": distinct.cast("long") * 100 < n.cast("long") * 65,
        "C": F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each row, written to the shared folder.

    E is for texts that a smaller id has too.  The first id of each text is
    looked up by text and id together, so copies do not meet in one task.
    """
    spark = docs.sparkSession
    of = text_conditions(F.col("text"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", of.pop("words")).select("doc_id", "part", *(c.alias(k) for k, c in of.items()), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    at = scratch(spark, "filter-flags")
    rows.write.parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = rows.where("doc_id IS NOT NULL").join(first, ["doc_id", "digest"], "left").withColumn("E", F.col("first").isNull())
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = marked.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    names = ["part", *"ABCDE", "good", "toxic"]
    without = rows.where("doc_id IS NULL").select("part", *"ABCD", F.lit(False).alias("E"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    made = marked.select(*names).unionByName(without)
    to = scratch(spark, "filter-rows")
    made.write.parquet(to)
    drop_folder(spark, at)
    return spark.read.schema(made.schema).parquet(to)


def edge_counts(survivors: DataFrame, state: str, ahead: list[str]) -> DataFrame:
    """Rows of EDGES: what each further filter removes from a state's survivors."""
    sums = [F.count("*").alias("n")]
    for f in ahead:
        sums += [F.count_if(f).alias(f"removed_{f}"), F.count_if(F.col(f) & F.col("good")).alias(f"good_{f}"), F.count_if(F.col(f) & F.col("toxic")).alias(f"toxic_{f}")]
    edges = [F.struct(F.lit(f).alias("filter"), F.col(f"removed_{f}").alias("removed"), F.col(f"good_{f}").alias("good_lost"), F.col(f"toxic_{f}").alias("toxic_lost")) for f in ahead]
    found = survivors.groupBy("part").agg(*sums).select("part", F.lit(state).alias("state"), "n", F.inline(F.array(*edges)))
    return found.select("part", "state", "filter", "n", "removed", "good_lost", "toxic_lost")


def walked(rows: DataFrame, filters: list[str]) -> DataFrame:
    """The edges of the permutation trie with what they removed; rows: (part, filters, good, toxic)."""
    spark = rows.sparkSession
    at = scratch(spark, "filter-edges")
    seen: set[frozenset] = set()

    def enter(done: frozenset, survivors: DataFrame) -> None:
        seen.add(done)
        ahead = [f for f in filters if f not in done]
        edge_counts(survivors, "".join(f for f in filters if f in done), ahead).write.mode("append").parquet(at)
        for f in ahead:
            # Past the last filter nothing is left to count.
            if len(ahead) > 1 and done | {f} not in seen:
                below = survivors.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
                enter(done | {f}, below)
                below.unpersist()

    enter(frozenset(), rows)
    return spark.read.schema(EDGES).parquet(at)


def all_orders(filters: list[str]) -> list[tuple]:
    """(order, step, filter, state): each filter of each order with those before it."""
    return [("".join(o), i + 1, f, "".join(g for g in filters if g in o[:i])) for o in permutations(filters) for i, f in enumerate(o)]


def filter_audit(rows: DataFrame, filters: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order.

    rows: one a document, with `part`, a boolean for each filter that says that
    it fails, `good` and `toxic`.  Filters have names of one letter.
    """
    if not filters or any(len(f) != 1 for f in filters) or len({*filters}) < len(filters):
        raise ValueError("filters have different names of one letter")
    spark, n = rows.sparkSession, len(filters)
    edges = walked(rows, filters)
    # In how many orders the filters of a state stand before this one and all others behind it.
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n))), F.length("state") + 1)
    alone = F.length("state") == n - 1
    by_filter = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == "", F.col("removed")).otherwise(0)).alias("failing"), F.sum(F.when(alone, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley")
    )
    # The first state has all parts.
    parts = edges.where("state = ''").select("part").distinct()
    orders = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(i).alias("step"), F.lit(f).alias("filter"), F.lit(s).alias("state")) for o, i, f, s in all_orders(filters)))
    found = parts.select("part", F.inline(orders)).join(edges, ["part", "state", "filter"], "left").join(by_filter, ["part", "filter"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.select(
        "part", "filter_order", "step", (zero("n") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("failing") - zero("removed")).alias("redundant"), "unique_fails", zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), "shapley"
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit(rows, [*"ABCDE"])


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {
    "op13_filter_audit": """
WITH l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT d.*, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > least, false)::INT AS m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(name, bit)),
o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.name || b.name || c.name || d.name || e.name AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step, bits FROM o),
t AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM s),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & before > 0 AND m & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g CROSS JOIN t GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
}
