"""How far apart the word use of sources is, from joint histograms of their counts.

A language's vocabulary is the terms in at least `min_docs` of its documents.  A
group (language and source) gives each of them a smoothed share in parts per
`SCALE`, so two groups are compared by a sum over the whole vocabulary, most of
which neither may hold.  The summand depends on nothing but the two counts.  So
for each pair of groups the distinct (count, count) combinations are tallied and
the summand is evaluated once for each, times its multiplicity.  Terms that both
hold come from a join on the term; terms that one or none of them holds are
never listed: their cells follow from each group's own histogram and the size
of the vocabulary, less what the pair shares.

All arithmetic is on integers.  Terms are counted in blocks inside the tasks, so
what is shuffled is the distinct terms of a block and not its words.

Edge cases: null texts, languages and sources are empty strings; a row is a
document whatever its id, so repeated rows count; a group without a kept term
has shares like any other, and a language without vocabulary is at distance 0
from itself throughout; ties go by name; texts of any length are taken whole;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import scratch, table

SCALE = 1_000_000_000
#: Bytes that are in no term: all of ASCII but letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
TERMS = "lang string, source string, term string, n long, docs long"


def block_terms(block: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a block's groups, and for each group a row without a term."""
    data, offsets = ta.buffers(block.column("text"))
    data = ta.lower_ascii(data)
    starts, ends, rows = ta.word_spans(data, offsets, _BETWEEN)
    words = ta.word_array(data, starts, ends).dictionary_encode()
    names = [block.column(c).dictionary_encode() for c in ("lang", "source")]
    lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
    groups, group = np.unique(lang * len(names[1].dictionary) + source, return_inverse=True)
    size = max(len(words.dictionary), 1)
    row = np.repeat(np.arange(len(group)), np.diff(rows))
    each, n = np.unique(row * size + words.indices.to_numpy().astype(np.int64), return_counts=True)
    found, at = np.unique(group[each // size] * size + each % size, return_inverse=True)
    occurs, docs = np.bincount(at, n, len(found)).astype(np.int64), np.bincount(at, minlength=len(found))
    of = np.append(groups[found // size], groups)
    none = len(groups)
    term = words.dictionary.take(pa.array(found % size)).cast(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            names[0].dictionary.take(pa.array(of // len(names[1].dictionary))),
            names[1].dictionary.take(pa.array(of % len(names[1].dictionary))),
            pa.concat_arrays([term, pa.nulls(none, pa.string())]),
            pa.array(np.append(occurs, np.zeros(none, np.int64))),
            pa.array(np.append(docs, np.zeros(none, np.int64))),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a null term marks the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in ta.blocks(batch, "text", 16 << 20):
                yield block_terms(block)
            ta.release()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))]
    found = docs.select(*named).mapInArrow(run, TERMS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, whole, head): the kept terms of each group, with the language's count; `head` marks one row of each term."""
    of_term = Window.partitionBy("lang", "term")
    kept = counts.where("term IS NOT NULL").withColumns({"in_docs": F.sum("docs").over(of_term), "whole": F.sum("n").over(of_term), "number": F.row_number().over(of_term.orderBy("source"))})
    return kept.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "whole", (F.col("number") == 1).alias("head"))


def share(count: str, total: str, size: str) -> Column:
    """Smoothed parts per SCALE of a count, rounded down, from 1; decimals hold what longs do not."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {size} AS DECIMAL(20, 0))")


def apart(p: str, q: str) -> Column:
    """The summand: squared difference over sum, rounded down."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def rows_of(names: str, *rows: str) -> Column:
    """Several rows for each, given as SQL tuples of the named columns."""
    names = names.split()
    fields = [", ".join(f"{v} AS {n}" for n, v in zip(names, r.split(", "))) for r in rows]
    return F.inline(F.expr(f"array({', '.join(f'struct({f})' for f in fields)})")).alias(*names)


def cells(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, one, two, a, b, terms): how many terms of the vocabulary have count a in group one and b in group two, zeros included."""
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    left = kept.select("lang", "term", F.col("source").alias("one"), F.col("n").alias("a"))
    right = kept.select("lang", "term", F.col("source").alias("two"), F.col("n").alias("b"))
    both = left.join(right, ["lang", "term"]).where("one < two").groupBy("lang", "one", "two", "a", "b").agg(F.count("*").alias("terms"))
    # What both hold is taken from each group's own histogram, and what either holds from the vocabulary.
    shared = both.select("lang", "one", "two", rows_of("a b terms", "a, b, terms", "a, 0L, -terms", "0L, b, -terms", "0L, 0L, terms"))
    first = pairs.join(own.withColumnRenamed("source", "one"), ["lang", "one"]).select("lang", "one", "two", rows_of("a b terms", "n, 0L, terms", "0L, 0L, -terms"))
    second = pairs.join(own.withColumnRenamed("source", "two"), ["lang", "two"]).select("lang", "one", "two", rows_of("a b terms", "0L, n, terms", "0L, 0L, -terms"))
    none = pairs.select("lang", "one", "two", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("size").alias("terms"))
    tally = shared.unionByName(first).unionByName(second).unionByName(none)
    return tally.groupBy("lang", "one", "two", "a", "b").agg(F.sum("terms").alias("terms")).where("terms > 0")


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of each group.

    part `pair`: every other source of the language by distance; part `term`:
    the `top` kept terms that the group uses more than its language does.
    """
    if min_docs < 1 or top < 1:
        raise ValueError("min_docs and top are at least 1")
    spark = docs.sparkSession
    at = scratch(spark, "term-counts")
    term_counts(docs, text, lang, source).write.parquet(at)
    counts = spark.read.schema(TERMS).parquet(at)
    at = scratch(spark, "vocabulary")
    vocabulary(counts, min_docs).write.parquet(at)
    kept = spark.read.schema("lang string, source string, term string, n long, whole long, head boolean").parquet(at)

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("head").alias("heads"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("heads", F.lit(0)).alias("heads"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("size"))
    groups = groups.join(langs, "lang").select("lang", "source", "total", "lang_total", "size")

    left = groups.select("lang", "size", F.col("source").alias("one"), F.col("total").alias("total_one"))
    right = groups.select("lang", F.col("source").alias("two"), F.col("total").alias("total_two"))
    pairs = left.join(right, "lang").where("one < two")
    tally = cells(kept, pairs.select("lang", "one", "two", "size")).join(pairs, ["lang", "one", "two"])
    tally = tally.withColumns({"p": share("a", "total_one", "size"), "q": share("b", "total_two", "size")})
    sums = tally.groupBy("lang", "one", "two").agg(F.sum(apart("p", "q") * F.col("terms")).alias("value"))
    sums = pairs.select("lang", "one", "two").join(sums, ["lang", "one", "two"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    ways = rows_of("source item", "one, two", "two, one")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pairs = sums.select("lang", "value", ways).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    used = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "size"), "q": share("whole", "lang_total", "size")}).where("p > q")
    used = used.select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    of_terms = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return of_pairs.unionByName(of_terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {
    "op11_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
z AS (SELECT g.lang, count(v.term)::HUGEINT AS size, coalesce(sum(whole), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN v ON g.lang = v.lang GROUP BY ALL),
s AS (SELECT t.lang, t.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * z.size) AS p,
    1 + (1000000000::HUGEINT * (v.whole + 2)) // (z.total + 2 * z.size) AS q
  FROM t JOIN z ON t.lang = z.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = v.term),
m AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
o AS (SELECT lang, source, 'pair' AS part, item, value FROM m
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM s WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= 10"""
}
