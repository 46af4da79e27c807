"""Benchmark passages in training documents, found by winnowing.

Of the hashes of a text's `gram`-word grams, winnowing keeps those that are the
least of some window of `window` words (all of equal ones), about two in
window-gram+2.  What is kept depends on the window's words alone, so a window
that documents and benchmark share keeps the same gram at the same place in
both, and joining the fingerprints finds it.  A hit is then extended: the words
around both grams, which travel with the fingerprints, are compared for every
window that holds the gram.  An item with fewer words than a window is one
window of its own length and its own fingerprint.

Documents are read once.  While the benchmark has at most `broadcast_prints`
fingerprints they are broadcast, and a bit table of their hashes lets hardly any
other fingerprint of a document pass; what does is joined and compared in the
same stage without a shuffle.  Beyond that both sides are shuffled by
fingerprint, with what has to be compared, and joined there.  Either way only
hits and one row a document are grouped.

Edge cases: null or empty text has no words and is not contaminated; items
without words have no window; equal passages of several items name all of them;
repeated rows are judged one by one; a long text costs in proportion to its
length; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table

#: What lies between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PRINT = "array<struct<length:int,hash:bigint,start:int,near:array<string>>>"


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased; in a text of ASCII alone that is the plain lower case."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(fold_ascii(text), BETWEEN), "")


def with_grams(df: DataFrame, window: int, gram: int) -> DataFrame:
    """`grams`, the hash at each place of `words`, and `least`, the least hash of each window."""
    size, across = F.size("words"), window - gram + 1
    none = F.array().cast("array<bigint>")
    hashed = F.transform(F.sequence(F.lit(0), size - gram), lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(gram))))
    df = df.withColumn("grams", F.when(size >= window, hashed).otherwise(none))
    lowest = F.transform(F.sequence(F.lit(0), size - window), lambda i: F.least(*(F.get("grams", i + j) for j in range(across)))) if across > 1 else F.col("grams")
    return df.withColumn("least", F.when(size >= window, lowest).otherwise(none))


def print_of(length: int, hashed: Column, i: Column, first: int, last: int) -> Column:
    """One fingerprint; near has the words from `first` to before `last` after place i, null outside the text.

    Words are taken one by one, since a slice costs as much as the whole array.
    """
    near = F.array(*(F.get("words", i + j) for j in range(first, last)))
    return F.struct(F.lit(length).alias("length"), hashed.alias("hash"), i.alias("start"), near.alias("near"))


def sieve(hashes: list[int], least: int = 1 << 14) -> Callable[[Column], Column]:
    """A test that all of these hashes pass and few others: one bit of a literal for each, at most about a 64th of them set."""
    words = max(least // 64, 1 << len(hashes).bit_length())
    bits = [0] * words
    for h in hashes:
        bits[(h >> 6) & (words - 1)] |= 1 << (h & 63)
    signed = ",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)
    table_ = F.from_json(F.lit(f"[{signed}]"), "array<bigint>")

    def passes(x: Column) -> Column:
        word = F.get(table_, F.shiftright(x, 6).bitwiseAND(words - 1).cast("int"))
        return F.getbit(word, x.bitwiseAND(63).cast("int")) == 1

    return passes


def everything(x: Column) -> Column:
    return F.lit(True)


def winnowed(window: int, gram: int, passes: Callable[[Column], Column] = everything) -> Column:
    """Fingerprints of a row with_grams that pass, with the words of all windows around."""
    across = window - gram + 1

    def kept(x: Column, i: Column) -> Column:
        over = [F.get("least", i - j) for j in range(across)]
        return F.when(((F.greatest(*over) if across > 1 else over[0]) == x) & passes(x), print_of(window, x, i, 1 - across, window))

    return F.filter(F.transform("grams", kept), lambda p: p.isNotNull()).cast(PRINT)


def whole_prints(length: int, passes: Callable[[Column], Column] = everything) -> Column:
    """Fingerprints of all windows of `length` words that pass, as items of so few words have them."""
    hashed = lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(length)))
    every = F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda i: F.when(passes(hashed(i)), print_of(length, hashed(i), i, 0, length)))
    every = F.filter(every, lambda p: p.isNotNull())
    return F.when(F.size("words") >= length, every).otherwise(F.array()).cast(PRINT)


def benchmark_prints(items: DataFrame, window: int, gram: int, item_id: str, text: str) -> DataFrame:
    """(item, length, hash, near) of all items."""
    found = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text).cast("string")).alias("words"))
    found = with_grams(found.where(F.size("words") > 0), window, gram)
    prints = winnowed(window, gram)
    for length in range(1, window):
        prints = F.when(F.size("words") == length, whole_prints(length)).otherwise(prints)
    return found.select("item", F.explode(prints).alias("p")).select("item", "p.length", "p.hash", "p.near").distinct()


def shared_starts(window: int, gram: int) -> Column:
    """Starts of the document windows around a gram that the benchmark has too, by comparing words."""
    found = []
    for k in range(window - gram + 1):
        # Where the k-th window before the gram begins in `near`; shorter windows have nothing before them.
        at = F.when(F.col("length") == window, F.lit(window - gram - k)).when(F.lit(k == 0), F.lit(0))
        last = at + F.col("length") - 1
        whole = F.get("near", at).isNotNull() & F.get("near", last).isNotNull()
        same = F.slice("near", at + 1, F.col("length")) == F.slice("known", at + 1, F.col("length"))
        found.append(F.when(at.isNotNull() & whole & same, F.col("start") - k))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    gram: int = 6,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_prints: int = 100_000,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items): words inside benchmark windows, and the items found, sorted as strings."""
    if not 0 < gram <= window:
        raise ValueError("a gram has between 1 and `window` words")
    # Written once: its expressions, one set for each length of items, are the dearest here to plan and compile.
    prints = settled(benchmark_prints(benchmark, window, gram, item_id, item_text))
    sizes = {r["length"]: r["n"] for r in prints.groupBy("length").agg(F.count("*").alias("n")).collect()}
    known = prints.groupBy("length", "hash", F.col("near").alias("known")).agg(F.collect_set("item").alias("items"))
    few = sum(sizes.values()) <= broadcast_prints
    # One more row meets the row that each document sends for itself; where both sides are shuffled that row keeps a place of its own.
    itself = docs.sparkSession.range(1).select(F.lit(0).alias("length"), F.lit(0).cast("bigint").alias("hash"), F.lit(None).cast("array<string>").alias("known"), F.array().cast("array<string>").alias("items"))
    known = known.unionByName(itself) if few else known
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text).cast("string")).alias("words"))
    rows = with_grams(rows.withColumn("n_words", F.greatest(F.size("words"), F.lit(0))), window, gram)
    place = F.lit(0).cast("bigint") if few else F.xxhash64("row")
    own = F.array(F.struct(F.lit(0).alias("length"), place.alias("hash"), F.lit(-1).alias("start"), F.array().cast("array<string>").alias("near"))).cast(PRINT)
    passes = sieve([r["hash"] for r in prints.select("hash").distinct().collect()]) if few else everything
    every = F.concat(own, winnowed(window, gram, passes), *(whole_prints(n, passes) for n in sorted(sizes) if n < window))
    # The list is never empty; the outer form keeps Spark from testing that with a second copy of all expressions.
    sent = rows.select("row", "doc_id", "n_words", F.explode_outer(every).alias("p"))
    sent = sent.select("row", "doc_id", "n_words", "p.*")
    met = sent.join(F.broadcast(known), ["length", "hash"]) if few else sent.join(known.hint("merge"), ["length", "hash"], "left")
    met = met.withColumn("starts", shared_starts(window, gram)).where((F.col("start") < 0) | (F.size("starts") > 0))
    grouped = met.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("start") >= 0, F.struct("starts", "length"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("start") >= 0, F.col("items")))))).alias("items"),
    )
    inside = F.flatten(F.transform("places", lambda p: F.flatten(F.transform(p["starts"], lambda s: F.sequence(s, s + p["length"] - 1)))))
    return grouped.select("doc_id", "n_words", F.size(F.array_distinct(inside)).cast("long").alias("n_hit"), "items")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "list_filter(string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format(t="text")} AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""
}
