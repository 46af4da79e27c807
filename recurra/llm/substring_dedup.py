"""Repeated word spans through a compacted De Bruijn graph.

Every window of `length` words is an edge between the nodes of `length`-1 words
at its two ends.  Consecutive edges of a document that share a minimiser (the
least hash of `gram` words in them) are a path by themselves, cut at the same
places wherever its words stand; so most of the graph is compacted before
anything is shuffled:

1. Each part of the corpus sends its distinct paths, by minimiser.  Where a
   minimiser has one path alone, nothing branches, and all but the earliest
   place of the path repeat as a whole.  Where it has several, parts send the
   single edges of these paths; of equal edges of a minimiser with very many
   paths a part sends the earliest alone and settles the others itself.
2. Edges that occur more than once are the graph: equal edges are grouped, and
   nodes get their degrees.  A node with one edge in and one out, both with as
   many occurrences and next to each other in their earliest source, doesn't
   branch; the edges around it are linked.
3. Links compact in rounds of joins: each edge is joined with the one that it
   points to and takes over its pointer and distance, so a path of n edges is
   one after log2(n) rounds, each written to the shared folder.
4. Every occurrence is held against the source coordinates of its path, and
   those that start later are the repeated spans that go back to the documents.

Paths and edges are equal if their words are: both are compared by cryptographic
128-bit digests of the words themselves, those at the source coordinates and those
of each occurrence alike, before anything is removed.  The rolling hashes choose
minimisers and name nodes, which decides where work is done and nothing more.

Edge cases: null text has no words; documents shorter than a window lose
nothing; a null id comes first; rows repeating an id are one document as far as
order goes and are not removed on account of each other; a long text is worked
off in overlapping pieces; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .bodies import by_part, changes, cut, ids_of, leads, merged, pack, sorted_rows, spread, unpack_all
from .common import drop_folder, let_go, part_of, scratch, table, text_parts

BLOCK = 1 << 19
#: Minimiser, both halves of a path's digest, document, first edge.
ENTRY = (np.uint64, np.uint64, np.uint64, np.int64, np.int64)
HOT_PATH = np.uint64(0)
DUPLICATE, OPEN, HOT = 1, 2, 3
#: Settled stretches have no edge; edges end where they start.
FOUND = "part int, row int, start int, end int, doc long, one long, two long, source long, target long"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


@dataclass(frozen=True)
class Shape:
    """What one search is made of; travels to the tasks."""

    length: int
    gram: int
    buckets: int
    contexts: int  # distinct paths of a minimiser in a part before it is hot

    def rows(self, part: pa.Table) -> pa.Table:
        return sorted_rows(part, ["doc_id", "text"])


def blocks(rows: pa.Table):
    """Blocks of a part: (first row, bytes, starts and ends of words, word offsets of rows)."""
    at = 0
    for batch in rows.combine_chunks().to_batches():
        for block in ta.blocks(batch, "text", BLOCK):
            data, offsets = ta.buffers(block.column("text"))
            yield at, data, *ta.word_spans(data, offsets)
            at += block.num_rows


def pieces(values: np.ndarray, offsets: np.ndarray, length: int):
    """A block's word hashes, or those of a long text in pieces that overlap by length-1 words: (hashes, offsets, place)."""
    if len(offsets) > 2 or len(values) <= BLOCK:
        yield values, offsets, 0
        return
    for at in range(0, len(values) - length + 1, BLOCK // 2):
        piece = values[at : at + BLOCK // 2 + length - 1]
        yield piece, np.array([0, len(piece)]), at


def part_paths(shape: Shape, rows: pa.Table):
    """Paths of a part: (minimiser, digest in halves, doc, first edge, edges, row), sorted, with where paths are new and places the earliest."""
    ids = ids_of(rows)
    cols: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in (*ENTRY, np.int64, np.int64)]
    for at, data, starts, ends, offsets in blocks(rows):
        text, bounds_of = ta.spaced(data, starts, ends)
        for piece, bounds, shift in pieces(ta.word_hashes(data, starts, ends), offsets, shape.length):
            r = ta.Runs(piece, bounds, shape.length, shape.gram)
            row, head = r.row + at, r.first + shift
            one, two = ta.digests(text, bounds_of[head], bounds_of[head + r.count + shape.length - 1] - 1)
            # Where the minimiser stands in it is part of a path: windows are cut into paths around it.
            one = one ^ ta.mix64((r.anchor - r.first).astype(np.uint64) << np.uint64(32) | r.count.astype(np.uint64))
            for c, x in zip(cols, (r.key, one, two, ids[row], r.first - bounds[r.row] + shift, r.count, row)):
                c.append(x)
    key, one, two, doc, first, count, row = (np.concatenate(c) for c in cols)
    order = np.lexsort((first, doc, two, one, key))
    key, one, two, doc, first, count, row = (x[order] for x in (key, one, two, doc, first, count, row))
    head = changes(key, one, two)
    lead = leads(head)
    return key, one, two, doc, first, count, row, head, (doc == doc[lead]) & (first == first[lead])


def path_entries(shape: Shape, key: tuple, part: pa.Table) -> pa.Table:
    """One entry per distinct path of the part, or one per minimiser with very many, by bucket."""
    k, c, c2, doc, first, _, _, head, _ = part_paths(shape, shape.rows(part))
    k, c, c2, doc, first = (x[head] for x in (k, c, c2, doc, first))
    if len(k):
        heads = np.flatnonzero(changes(k))
        sizes = np.diff(np.append(heads, len(k)))
        hot = np.repeat(sizes > shape.contexts, sizes)
        keep = ~hot
        keep[heads] = True
        k, c, c2, doc, first = (x[keep] for x in (k, np.where(hot, HOT_PATH, c), np.where(hot, HOT_PATH, c2), doc, first))
    bucket = (k % np.uint64(shape.buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    k, c, c2, doc, first = (x[order] for x in (k, c, c2, doc, first))
    slices = cut(bucket[order])
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in slices], pa.int32()),
            "part": pa.array([key[0].as_py()] * len(slices), pa.int32()),
            "body": pa.array([pack(k[s], c[s], c2[s], doc[s], first[s]) for _, s in slices], pa.binary()),
        }
    )


def branches(shape: Shape, bucket: pa.Table) -> pa.Table:
    """For each part: which of its paths repeat as a whole, and which belong to a minimiser with several."""
    (k, c, c2, doc, first), sizes = unpack_all(bucket.column("body"), *ENTRY)
    part = np.repeat(bucket.column("part").to_numpy(), sizes)
    order = np.lexsort((first, doc, c2, c, k))
    k, c, c2, doc, first, part = (x[order] for x in (k, c, c2, doc, first, part))
    state = np.zeros(0, np.uint8)
    if len(k):
        fresh = changes(k, c, c2)
        heads = np.flatnonzero(changes(k))
        sizes = np.diff(np.append(heads, len(k)))
        variety = np.repeat(np.add.reduceat(fresh.astype(np.int64), heads), sizes)
        hot = np.repeat(np.logical_or.reduceat((c == HOT_PATH) & (c2 == HOT_PATH), heads), sizes) | (variety > 16 * shape.contexts)
        lead = leads(fresh)
        later = (doc != doc[lead]) | (first != first[lead])
        state = np.where(hot, HOT, np.where(later, DUPLICATE, np.where(variety > 1, OPEN, 0))).astype(np.uint8)
    keep = state > 0
    return by_part(part[keep], k[keep], c[keep], c2[keep], state[keep])


def hashes_of(values: np.ndarray, text: np.ndarray, bounds: np.ndarray, begin: np.ndarray, length: int):
    """(one, two, source, target) of the edges that begin at these words: a digest of their words, and the names of both nodes."""
    prefix = ta.SEQ.prefix(values)
    one, two = ta.digests(text, bounds[begin], bounds[begin + length] - 1)
    return one, two, ta.SEQ.spans(prefix, begin, begin + length - 1), ta.SEQ.spans(prefix, begin + 1, begin + length)


def states_of(k: np.ndarray, c: np.ndarray, c2: np.ndarray, known: tuple[np.ndarray, ...]) -> np.ndarray:
    """The state that the replies (minimiser, digest, state) give each path; a hot minimiser's holds for all its paths."""
    rk, rc, rc2, rs = known
    columns = [np.append(a, b) for a, b in ((rk, k), (rc, c), (rc2, c2))]
    order = np.lexsort(columns[::-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(changes(*(x[order] for x in columns))) - 1
    told = np.zeros(len(order), np.uint8)
    told[number[: len(rk)]] = np.where(rs == HOT, 0, rs)
    return np.where(np.isin(k, rk[rs == HOT]), np.uint8(HOT), told[number[len(rk) :]])


def part_edges(shape: Shape, key: tuple, part: pa.Table, replies: pa.Table) -> pa.Table:
    """Rows of FOUND: stretches of the part that are settled, and the single edges of paths that are not."""
    rows = shape.rows(part)
    known, _ = unpack_all(replies.column("body"), np.uint64, np.uint64, np.uint64, np.uint8)
    k, c, c2, doc, first, count, row, _, earliest = part_paths(shape, rows)
    state = states_of(k, c, c2, known)
    whole = ~earliest | (state == DUPLICATE)
    # Rows that repeat an id and have the same path at the same place are all sent: what else they hold may differ.
    opened = ~whole & (state > 0)
    order = np.lexsort((first[opened], row[opened]))
    of = [x[opened][order] for x in (row, first, count, doc, state == HOT)]
    cols: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (*[np.uint64] * 4, np.int64, np.int64, np.int64, bool)]
    for at, data, starts, ends, offsets in blocks(rows) if len(order) else ():
        a, b = np.searchsorted(of[0], [at, at + len(offsets) - 1])
        if a == b:
            continue
        values = ta.word_hashes(data, starts, ends)
        r, f, n, d, h = (x[a:b] for x in of)
        text, bounds = ta.spaced(data, starts, ends)
        found = hashes_of(values, text, bounds, spread(offsets[r - at] + f, n), shape.length)
        for col, x in zip(cols, (*found, np.repeat(d, n), np.repeat(r, n), spread(f, n), np.repeat(h, n))):
            col.append(x)
    one, two, source, target, doc_e, row_e, start, hot = (np.concatenate(x) for x in cols)
    order = np.lexsort((start, doc_e, two, one))
    one, two, source, target, doc_e, row_e, start, hot = (x[order] for x in (one, two, source, target, doc_e, row_e, start, hot))
    lead = leads(changes(one, two))
    again = hot & hot[lead] & ((doc_e != doc_e[lead]) | (start != start[lead]))
    r, a, b = merged(
        np.concatenate((row[whole], row_e[again])),
        np.concatenate((first[whole], start[again])),
        np.concatenate((first[whole] + count[whole] - 1, start[again])) + shape.length,
    )
    sent = ~again
    n, m = len(r), int(sent.sum())
    null = lambda x: pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x[sent].view(np.int64))])
    return pa.table(
        {
            "part": pa.array(np.full(n + m, key[0].as_py()), pa.int32()),
            "row": pa.array(np.concatenate((r, row_e[sent])), pa.int32()),
            "start": pa.array(np.concatenate((a, start[sent])), pa.int32()),
            "end": pa.array(np.concatenate((b, start[sent])), pa.int32()),
            **{name: null(x) for name, x in (("doc", doc_e), ("one", one), ("two", two), ("source", source), ("target", target))},
        }
    )


def linked(edges: DataFrame) -> DataFrame:
    """(edge, next): pairs of edges around nodes that don't branch.

    edges: (edge, source, target, n, doc, start), all that occur more than once.
    """
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n_in"), F.first("edge").alias("edge"), F.first("n").alias("n"), F.first("doc").alias("doc"), F.first("start").alias("start"))
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n_out"), F.first("edge").alias("next"), F.first("n").alias("m"), F.first("doc").alias("doc_"), F.first("start").alias("start_"))
    single = into.where("n_in = 1").join(out.where("n_out = 1"), "node")
    return single.where("n = m AND doc = doc_ AND start_ = start + 1 AND edge <> next").select("edge", "next")


def compacted(edges: DataFrame) -> DataFrame:
    """(edge, path, place): the first edge of each edge's path, and how many edges lie before it."""
    spark = edges.sparkSession
    links = linked(edges).select(F.col("next").alias("edge"), F.col("edge").alias("to"), F.lit(1).cast("long").alias("step"))
    # Every edge points back to the one before it; done once a round takes no pointer further.
    table_ = edges.select("edge").join(links, "edge", "left").select("edge", F.coalesce("to", "edge").alias("to"), F.coalesce("step", F.lit(0)).cast("long").alias("step"))
    path, reach = scratch(spark, "debruijn-paths"), None
    table_.write.parquet(path)
    while True:
        now = spark.read.schema("edge long, to long, step long").parquet(path)
        before, reach = reach, now.agg(F.sum("step")).first()[0]
        let_go(spark)  # the shuffle files of a round go with it
        if reach == before:
            return now.select("edge", F.col("to").alias("path"), F.col("step").alias("place"))
        far = now.select(F.col("edge").alias("to"), F.col("to").alias("further"), F.col("step").alias("more")).where("more > 0")
        ahead = now.join(far, "to", "left").select("edge", F.coalesce("further", "to").alias("to"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"))
        after = scratch(spark, "debruijn-paths")
        ahead.write.parquet(after)
        drop_folder(spark, path)
        path = after


def repeated_edges(found: DataFrame) -> DataFrame:
    """(edge, one, two, source, target, n, doc, start) of edges that occur more than once, with their earliest place."""
    edges = found.where("one IS NOT NULL").groupBy("one", "two").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("at"), F.first("source").alias("source"), F.first("target").alias("target")
    )
    return edges.where("n > 1").select(F.xxhash64("one", "two").alias("edge"), "one", "two", "source", "target", "n", "at.doc", "at.start")


def path_table(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, doc, start, n_edges, n): the compacted graph, each path with its earliest source and its occurrences."""
    heads = edges.select(F.col("edge").alias("path"), "doc", "start", "n")
    return paths.groupBy("path").agg((F.max("place") + 1).alias("n_edges")).join(heads, "path")


def results(shape: Shape, part: pa.Table, replies: pa.Table) -> pa.Table:
    """What is left of each row, words with one space between."""
    rows = shape.rows(part)
    row, start, end = merged(*(replies.column(c).to_numpy().astype(np.int64) for c in ("row", "start", "end")))
    n_words, n_removed, spans, kept = [], [], [], []
    for at, data, starts, ends, offsets in blocks(rows):
        text, bounds = ta.spaced(data, starts, ends)
        view = memoryview(text)
        edges = np.searchsorted(row, np.arange(at, at + len(offsets)))
        for i in range(len(offsets) - 1):
            base, size, gone, rest, last = int(offsets[i]), int(offsets[i + 1] - offsets[i]), [], [], 0
            own = [*zip(start[edges[i] : edges[i + 1]].tolist(), end[edges[i] : edges[i + 1]].tolist())]
            for x, y in (*own, (size, size)):
                if x > last:
                    rest.append(view[bounds[base + last] : bounds[base + x] - 1])
                last = y
            gone = [{"start": x, "end": y} for x, y in own]
            n_words.append(size)
            n_removed.append(sum(y - x for x, y in own))
            spans.append(gone)
            kept.append(b" ".join(rest).decode())
    return pa.table(
        {
            "doc_id": rows.column("doc_id"),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.string()),
        }
    )


def released(made: pa.Table) -> pa.Table:
    ta.release()
    return made


def remove_repeated_spans(
    docs: DataFrame, length: int = 20, gram: int = 8, doc_id: str = "doc_id", text: str = "text", part_bytes: int = 8 << 20, contexts: int = 64
) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): each row without the words of repeated windows.

    spans are the removed stretches in word positions; kept has the other words
    with one space between.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram has between 1 and `length` words")
    spark = docs.sparkSession
    shape = Shape(length, gram, text_parts(docs, text, part_bytes), contexts)
    placed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    placed = placed.withColumn("part", part_of("doc_id", shape.buckets)).repartition(shape.buckets, "part")
    send = lambda key, part: released(path_entries(shape, key, part))
    meet = lambda bucket: released(branches(shape, bucket))
    open_ = lambda key, part, known: released(part_edges(shape, key, part, known))
    close = lambda part, known: released(results(shape, part, known))
    told = placed.groupBy("part").applyInArrow(send, "bucket int, part int, body binary")
    told = told.groupBy("bucket").applyInArrow(meet, "part int, body binary")
    folder = scratch(spark, "debruijn-edges")
    placed.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(open_, FOUND).write.parquet(folder)
    del told
    let_go(spark)  # the shuffle files of this first half
    found = spark.read.schema(FOUND).parquet(folder)
    at = scratch(spark, "debruijn-graph")
    repeated_edges(found).write.parquet(at)
    edges = spark.read.parquet(at)
    paths = compacted(edges)
    head = edges.select(F.col("edge").alias("path"), F.col("doc").alias("path_doc"), F.col("start").alias("path_start"))
    sources = edges.select("edge", "one", "two").join(paths, "edge").join(head, "path")
    sources = sources.select("one", "two", "path", "place", "path_doc", "path_start")
    again = found.where("one IS NOT NULL").join(sources, ["one", "two"])
    # An occurrence repeats unless it is the path's source itself.
    again = again.where((F.col("doc") != F.col("path_doc")) | (F.col("start") != F.col("path_start") + F.col("place")))
    # Edges of one path that follow each other in a row are one span.
    again = again.groupBy("part", "row", "path", (F.col("start") - F.col("place")).alias("shift")).agg(F.sort_array(F.collect_list("start")).alias("starts"))
    gap = lambda i: (i == 0) | (F.get("starts", i) != F.get("starts", i - 1) + 1)
    cuts = F.filter(F.transform("starts", lambda x, i: F.when(gap(i), i)), lambda i: i.isNotNull())
    again = again.withColumn("cuts", cuts).select(
        "part", "row", F.explode(F.transform("cuts", lambda a, i: F.struct(F.get("starts", a).alias("start"), (F.get("starts", F.coalesce(F.get("cuts", i + 1), F.size("starts")) - 1) + length).alias("end")))).alias("s")
    )
    settled = found.where("one IS NULL").select("part", "row", "start", "end")
    replies = settled.unionByName(again.select("part", "row", "s.start", "s.end"))
    return placed.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(close, RESULT)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {
    "op5_substring_dedup": """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS g FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE r > 1),
a AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda j: gone IS NULL OR NOT list_contains(gone, j)), lambda j: words[j]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id"""
}
