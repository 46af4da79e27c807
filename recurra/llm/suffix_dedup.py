"""Repeated byte strings through a logarithmic family of suffix arrays.

A batch's suffix array holds the suffixes that begin at anchors, in byte order.
The anchor of a string of `length` bytes is the place in it where its `gram`
bytes have the least hash, so equal strings have equal anchors and about two in
length-gram+2 suffixes are kept.  An entry has the suffix's first `gram` bytes,
a hash of the text around (all strings of `length` bytes with this anchor, its
context) and the earliest place.  Byte ranges of suffixes are buckets, the same
for all arrays of a family.

1. Each part of a batch sorts its suffixes; its runs are sorted already when
   they meet in their buckets and are merged there with the runs of all levels.
   Neighbours with a common prefix of `gram` bytes may belong to long matches: a
   context that is known from an earlier place repeats as a whole, and suffixes
   with several contexts are left open.
2. Levels of equal size are merged into one of twice the size, so n batches keep
   at most log2(n)+1 levels and rewrite each entry log2(n) times.  A level keeps
   the earliest place of each context.
3. When all batches are in, parts send the text around their open suffixes.  It
   meets by suffix, and all its strings of `length` bytes are sorted in byte
   order; of neighbours that are equal over the whole length all but the earliest
   are repeats.  Where a suffix has very many contexts, strings are dealt by
   their own hash, of equal ones a part sends the earliest place alone and
   settles the others itself, so a group has one place a part for each string.
4. The repeated stretches go back to the documents.

Batches are appended in order of document ids, so what a level holds is always
earlier than what comes in.  A byte is removed if it is covered by a string of
`length` bytes that also starts earlier, in a document with a smaller id or
earlier in the same one.

Edge cases: null text is empty; rows shorter than `length` lose nothing; a null
id comes first; rows repeating an id are one document as far as order goes and
are not removed on account of each other; a long text is worked off in
overlapping pieces; further columns are ignored.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .bodies import by_part, changes, cut, ids_of, leads, merged, pack, sorted_rows, spread, squeeze, unpack, unpack_all
from .common import drop_folder, part_of, scratch, table, text_parts

BLOCK = 1 << 19
HOT_CONTEXT = np.uint64(0)
DUPLICATE, OPEN, HOT = 1, 2, 3
SCANNED = "kind int, bucket int, part int, body binary"
ANSWER, LEVEL = 0, 1
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


@dataclass(frozen=True)
class Shape:
    """What a family is made of; travels to the tasks.  bounds: the least suffix of each bucket but the first."""

    length: int
    gram: int
    bounds: np.ndarray
    contexts: int = 64  # distinct contexts of a suffix in a part before it is hot
    carry: tuple[str, ...] = ()  # columns that go along to the results
    whole: bool = False  # leave out what is left of a character that was cut

    @property
    def buckets(self) -> int:
        return len(self.bounds) + 1

    @property
    def entry(self) -> tuple:
        return f"S{self.gram}", np.uint64, np.int64, np.int64

    def rows(self, part: pa.Table) -> pa.Table:
        return sorted_rows(part, ["doc_id", "text", *self.carry])


def strings_at(raw: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes from each place, as fixed strings that compare in byte order."""
    views = np.lib.stride_tricks.sliding_window_view(raw, size) if len(raw) >= size else np.zeros((0, size), np.uint8)
    return np.ascontiguousarray(views[places]).view(f"S{size}").ravel()


def string_hash(strings: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each fixed string."""
    n, size = len(strings), strings.dtype.itemsize
    padded = np.zeros((n, -(-size // 8) * 8), np.uint8)
    padded[:, :size] = strings.view(np.uint8).reshape(n, size)
    out = np.zeros(n, np.uint64)
    for column in padded.view("<u8").T:
        out = ta.mix64(out ^ column.astype(np.uint64))
    return out


def order_keys(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffix, context and place as one fixed string each, so that one comparison orders entries."""
    n, size = len(gram), gram.dtype.itemsize
    out = np.empty((n, size + 24), np.uint8)
    out[:, :size] = np.ascontiguousarray(gram).view(np.uint8).reshape(n, size)
    signed = np.ascontiguousarray(doc).view(np.uint64) ^ np.uint64(1 << 63)
    for i, column in enumerate((context, signed, first)):
        out[:, size + 8 * i : size + 8 * i + 8] = column.astype(">u8").view(np.uint8).reshape(n, 8)
    return out.view(f"S{size + 24}").ravel()


def common_prefix(strings: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted string and the one before it."""
    n, size = len(strings), strings.dtype.itemsize
    out = np.zeros(n, np.int64)
    letters = strings.view(np.uint8).reshape(n, size)
    differ = letters[1:] != letters[:-1]
    out[1:] = np.where(differ.any(1), differ.argmax(1), size)
    return out


def blocks(rows: pa.Table):
    """Blocks of a part's texts: (first row, bytes, offsets)."""
    at = 0
    for batch in rows.combine_chunks().to_batches():
        for block in ta.blocks(batch, "text", BLOCK):
            raw, offsets = ta.buffers(block.column("text"))
            yield at, raw, offsets
            at += block.num_rows


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int):
    """A block, or a long text in pieces that overlap by length-1 bytes: (bytes, offsets, place of the piece)."""
    if len(offsets) > 2 or len(raw) <= 2 * BLOCK:
        yield raw, offsets, 0
        return
    for at in range(0, len(raw) - length + 1, BLOCK):
        piece = raw[at : at + BLOCK + length - 1]
        yield piece, np.array([0, len(piece)]), at


def suffixes(shape: Shape, rows: pa.Table):
    """The suffix array of a part: (gram, context, doc, first, count, row) in byte order, with where contexts are new and places the earliest.

    An entry stands for the `count` strings of `length` bytes from byte `first` of its row on, all those with this anchor.
    """
    ids = ids_of(rows)
    kinds = (*shape.entry, np.int64, np.int64)
    cols: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for at, raw, offsets in blocks(rows):
        for piece, bounds, shift in pieces(raw, offsets, shape.length):
            r = ta.Runs(ta.BYTES.table[piece], bounds, shape.length, shape.gram)
            row = r.row + at
            found = (strings_at(piece, r.anchor, shape.gram), r.context, ids[row], r.first - bounds[r.row] + shift, r.count, row)
            for c, x in zip(cols, found):
                c.append(x)
    gram, context, doc, first, count, row = (np.concatenate(c) for c in cols)
    order = np.argsort(order_keys(gram, context, doc, first), kind="stable")
    gram, context, doc, first, count, row = (x[order] for x in (gram, context, doc, first, count, row))
    head = changes(gram, context)
    lead = leads(head)
    return gram, context, doc, first, count, row, head, (doc == doc[lead]) & (first == first[lead])


def suffix_array(shape: Shape, key: tuple, part: pa.Table) -> pa.Table:
    """A part's sorted run for each bucket: one entry per distinct context, or one per suffix with very many."""
    gram, context, doc, first, _, _, head, _ = suffixes(shape, shape.rows(part))
    gram, context, doc, first = (x[head] for x in (gram, context, doc, first))
    if len(gram):
        heads = np.flatnonzero(changes(gram))
        sizes = np.diff(np.append(heads, len(gram)))
        hot = np.repeat(sizes > shape.contexts, sizes)
        keep = ~hot
        keep[heads] = True
        gram, context, doc, first = (x[keep] for x in (gram, np.where(hot, HOT_CONTEXT, context), doc, first))
    edges = [0, *np.searchsorted(gram, shape.bounds, "left").tolist(), len(gram)]
    own = [(b, slice(a, z)) for b, (a, z) in enumerate(zip(edges, edges[1:])) if a < z]
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in own], pa.int32()),
            "part": pa.array([key[0].as_py()] * len(own), pa.int32()),
            "body": pa.array([squeeze(gram[s], context[s], doc[s], first[s]) for _, s in own], pa.binary()),
        }
    )


def judge(gram, context, doc, first, part, contexts: int):
    """(part, gram, context, state) of merged entries whose suffix is met more than once."""
    fresh = common_prefix(gram) < gram.dtype.itemsize
    fresh[:1] = True
    new_run = fresh | changes(context)
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, len(gram)))
    if not len(heads):
        return part, gram, context, np.zeros(0, np.uint8)
    variety = np.repeat(np.add.reduceat(new_run.astype(np.int64), heads), sizes)
    hot = np.repeat(np.logical_or.reduceat(context == HOT_CONTEXT, heads), sizes) | (variety > 16 * contexts)
    lead = leads(new_run)
    earliest = (doc == doc[lead]) & (first == first[lead])
    state = np.where(hot, HOT, np.where(~earliest, DUPLICATE, np.where(variety > 1, OPEN, 0))).astype(np.uint8)
    keep = state > 0
    return part[keep], gram[keep], np.where(hot, HOT_CONTEXT, context)[keep], state[keep]


def merge_scan(shape: Shape, keep: bool, key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
    """A bucket's new runs merged with all levels: answers, and with `keep` the level that comes of those that grow."""
    columns, sizes = unpack_all(new.column("body"), *shape.entry, squeezed=True)
    part = np.repeat(new.column("part").to_numpy(), sizes).astype(np.int32)
    held, sizes = unpack_all(old.column("body"), *shape.entry, np.int32, squeezed=True)
    grows = np.concatenate((np.ones(len(part), np.int32), np.repeat(old.column("grows").to_numpy(), sizes).astype(np.int32)))
    every = [np.concatenate(x) for x in zip((*columns, part), held)]
    # All runs are sorted: a stable sort finds and merges them.
    order = np.argsort(order_keys(*every[:4]), kind="stable")
    *every, grows = (x[order] for x in (*every, grows))
    told_part, gram, context, state = judge(*every, shape.contexts)
    told = by_part(told_part, gram, context, state)
    kinds, parts, bodies = [ANSWER] * told.num_rows, told.column("part").to_pylist(), told.column("body").to_pylist()
    if keep:
        level = [x[grows > 0] for x in every]
        kept = changes(level[0], level[1])
        kinds.append(LEVEL)
        parts.append(-1)
        bodies.append(squeeze(*(x[kept] for x in level)))
    return pa.table(
        {
            "kind": pa.array(kinds, pa.int32()),
            "bucket": pa.array([key[0].as_py()] * len(kinds), pa.int32()),
            "part": pa.array(parts, pa.int32()),
            "body": pa.array(bodies, pa.binary()),
        }
    )


def equal_before(strings, doc, start):
    """An order by string and place, and in it where an equal string starts earlier."""
    order = np.lexsort((start, doc, strings))
    strings, doc, start = strings[order], doc[order], start[order]
    lead = leads(changes(strings))
    return order, (doc != doc[lead]) | (start != start[lead])


def runs_in_blocks(rows: pa.Table, row, first, *more):
    """Runs, in order of rows, with the block that they are in: (bytes, places in it, then the columns)."""
    order = np.lexsort((first, row))
    columns = [x[order] for x in (row, first, *more)]
    for at, raw, offsets in blocks(rows) if len(row) else ():
        a, b = np.searchsorted(columns[0], [at, at + len(offsets) - 1])
        if a < b:
            own = [c[a:b] for c in columns]
            yield raw, offsets[own[0] - at] + own[1], *own


def hot_strings(shape: Shape, rows: pa.Table, row, first, count, doc):
    """(hash, row, start, again) of the strings of a part's hot suffixes; again: the string starts earlier in this part."""
    cols: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (f"S{shape.length}", np.int64, np.int64, np.int64)]
    for raw, place, r, f, n, d in runs_in_blocks(rows, row, first, count, doc):
        found = (strings_at(raw, spread(place, n), shape.length), np.repeat(d, n), np.repeat(r, n), spread(f, n))
        for c, x in zip(cols, found):
            c.append(x)
    strings, doc, row, start = (np.concatenate(c) for c in cols)
    order, again = equal_before(strings, doc, start)
    return string_hash(strings[order]), row[order], start[order], again


def contents(shape: Shape, key: tuple, part: pa.Table, replies: pa.Table) -> pa.Table:
    """Repeated runs of a part as stretches, and the text of its open ones."""
    rows = shape.rows(part)
    (rg, rc, rs), _ = unpack_all(replies.column("body"), f"S{shape.gram}", np.uint64, np.uint8)
    gram, context, doc, first, count, row, _, earliest = suffixes(shape, rows)
    own = string_hash(gram)
    asked = string_hash(rg)
    state = np.zeros(len(gram), np.uint8)
    both = lambda g, c: ta.mix64(g ^ ta.mix64(c + np.uint64(0x1234567)))
    for what, wanted, mine in ((OPEN, both(asked, rc), both(own, context)), (HOT, asked, own), (DUPLICATE, both(asked, rc), both(own, context))):
        ids = np.sort(wanted[rs == what])
        if len(ids) and len(mine):
            at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
            state[ids[at] == mine] = what
    whole = ~earliest | (state == DUPLICATE)
    # Rows that repeat an id and have the same run at the same place are all sent: what else they hold may differ.
    opened = ~whole & (state > 0)
    hot = opened & (state == HOT)
    wh, wr, wf, again = hot_strings(shape, rows, row[hot], first[hot], count[hot], doc[hot])
    r = np.concatenate((row[whole], wr[again]))
    a = np.concatenate((first[whole], wf[again]))
    b = np.concatenate((first[whole] + count[whole] - 1, wf[again])) + shape.length
    out_bucket, out_kind, out_body = [], [], []
    if len(r):
        out_bucket.append(-1 - key[0].as_py())
        out_kind.append(0)
        out_body.append(pack(*merged(r.astype(np.int64), a, b)))
    plain, wh, wr, wf = opened & ~hot, wh[~again], wr[~again], wf[~again]
    by = np.concatenate((own[plain], wh))
    sent = (np.concatenate((row[plain], wr)), np.concatenate((first[plain], wf)), np.concatenate((count[plain], np.ones(len(wr), np.int64))))
    ids = ids_of(rows)
    for raw, place, r, f, n, k in runs_in_blocks(rows, *sent, by):
        bucket = (k % np.uint64(shape.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        for x, s in cut(bucket[order]):
            i = order[s]
            head = pack(k[i], ids[r[i]], r[i].astype(np.int64), f[i], n[i].astype(np.int64))
            out_bucket.append(x)
            out_kind.append(1)
            out_body.append(len(i).to_bytes(8, "little") + head + raw[spread(place[i], n[i] - 1 + shape.length)].tobytes())
    return pa.table(
        {
            "bucket": pa.array(out_bucket, pa.int32()),
            "part": pa.array([key[0].as_py()] * len(out_bucket), pa.int32()),
            "kind": pa.array(out_kind, pa.int32()),
            "body": pa.array(out_body, pa.binary()),
        }
    )


def long_matches(shape: Shape, bucket: pa.Table) -> pa.Table:
    """Strings of a bucket that also start earlier, as stretches by part."""
    parts, bodies = [], []
    cols: list[list] = [[] for _ in range(7)]
    for kind, part, body in zip(*(bucket.column(c).to_pylist() for c in ("kind", "part", "body"))):
        if kind == 0:
            parts.append(part)
            bodies.append(body)
            continue
        n = int.from_bytes(body[:8], "little")
        found = unpack(body[8 : 8 + 40 * n], np.uint64, np.int64, np.int64, np.int64, np.int64)
        for c, x in zip(cols, (*found, np.full(n, part), np.frombuffer(body, np.uint8, -1, 8 + 40 * n))):
            c.append(x)
    told: list[list[np.ndarray]] = [[], [], []]
    if cols[0]:
        by, doc, row, first, count, part, raw = (np.concatenate(c) for c in cols)
        sizes = count - 1 + shape.length
        place = np.cumsum(sizes) - sizes
        order = np.argsort(by, kind="stable")
        by, doc, row, first, count, part, place = (x[order] for x in (by, doc, row, first, count, part, place))
        # Equal strings have one suffix or hash in common, so some of these at a time are enough.
        heads = np.flatnonzero(changes(by))
        before = np.append(0, np.cumsum(count))[np.append(heads, len(by))]
        at = 0
        while at < len(heads):
            end = max(at + 1, int(np.searchsorted(before, before[at] + (1 << 17), "right")) - 1)
            s = slice(heads[at], heads[end] if end < len(heads) else len(by))
            n = count[s]
            strings, start = strings_at(raw, spread(place[s], n), shape.length), spread(first[s], n)
            order, again = equal_before(strings, np.repeat(doc[s], n), start)
            for c, x in zip(told, (np.repeat(part[s], n), np.repeat(row[s], n), start)):
                c.append(x[order][again])
            at = end
        part, row, start = (np.concatenate(c) for c in told)
        order = np.argsort(part, kind="stable")
        part, row, start = part[order], row[order], start[order]
        for p, s in cut(part):
            parts.append(p)
            bodies.append(pack(*merged(row[s], start[s], start[s] + shape.length)))
    return pa.table({"part": pa.array(parts, pa.int32()), "body": pa.array(bodies, pa.binary())})


def results(shape: Shape, part: pa.Table, replies: pa.Table) -> pa.Table:
    """What is left of each row."""
    rows = shape.rows(part)
    (row, start, end), _ = unpack_all(replies.column("body"), np.int64, np.int64, np.int64)
    row, start, end = merged(row, start, end)
    n_bytes, n_removed, spans, kept = [], [], [], []
    for at, raw, offsets in blocks(rows):
        view = memoryview(raw)
        edges = np.searchsorted(row, np.arange(at, at + len(offsets)))
        for i in range(len(offsets) - 1):
            base, size, gone, rest, last = int(offsets[i]), int(offsets[i + 1] - offsets[i]), [], [], 0
            for x, y in zip(start[edges[i] : edges[i + 1]].tolist(), end[edges[i] : edges[i + 1]].tolist()):
                gone.append({"start": x, "end": y})
                rest.append(view[base + last : base + x])
                last = y
            rest.append(view[base + last : base + size])
            n_bytes.append(size)
            n_removed.append(sum(g["end"] - g["start"] for g in gone))
            spans.append(gone)
            left = b"".join(rest)
            kept.append(left.decode("utf-8", "ignore").encode() if shape.whole else left)
    return pa.table(
        {
            "doc_id": rows.column("doc_id"),
            "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()),
            **{c: rows.column(c) for c in shape.carry},
        }
    )


def released(made: pa.Table) -> pa.Table:
    ta.release()
    return made


def suffix_bounds(docs: DataFrame, buckets: int, length: int, gram: int, text: str = "text", each: int = 200) -> np.ndarray:
    """The least suffixes of all buckets but the first, from about `each` distinct beginnings of suffixes a bucket.

    Rows are drawn at random, whatever they say, and of beginnings that copies share one counts; where so many are
    copies that too few are left, more rows are drawn, all of them at last.  The driver gets four times `each` a bucket at most.
    """
    total, wanted = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0, buckets * each
    share = min(1.0, wanted * (length - gram + 2) / 2 / max(int(total), 1))

    def run(batches):
        for batch in batches:
            for block in ta.blocks(batch, "text", BLOCK):
                raw, offsets = ta.buffers(block.column("text"))
                for piece, bounds, _ in pieces(raw, offsets, length):
                    r = ta.Runs(ta.BYTES.table[piece], bounds, length, gram)
                    # Every so many of a piece, so that long texts don't fill the sample.
                    few = np.unique(strings_at(piece, r.anchor[:: max(1, len(r.anchor) // 100)], gram))
                    yield pa.RecordBatch.from_arrays([pa.array([x.ljust(gram, b"\0") for x in few.tolist()], pa.binary())], ["found"])
            ta.release()

    chosen = docs.select(F.col(text).cast("string").alias("text")).where(F.octet_length("text") >= length)
    while True:
        drawn = chosen if share >= 1 else chosen.where(F.rand(17) < share)
        several = drawn.mapInArrow(run, "found binary").distinct().orderBy(F.xxhash64("found"), "found").limit(4 * wanted)
        sample = np.sort(np.array([bytes(r[0]) for r in several.collect()], f"S{gram}"))
        if share >= 1 or len(sample) >= wanted / 4:
            break
        share = min(1.0, share * max(4.0, wanted / max(len(sample), 1)))
    cuts = sample[(np.arange(1, buckets) * len(sample)) // buckets] if len(sample) else sample
    return np.unique(cuts)


class SuffixLevels:
    """Levels of suffix arrays in the shared folder, and what was found so far.

    `parts` is the number of parts a batch is dealt into, `bounds` are those of
    the buckets; both are fixed for the family.
    """

    def __init__(self, spark: SparkSession, parts: int, bounds: np.ndarray, length: int = 100, gram: int = 24, **more):
        if not 0 < gram <= length:
            raise ValueError("a gram has between 1 and `length` bytes")
        self.spark = spark
        self.parts = parts
        self.shape = Shape(length, gram, bounds.astype(f"S{gram}"), **more)
        self.levels: list[tuple[int, str]] = []  # (batches in it, folder), largest first
        self.found: list[str] = []
        self.placed: list[DataFrame] = []

    def append(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> None:
        """Add a batch whose ids are not below those already held.

        Without `keep`, for a last batch, it is only scanned against the levels.
        """
        shape, base = self.shape, len(self.placed) * self.parts
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *shape.carry)
        rows = rows.withColumn("part", part_of("doc_id", self.parts) + base)
        self.placed.append(rows)
        build = lambda key, part: released(suffix_array(shape, key, part))
        array = rows.repartition(self.parts, "part").groupBy("part").applyInArrow(build, "bucket int, part int, body binary")
        size, grown = 1, []
        while keep and self.levels and self.levels[-1][0] == size:
            grown.append(self.levels.pop())
            size *= 2
        old = [self._level(path, 0) for _, path in self.levels] + [self._level(path, 1) for _, path in grown]
        known = reduce(DataFrame.unionByName, old, self.spark.createDataFrame([], "bucket int, grows int, body binary"))
        run = lambda key, new, had: released(merge_scan(shape, keep, key, new, had))
        met = array.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, SCANNED)
        path = scratch(self.spark, "suffix-level")
        met.write.partitionBy("kind").parquet(path)
        self.found.append(path)
        if keep:
            self.levels.append((size, path))
        del array, known, old, met
        for _, folder in grown:
            drop_folder(self.spark, f"{folder}/kind={LEVEL}")
        self._release()

    def _level(self, path: str, grows: int) -> DataFrame:
        rows = self.spark.read.schema(SCANNED).parquet(path).where(F.col("kind") == LEVEL)
        return rows.select("bucket", F.lit(grows).alias("grows"), "body")

    def _release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of the finished batch."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        """Delete the levels; what was found stays."""
        for _, path in self.levels:
            drop_folder(self.spark, f"{path}/kind={LEVEL}")
        self.levels = []

    def results(self) -> DataFrame:
        """(doc_id, n_bytes, n_removed, spans, kept) of all appended rows; spans are byte positions."""
        shape = self.shape
        told = [self.spark.read.schema(SCANNED).parquet(p).where(F.col("kind") == ANSWER) for p in self.found]
        told = reduce(DataFrame.unionByName, told).select("part", "body")
        rows = reduce(DataFrame.unionByName, self.placed)
        placed = rows.repartition(len(self.placed) * self.parts, "part")
        send = lambda key, part, known: released(contents(shape, key, part, known))
        meet = lambda bucket: released(long_matches(shape, bucket))
        close = lambda part, known: released(results(shape, part, known))
        sent = placed.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(send, "bucket int, part int, kind int, body binary")
        again = sent.groupBy("bucket").applyInArrow(meet, "part int, body binary")
        kinds = [f", `{c}` {placed.schema[c].dataType.simpleString()}" for c in shape.carry]
        return placed.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(close, RESULT + "".join(kinds))


def batch_number(docs: DataFrame, doc_id: str, batches: int) -> Column:
    """Which of `batches` consecutive id ranges of about equal size a row is in."""
    cuts = docs.stat.approxQuantile(doc_id, [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    number = F.lit(0)
    for x in sorted(set(cuts)):
        number = number + F.when(F.col(doc_id) > int(x), 1).otherwise(0)
    return F.coalesce(number, F.lit(0))


def remove_repeated_strings(
    docs: DataFrame,
    length: int = 100,
    gram: int = 24,
    batches: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
    part_bytes: int = 4 << 20,
    carry: tuple[str, ...] = (),
    whole: bool = False,
    contexts: int = 64,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of a whole table, appended in `batches` id ranges.

    kept is binary: removed stretches may begin or end inside a character, whose
    other bytes go too with `whole`.  The columns of `docs` that `carry` names, plain ones that sort, come after.
    """
    parts = text_parts(docs, text, part_bytes)
    bounds = suffix_bounds(docs, parts, length, gram, text)
    levels = SuffixLevels(docs.sparkSession, -(-parts // batches), bounds, length, gram, carry=carry, whole=whole, contexts=contexts)
    number = batch_number(docs, doc_id, batches)
    for i in range(batches):
        levels.append(docs.where(number == i), doc_id, text, keep=i < batches - 1)
    levels.close()
    return levels.results()


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_strings(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
ORACLES = {
    "op10_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i FROM d)),
f AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
j AS (SELECT *, coalesce(i > lag(i) OVER w + 100, true) AS fresh FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM j) GROUP BY doc_id, n),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM r GROUP BY doc_id),
q AS (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS x, a AS y FROM q),
k AS (SELECT e.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x, y) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""
}
