"""SimHash fingerprints linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  If two differ
in at most three bits, then two of the three segments differ in at most one bit
each.  The perfect Golay code maps every 23-bit word to the index of the one
codeword within three bits, and the words around it to at most six indices; so
each fingerprint files itself under the index pair of every two segments and
looks under all pairs that neighbours of its segments decode to.  Equal keys are
joined and the true distance is checked in the join.

Where very many fingerprints file under one key, that key is left out of the
join and they are linked through shared points instead: two fingerprints within
three bits have a point within one bit of one and two of the other, and all
within one bit of a point are linked to the least of them, so the links grow
with the number of fingerprints and not with its square.

Edge cases: a text without words has fingerprint zero, which is linked like any
other; null text has no words; fewer than three words are one shingle; a
component's id is null if all its rows' ids are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .bodies import squeeze, stretched
from .common import checkpoint, drop_folder, scratch, settled, table

SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the [23,12] binary Golay code (a fixed value).
GENERATOR = 0xAE3


@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    index = np.arange(1 << 12, dtype=np.uint32)
    words = index << 11
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0)).astype(np.uint32)
    words = (index << 11) | words
    flips = [0]
    for _ in range(3):
        flips = sorted({x ^ (1 << b) for x in flips for b in range(23)} | set(flips))
    out = np.zeros(1 << 23, np.uint16)
    for flip in flips:
        out[words ^ np.uint32(flip)] = index
    return out


def fingerprints(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """One unsigned 64-bit SimHash per text of a block."""
    data, offsets = ta.buffers(column)
    starts, ends, rows = ta.word_spans(data, offsets)
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    owner = np.repeat(np.arange(n), np.diff(rows))
    keep = np.zeros(len(data) + 1, bool)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    keep[:-1] = np.cumsum(edge[:-1]) > 0
    joined = ta.lower_ascii(data)
    gaps = ends[ends < offsets[owner + 1]]
    joined = joined.copy()
    joined[gaps] = 0x20
    keep[gaps] = True
    shift = np.concatenate(([0], np.cumsum(keep[:-1])))
    view = joined[keep[:-1]].tobytes()
    starts, ends = shift[starts], shift[ends]
    last = np.minimum(np.arange(len(starts)) + shingle - 1, rows[1:][owner] - 1)
    first = np.flatnonzero((np.arange(len(starts)) + shingle <= rows[1:][owner]) | (np.arange(len(starts)) == rows[:-1][owner]))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(view[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last[first]].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whose = owner[first]
    heads = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
    counts = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    sizes = np.diff(np.append(heads, len(whose)))
    set_bits = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little")
    out[whose[heads]] = np.ascontiguousarray(set_bits).view("<u8").ravel()
    return out


def simhash(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, simhash): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in ta.blocks(batch, "text", 1 << 18):
                made = fingerprints(block.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(made)], ["doc_id", "simhash"])
            ta.release()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, simhash long")


def segment_keys(prints: np.ndarray, look: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key): where fingerprints file themselves, or all keys they look under."""
    table = decoder()
    near = []
    for low, size in SEGMENTS:
        word = (prints >> np.uint64(low)).astype(np.uint32) & np.uint32((1 << size) - 1)
        flips = np.array([0, *(1 << b for b in range(size))] if look else [0], np.uint32)
        keys = np.sort(table[word[:, None] ^ flips].astype(np.int64), axis=1)
        fresh = np.ones(keys.shape, bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        row, at = np.nonzero(fresh)
        near.append((row, keys[row, at], np.bincount(row, minlength=len(prints))))
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ra, ka, _), (rb, kb, nb) = near[a], near[b]
        starts = np.cumsum(nb) - nb
        times = nb[ra]
        row = np.repeat(ra, times)
        step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        yield row, (np.int64(pair) << 24) | (np.repeat(ka, times) << 12) | kb[starts[row] + step]


def key_rows(prints: DataFrame, look: bool) -> DataFrame:
    """(key, simhash) rows of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                own = batch.column(0)[i : i + 4096].to_numpy()
                for row, key in segment_keys(own.view(np.uint64), look):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], ["key", "simhash"])

    return prints.select("simhash").mapInArrow(run, "key long, simhash long")


def point_rows(prints: DataFrame) -> DataFrame:
    """(point, simhash, near): every point within two bits; near if within one."""
    single = [1 << b for b in range(64)]
    flips = [0, *single, *(single[a] | single[b] for a in range(64) for b in range(a))]
    masks = np.array(flips, np.uint64)
    close = np.arange(len(masks)) < 65

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                own = batch.column(0)[i : i + 16].to_numpy()
                points = (own.view(np.uint64)[:, None] ^ masks).view(np.int64).ravel()
                arrays = [pa.array(points), pa.array(np.repeat(own, len(masks))), pa.array(np.tile(close, len(own)))]
                yield pa.RecordBatch.from_arrays(arrays, ["point", "simhash", "near"])

    return prints.select("simhash").mapInArrow(run, "point long, simhash long, near boolean")


def close_pairs(prints: DataFrame, crowd: int = 512) -> DataFrame:
    """(u, v), u > v: links that join every two fingerprints within three bits, directly or through others.

    prints has distinct `simhash` values.  Keys under which more than `crowd`
    file are linked through shared points.
    """
    filed, sought = key_rows(prints, False), key_rows(prints, True)
    full = filed.groupBy("key").count().where(F.col("count") > crowd).select("key")
    full = checkpoint(full)
    crowded = not full.isEmpty()
    if crowded:
        dense = sought.join(full, "key", "left_semi").select("simhash").distinct()
        filed, sought = filed.join(full, "key", "left_anti"), sought.join(full, "key", "left_anti")
    a, b = filed.alias("a"), sought.alias("b")
    near = (F.col("a.simhash") < F.col("b.simhash")) & (F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))) <= 3)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & near)
    links = pairs.select(F.col("b.simhash").alias("u"), F.col("a.simhash").alias("v"))
    if crowded:
        points = point_rows(dense)
        middle = points.where("near").groupBy("point").agg(F.min("simhash").alias("v"))
        through = points.join(middle, "point").select(F.greatest("simhash", "v").alias("u"), F.least("simhash", "v").alias("v"))
        links = links.unionByName(through.where("u <> v"))
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): v is the least node that u > v is connected to; nodes that are least are left out.

    Alternating large-star and small-star rounds, each written to the checkpoint folder; what the driver and the
    shuffle files hold of a round goes with it.
    """
    edges = checkpoint(links)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, simhash, component_id): component_id is the least id reachable by links of at most three bits."""
    found = checkpoint(simhash(docs, shingle, doc_id, text))
    prints = checkpoint(found.groupBy("simhash").agg(F.min("doc_id").alias("least")))
    member = components(close_pairs(prints, crowd))
    root = prints.join(member.withColumnRenamed("u", "simhash"), "simhash", "left")
    root = checkpoint(root.select("simhash", "least", F.coalesce("v", "simhash").alias("root")))
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root.join(ids, "root").select("simhash", "component_id")
    return found.join(named, "simhash").select("doc_id", "simhash", "component_id")


#: Counters that tell frequent shingles, by the upper bits of their hashes, and the bits of a set's parities.
COUNTERS, PARITIES = 1 << 21, 1024


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text of a block, sorted; a text of fewer words is one shingle."""
    data, offsets = ta.buffers(column)
    data = ta.lower_ascii(data)
    starts, ends, rows = ta.word_spans(data, offsets)
    words = ta.word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.arange(len(words))
    first = np.flatnonzero((at + shingle <= rows[1:][owner]) | (at == rows[:-1][owner]))
    last = np.minimum(first + shingle, rows[1:][owner[first]])
    hashes = ta.SEQ.spans(ta.SEQ.prefix(words), first, last)
    order = np.lexsort((hashes, owner[first]))
    hashes, whose = hashes[order], owner[first][order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (whose[1:] != whose[:-1])
    return hashes[fresh], np.append(0, np.cumsum(np.bincount(whose[fresh], minlength=len(rows) - 1)))


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def usual(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts fall to each counter."""
    size = COUNTERS // 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for block in ta.blocks(batch, "text", 1 << 19):
                np.add.at(made, counter_of(shingle_sets(block.column("text"), shingle)[0]), np.uint32(1))
            ta.release()
        parts = [(i, squeeze(made[i * size : (i + 1) * size])) for i in range(32) if made[i * size : (i + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["slice", "body"])

    def add(group: pa.Table) -> pa.Table:
        made = np.zeros(size, np.uint32)
        for body in group.column("body").to_pylist():
            made += np.frombuffer(stretched(body), np.uint32)
        return pa.table({"slice": group.column("slice")[:1], "body": pa.array([made.tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(count, "slice int, body binary").groupBy("slice").applyInArrow(add, "slice int, body binary").toArrow()
    out = np.zeros((32, size), np.uint32)
    for i, body in zip(found.column("slice").to_pylist(), found.column("body").to_pylist()):
        out[i] = np.frombuffer(body, np.uint32)
    return out.ravel()


def set_prints(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, same, size, simhash, bits, keys) of each text's set of shingles.

    same is a hash of the set, bits has a parity of each of its parts, keys the
    first shingles of it, rare ones before frequent ones: so many that no set as
    like as `similarity` is without one of them among its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(usual(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in batches:
            for block in ta.blocks(batch, "text", 1 << 19):
                hashes, offsets = shingle_sets(block.column("text"), shingle)
                n, rows = np.diff(offsets), block.num_rows
                owner = np.repeat(np.arange(rows), n)
                total = np.append(np.uint64(0), np.cumsum(ta.mix64(hashes + np.uint64(1)), dtype=np.uint64))
                same = ta.mix64(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64))
                odd = np.bincount(owner * PARITIES + (hashes % np.uint64(PARITIES)).astype(np.int64), minlength=rows * PARITIES) & 1
                bits = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
                prints, full = np.zeros(rows, np.uint64), np.flatnonzero(n)
                if len(full):
                    flags = np.unpackbits(ta.mix64(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    counts = np.add.reduceat(flags, offsets[full], axis=0, dtype=np.int32)
                    prints[full] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little").view("<u8").ravel()
                order = np.lexsort((hashes, counters[counter_of(hashes)], owner))
                lead = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
                keys = hashes[order][np.arange(len(hashes)) - offsets[:-1][owner] < lead[owner]].view(np.int64)
                lists = (pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (PARITIES // 64)), pa.array(bits)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lead)).astype(np.int32)), pa.array(keys)))
                arrays = [block.column("doc_id"), pa.array(same.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(prints.view(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "same", "size", "simhash", "bits", "keys"])
            ta.release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, same long, size int, simhash long, bits array<long>, keys array<long>")


def may_be_alike(similarity: float) -> Column:
    """Whether sets with these sizes and parities can be as like as that: a shingle of one set alone turns one parity."""
    apart = sum((F.bit_count(F.get("bits_u", F.lit(i)).bitwiseXOR(F.get("bits_v", F.lit(i)))) for i in range(PARITIES // 64)), F.lit(0))
    near = F.least("size_u", "size_v") + 1e-6 >= similarity * F.greatest("size_u", "size_v")
    return near & (apart <= (F.col("size_u") + F.col("size_v")) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def alike(sets: DataFrame, pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of shingle sets whose Jaccard similarity is `similarity` or more, by comparing the sets."""
    of = lambda name: sets.select(*(F.col(c).alias(f"{d}{name}") for c, d in (("same", ""), ("size", "size_"), ("bits", "bits_"), ("least", "doc_"))))
    few = settled(pairs.join(of("u"), "u").join(of("v"), "v").where(may_be_alike(similarity)).select("u", "v", "doc_u", "doc_v"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in ta.blocks(batch, "text", 1 << 19):
                hashes, offsets = shingle_sets(block.column("text"), shingle)
                made = pa.array([hashes[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([block.column("same"), made], ["same", "hashes"])
            ta.release()

    wanted = few.select(F.col("doc_u").alias("doc_id"), F.col("u").alias("same")).unionByName(few.select(F.col("doc_v").alias("doc_id"), F.col("v").alias("same"))).distinct()
    held = settled(texts.join(wanted, "doc_id").select("same", "text").mapInArrow(hashed, "same long, hashes binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["u", "v"])

    of = lambda name: held.select(F.col("same").alias(name), F.col("hashes").alias(f"hashes_{name}"))
    met = few.select("u", "v").join(of("u"), "u").join(of("v"), "v")
    return settled(met.select("u", "v", "hashes_u", "hashes_v").mapInArrow(compare, "u long, v long"))


def near_texts(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, beside: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, component_id) of documents that share `similarity` of their shingles, directly or through others.

    doc_id is a key of rows.  Texts with equal sets of shingles are one from the start.  Sets whose fingerprints lie
    within three bits are compared, and so is each set with the least one under each of its keys, which are its rarest
    shingles; then, `beside` times, with one drawn from each key that several groups still share.  That brings most
    groups together.  All pairs that are in different groups by then are searched in full: two sets as like as that share
    one of their keys, and at the first shared one, in the order of keys, both have enough shingles left.  So no link
    between groups is missed, whatever was found before.  Every link is held to the exact similarity of the sets.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    path = scratch(spark, "near-sets")
    set_prints(chosen, shingle, similarity).write.parquet(path)
    found = spark.read.parquet(path)
    whole = scratch(spark, "near-keys")
    found.groupBy("same").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "simhash", "bits", "keys"))).write.parquet(whole)
    found = settled(found.select("doc_id", "same"))
    drop_folder(spark, path)
    wide = spark.read.parquet(whole)
    under = Window.partitionBy("key")
    share = similarity / (1 + similarity)
    keys = wide.select("same", "size", F.posexplode("keys").alias("pos", "key"))
    # A pair is found where the smaller set has enough shingles left for one of its own size.
    keys = keys.select("key", "same", "size", (F.col("size") - F.col("pos")).alias("left"))
    keys = keys.withColumn("short", F.col("left") + 1e-6 >= 2 * share * F.col("size"))
    filed = keys.select("*", F.count("*").over(under).alias("n"), F.max("short").over(under).alias("any"), F.min("same").over(under).alias("first"))
    filed = settled(filed.where("n > 1 AND any").drop("n", "any"))
    # From here on only what is filed is needed of the keys.
    sets = settled(wide.drop("keys"))
    drop_folder(spark, whole)
    apart = lambda pairs: pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    prints = settled(sets.groupBy("simhash").agg(F.min("same").alias("same")))
    first = prints.withColumnRenamed("same", "v")
    star = sets.select(F.col("same").alias("u"), "simhash").join(first, "simhash").select("u", "v")
    of = lambda name: prints.select(F.col("simhash").alias(f"print_{name}"), F.col("same").alias(name))
    close = close_pairs(prints).select(F.col("u").alias("print_u"), F.col("v").alias("print_v"))
    star = star.unionByName(close.join(of("u"), "print_u").join(of("v"), "print_v").select("u", "v"))
    star = star.unionByName(filed.select(F.col("same").alias("u"), F.col("first").alias("v")))
    links = alike(sets, settled(apart(star)), chosen, shingle, similarity)

    def mixed_keys(links: DataFrame) -> DataFrame:
        """What is filed under keys of several groups; what is together need not be compared again."""
        grouped = components(links).select(F.col("u").alias("same"), F.col("v").alias("met"))
        placed = settled(sets.select("same").join(grouped, "same", "left").select("same", F.coalesce("met", "same").alias("met")))
        mixed = filed.drop("first").join(placed, "same")
        mixed = mixed.select("*", (F.min("met").over(under) < F.max("met").over(under)).alias("several"))
        return settled(mixed.where("several").drop("several"))

    mixed = mixed_keys(links)
    for k in range(beside):
        drawn = F.min(F.struct(F.xxhash64("key", "same", F.lit(k)).alias("at"), "same", "met")).over(under)
        pairs = mixed.select("same", "met", drawn.alias("drawn")).where("met <> drawn.met").select(F.col("same").alias("u"), F.col("drawn.same").alias("v"))
        links = links.unionByName(alike(sets, settled(apart(pairs)), chosen, shingle, similarity))
        mixed = mixed_keys(links)
    mixed = settled(mixed.join(sets.select("same", "bits"), "same"))
    side = lambda name: mixed.select("key", *(F.col(c).alias(f"{d}{name}") for c, d in (("same", ""), ("size", "size_"), ("left", "left_"), ("met", "met_"), ("bits", "bits_"), ("short", "short_"))))
    after = (F.col("size_v") < F.col("size_u")) | ((F.col("size_v") == F.col("size_u")) & (F.col("v") < F.col("u")))
    enough = F.least("left_u", "left_v") + 1e-6 >= share * (F.col("size_u") + F.col("size_v"))
    a, b = side("v").where("short_v"), side("u")
    near = a.join(b, (a["key"] == b["key"]) & (F.col("met_u") != F.col("met_v")) & after & enough & may_be_alike(similarity))
    near = settled(apart(near.select("u", "v")))
    member = components(links.unionByName(alike(sets, near, chosen, shingle, similarity)))
    root = sets.select("same", "least").join(member.withColumnRenamed("u", "same"), "same", "left")
    root = settled(root.select("same", "least", F.coalesce("v", "same").alias("root")))
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root.join(ids, "root").select("same", "component_id")
    return found.join(named, "same").select("doc_id", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    print_of = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return found.select("doc_id", print_of.alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
