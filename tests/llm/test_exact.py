"""Operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import json
import math
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recurra.llm import bpe, chat, decontaminate, eliasfano, licenses, media, ngram_lm, packing, simhash, substring_dedup, suffix_dedup, tiff, toxicity

SCHEMA = "doc_id long, text string"


def corpus(seed=0, n=60, words=80):
    """Texts of few words with copied passages, so that much repeats."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        own = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(rng.randrange(words))]
        for p in rng.sample(passages, rng.randrange(4)):
            own.insert(rng.randrange(len(own) + 1), p)
        rows.append((i, " ".join(own)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1] + " end"), (n + 2, "x " * 300), (n + 3, "x " * 90)]
    return rows


def repeated(units, length):
    """Removed units of each document, window by window."""
    first = {}
    for i, seq in units:
        for p in range(len(seq) - length + 1):
            first.setdefault(tuple(seq[p : p + length]), (i, p))
    out = {}
    for i, seq in units:
        gone = [False] * len(seq)
        for p in range(len(seq) - length + 1):
            if first[tuple(seq[p : p + length])] != (i, p):
                gone[p : p + length] = [True] * length
        out[i] = gone
    return out


@pytest.mark.parametrize("contexts", [1, 64])
def test_repeated_words(spark, monkeypatch, contexts):
    monkeypatch.setattr(substring_dedup, "BLOCK", 400)
    rows = corpus() + [(200, "zz " + corpus()[60][1] + " yy" * 700), (201, "q\u00a0r\n\t é " * 40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    words = [(i, re.findall(r"[^\x20\x09-\x0d]+", t)) for i, t in rows]
    expected = repeated(words, 20)
    for r in substring_dedup.remove_repeated_spans(docs, contexts=contexts).collect():
        own = dict(words)[r.doc_id]
        assert r.n_removed == sum(expected[r.doc_id]) and r.kept == " ".join(w for w, g in zip(own, expected[r.doc_id]) if not g)


@pytest.mark.parametrize("contexts", [1, 64])
def test_repeated_bytes(spark, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rows = corpus() + [(200, "Ünïcode \u0000 😀 " * 40), (201, "Ünïcode \u0000 😀 " * 20), (202, "zz" + corpus()[60][1] + "yy" * 400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    data = [(i, t.encode()) for i, t in rows]
    expected = repeated(data, 100)
    for batches in (1, 3, 5):
        for r in suffix_dedup.remove_repeated_strings(docs, batches=batches, contexts=contexts).collect():
            own = dict(data)[r.doc_id]
            assert bytes(r.kept) == bytes(b for b, g in zip(own, expected[r.doc_id]) if not g)


def test_hot_line_is_sent_once_a_part():
    rng = random.Random(3)
    line = " ".join(f"common{i}" for i in range(21))
    texts = [f"{rng.random()} {rng.random()} {line} {rng.random()} {rng.random()}" for _ in range(200)]
    shape, sent = substring_dedup.Shape(20, 8, 8, 4), collections.Counter()
    for p in range(5):
        part = pa.table({"doc_id": pa.array(range(p * 40, p * 40 + 40), pa.int64()), "text": texts[p * 40 : p * 40 + 40]})
        k = np.unique(substring_dedup.part_paths(shape, shape.rows(part))[0])
        known = pa.table({"body": pa.array([substring_dedup.pack(k, np.zeros(len(k), np.uint64), np.zeros(len(k), np.uint64), np.full(len(k), substring_dedup.HOT, np.uint8))], pa.binary())})
        found = substring_dedup.part_edges(shape, (pa.scalar(p),), part, known)
        sent.update(x for x in found.column("one").to_pylist() if x is not None)
    assert max(sent.values()) == 5


def test_paths_compact(spark):
    """A chain of nine edges with a branch at the end of the fifth, whose count differs from there on."""
    rows = [(i, i, i + 1, 4 if i < 5 else 3, 7, i) for i in range(9)] + [(50, 5, 60, 2, 8, 3), (51, 60, 61, 2, 8, 4)]
    edges = spark.createDataFrame(rows, "edge long, source long, target long, n long, doc long, start int")
    paths = substring_dedup.compacted(edges)
    got = {r.edge: (r.path, r.place) for r in paths.collect()}
    assert got == {i: (0, i) for i in range(5)} | {5 + i: (5, i) for i in range(4)} | {50: (50, 0), 51: (50, 1)}
    found = {r.path: (r.doc, r.start, r.n_edges, r.n) for r in substring_dedup.path_table(edges, paths).collect()}
    assert found == {0: (7, 0, 5, 4), 5: (7, 5, 4, 3), 50: (8, 3, 2, 2)}


def test_rounds_of_compaction_let_their_shuffles_go(spark, monkeypatch):
    """A chain of 40 edges takes six rounds and one that changes nothing; what each has shuffled goes before the next."""
    gone = []
    monkeypatch.setattr(substring_dedup, "let_go", gone.append)
    edges = spark.createDataFrame([(i, i, i + 1, 2, 7, i) for i in range(40)], "edge long, source long, target long, n long, doc long, start int")
    assert {r.edge: (r.path, r.place) for r in substring_dedup.compacted(edges).collect()} == {i: (0, i) for i in range(40)}
    assert len(gone) == 8


@pytest.mark.parametrize("contexts", [1, 64])
def test_rows_that_repeat_an_id_lose_the_same(spark, contexts):
    word = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    shared = word("s", 45)
    rows = [(1, f"{word('a', 30)} {shared} {word('b', 30)}")] + [(2, f"{word('c', 30)} {shared} {word('d', 30)}")] * 2 + [(2, f"{word('c', 30)} {shared} {word('e', 30)}")]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = [r.n_removed for r in substring_dedup.remove_repeated_spans(docs, contexts=contexts).collect() if r.doc_id == 2]
    assert left == [45] * 3
    found = [r for r in suffix_dedup.remove_repeated_strings(docs, contexts=contexts).collect() if r.doc_id == 2]
    assert [r.n_removed for r in found] == [len(shared) + 4] * 3  # with "29 " before and " " after, which are equal too


@pytest.mark.parametrize("copies", [0, 1500])
def test_bounds_do_not_bend_to_copies(spark, copies):
    """Buckets are cut through the texts that differ, however many copies of one there are."""
    rng = random.Random(8)
    own = lambda: " ".join(f"{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.randrange(10**6)}" for _ in range(60))
    texts = [own() for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts + [own()] * copies)]
    bounds = suffix_dedup.suffix_bounds(spark.createDataFrame(rows, SCHEMA).repartition(4), 16, 100, 24, each=40)
    assert len(bounds) == 15
    first = np.sort(np.array([t.encode()[i : i + 24] for t in texts for i in range(0, len(t) - 24, 7)], "S24"))
    held = np.diff(np.concatenate(([0], np.searchsorted(first, bounds), [len(first)])))
    assert held.min() > 0 and held.max() < 6 * held.mean()


def test_suffix_order():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 3, 400, dtype=np.uint8)
    found = suffix_dedup.strings_at(raw, np.arange(380), 20)
    order = np.argsort(suffix_dedup.order_keys(found, np.zeros(380, np.uint64), np.zeros(380, np.int64), np.arange(380)), kind="stable")
    own = [raw[i : i + 20].tobytes() for i in range(380)]
    assert order.tolist() == sorted(range(380), key=lambda i: (own[i], i))
    import os

    lcp = suffix_dedup.common_prefix(found[order])
    assert lcp[1:].tolist() == [len(os.path.commonprefix([own[a], own[b]])) for a, b in zip(order, order[1:])]


def test_levels_double(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    levels = suffix_dedup.SuffixLevels(spark, 2, suffix_dedup.suffix_bounds(docs, 4, 100, 24))
    for i in range(5):
        levels.append(docs.where(f"doc_id DIV 13 = {i}"))
    assert [n for n, _ in levels.levels] == [4, 1]


def test_simhash(spark):
    rows = corpus(2) + [(900, None), (901, "")]
    rng = random.Random(5)
    base = " ".join(t for _, t in corpus(9)[:8]).split()
    for i in range(40):
        changed = list(base)
        changed[rng.randrange(len(changed))] = f"new{i}"
        rows.append((1000 + i, " ".join(changed)))
    import xxhash

    prints = {}
    for i, t in rows:
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()
        parts = [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    for crowd in (1, 512):
        got = {r.doc_id: (r.simhash % 2**64, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), crowd=crowd).collect()}
        assert got == {i: (prints[i], find(i)) for i in prints}


@pytest.mark.parametrize("beside", [2, 3])
def test_near_texts(spark, beside):
    """Edited copies are found by exact similarity, and nothing else is linked."""
    rng = random.Random(11)
    word = lambda: f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(900)}"
    base = [[word() for _ in range(rng.randrange(60, 400))] for _ in range(40)]
    rows, number = [], 0
    for b in base:
        for _ in range(5):
            own = list(b)
            for _ in range(rng.randrange(0, max(1, len(b) // 50))):
                own[rng.randrange(len(own))] = word()
            rows.append((number, " ".join(own)))
            number += 1
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two")]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    like = lambda a, b: len(a & b) / max(1, len(a | b)) if a or b else 1
    got = {r.doc_id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, SCHEMA), beside=beside).collect()}
    close = [(a, b) for a in sets for b in sets if a < b and like(sets[a], sets[b]) >= 0.8]
    assert sum(got[a] == got[b] for a, b in close) >= 0.97 * len(close)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in close:
        if find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(i) == find(c) for i, c in got.items())


def test_near_texts_misses_no_pair(spark):
    """Every pair of 0.8 or more ends in one group, among texts of one template whose own words make them differ just enough."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(130)]
    rows = []
    for family in range(120):
        own = [f"f{family}w{rng.randrange(10**6)}" for _ in range(25)]
        for _ in range(2):
            words, changed = [*own, *template], list(own)
            for i in rng.sample(range(25), rng.choice((1, 2, 3))):
                changed[i] = f"x{rng.randrange(10**6)}"
            words[:25] = changed
            for _ in range(rng.randrange(3)):
                words[rng.randrange(25, 155)] = f"y{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    got = {r.doc_id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    close = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(close) > 20 and all(got[a] == got[b] for a, b in close)
    reach = list(range(len(sets)))
    for a, b in sorted(close):
        x, y = sorted((reach[a], reach[b]))
        reach = [x if r == y else r for r in reach]
    assert got == dict(enumerate(reach))


def test_golay_code():
    table = simhash.decoder()
    assert len(np.unique(table)) == 4096 and (np.bincount(table) == 2048).all()


def test_packing(spark):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(150)] + [(200, None), (201, "")]
    found = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    encode, fill = bpe.encoder(), collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in found:
        fill[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, list(r.ids)))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, t in rows:
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == [*encode(t or ""), 0]
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(fill) * 1024 - total <= 1024


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_token_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.encoder()(text) == known.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x<|endoftext|>y", "<|endoftext|><|endoftext|>", "a" + " " * 300_000 + "b", "\n" * 200_000, " \t\u00a0\u3000" * 40_000 + "x  "])
def test_token_ids_of_added_tokens_and_long_blanks(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.encoder()(text) == known.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_packing_takes_the_level_of_least_squares(sizes):
    packer = packing.Packer(40, 0)
    for n, size in enumerate(sizes):
        if size < 40:
            costs = {}
            for level in [0, *[x for x in range(1, 40 - size + 1) if packer.counts[x]]]:
                after = packer.counts.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 40
                costs[level] = int((after[1:40] ** 2).sum())
            assert costs[packer.level_for(size)] == min(costs.values())
        packer.place(((n, size), 0, np.zeros(size, "<u4")))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(["none", "lzw", "deflate", "packbits"]), st.booleans(), st.sampled_from([None, 16, 48, 64]))
def test_tiff_round_trip(data, compression, predictor, tile):
    rows = max(1, -(-len(data) // 192))
    image = np.frombuffer(data.ljust(rows * 192, b" "), np.uint8).reshape(rows, 64, 3)
    pages = [image, image[:1]]
    back = list(tiff.pages(tiff.write(pages, compression, predictor, rows_per_strip=5, tile=tile)))
    assert all((a == b).all() for a, b in zip(pages, back)) and len(back) == 2


def test_lzw_over_full_tables_and_a_loop_of_pages():
    data = bytes(np.random.default_rng(0).integers(0, 256, 30_000, dtype=np.uint8))
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    made = bytearray(tiff.write([np.zeros((1, 64, 3), np.uint8)]))
    made[-4:] = made[4:8]
    with pytest.raises(ValueError):
        list(tiff.pages(bytes(made)))


def test_tiles_and_big_endian():
    import struct

    tile = np.arange(256, dtype=np.uint8).reshape(16, 16)
    tags = [(256, 4, 20), (257, 4, 10), (258, 3, 8 << 16), (259, 3, 1 << 16), (277, 3, 1 << 16), (322, 4, 16), (323, 4, 16)]
    body = b"MM\0*" + struct.pack(">I", 8)
    directory = struct.pack(">H", 9) + b"".join(struct.pack(">HHII", t, k, 1, v) for t, k, v in tags)
    at = 8 + 2 + 9 * 12 + 4
    directory += struct.pack(">HHII", 324, 4, 2, at) + struct.pack(">HHII", 325, 4, 2, at + 8) + bytes(4)
    data = body + directory + struct.pack(">IIII", at + 16, at + 16 + 256, 256, 256) + tile.tobytes() * 2
    (page,) = tiff.pages(data)
    assert page.shape == (10, 20, 1) and (page[:, :16, 0] == tile[:10]).all() and (page[:, 16:, 0] == tile[:10, :4]).all()


def test_media_digests(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(8, 40))] + [(100, None), (101, ""), (102, "é" * 5000), (103, "x" * (192 * 1030))]
    found = {r.doc_id: r for r in media.digest_media(media.encode_text(spark.createDataFrame(rows, SCHEMA), "mixed")).collect()}
    for i, t in rows:
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        kind, differ, tile = media.LAYOUTS[zlib.crc32(data) % len(media.LAYOUTS)]
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        stored = tiff.write([image[a : a + 512] for a in range(0, len(image), 512)], kind, differ, tile=tile)
        assert (r.media_bytes, r.media_sha256, r.n_pages) == (len(stored), hashlib.sha256(stored).hexdigest(), -(-len(image) // 512))
    assert len({zlib.crc32((t or "").encode()) % len(media.LAYOUTS) for _, t in rows}) == len(media.LAYOUTS)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.binary(max_size=4), st.sampled_from(["lzw", "deflate", "packbits"]))
def test_broken_files_say_so(at, change, compression):
    made = bytearray(tiff.write([np.arange(768, dtype=np.uint8).reshape(4, 64, 3)] * 2, compression))
    made[at % len(made) : at % len(made) + 4] = change
    try:
        list(tiff.pages(bytes(made)))
    except tiff.BROKEN:
        pass


def test_broken_media(spark):
    good = tiff.write([np.zeros((2, 64, 3), np.uint8)])
    rows = [(1, b""), (2, b"plain text"), (3, good[:-40]), (4, good), (5, None)]
    found = media.read_pages(spark.createDataFrame(rows, "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.page, r.error is None) for r in found] == [(1, None, False), (2, None, False), (3, None, False), (4, 0, True)]


def test_pages(spark):
    text = "x" * (192 * 1100)
    pages = media.read_pages(media.encode_text(spark.createDataFrame([(1, text), (2, None)], SCHEMA))).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.page, r.height) for r in pages] == [(1, 0, 512), (1, 1, 512), (1, 2, 76), (2, 0, 1)]
    assert b"".join(bytes(r.pixels) for r in pages[:3]) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**9), max_size=200), st.integers(0, 10**9))
def test_elias_fano(values, wanted):
    values = np.sort(np.array(values, np.int64))
    n, bits, *packed = eliasfano.EliasFano.pack(values)
    made = eliasfano.EliasFano(n, bits, *(np.frombuffer(x, np.uint8) for x in packed))
    assert (made[np.arange(n)] == values).all()
    part = np.array([[a, b] for a in range(0, n + 1, 7) for b in range(a, n + 1, 5)], np.int64).reshape(-1, 2)
    got = made.successor(np.full(len(part), wanted), part[:, 0], part[:, 1])
    assert got.tolist() == [a + int(np.searchsorted(values[a:b], wanted)) for a, b in part]
    got = made.successor(np.array([wanted]), np.array([0]), np.array([n]))[0]
    assert got == np.searchsorted(values, wanted)


@pytest.mark.parametrize("lookup", [1e-9, 0.004])
def test_language_model(spark, lookup):
    rows = corpus(4, 120) + [(500, None), (501, ""), (502, "UPPER upper é É"), (None, "alpha beta")]
    docs = spark.createDataFrame(rows, SCHEMA)
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None]
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    triples = collections.Counter(x for t in train for x in zip([None, None, *split(t)], [None, *split(t)], split(t)))
    pairs, contexts, one, counts = (collections.Counter() for _ in range(4))
    for (a, b, c), n in triples.items():
        pairs[b, c] += n
        contexts[a, b] += n
        one[b] += n
        counts[c] += n
    kinds2, kinds3 = collections.Counter(b for b, _ in pairs), collections.Counter((a, b) for a, b, _ in triples)
    total, distinct = sum(counts.values()), len(counts)
    listed = {w: n for w, n in counts.items() if n >= max(1, math.ceil(lookup * total))}
    others = distinct - len(listed) + 1
    flat = (total - sum(listed.values()) + 0.5 * others) / others

    def probability(a, b, c):
        p = (listed[c] + 0.5 if c in listed else flat) / (total + 0.5 * (distinct + 1))
        if one[b]:
            p = max(pairs[b, c] - 0.75, 0) / one[b] + 0.75 * kinds2[b] / one[b] * p
        if contexts[a, b]:
            p = max(triples[a, b, c] - 0.75, 0) / contexts[a, b] + 0.75 * kinds3[a, b] / contexts[a, b] * p
        return p

    # One shard a word, and shards so small that most words are dealt over several.
    found = ngram_lm.lm_scores(docs, ngram_lm.fold("doc_id") != 1, lookup=lookup, shard_bytes=10**9).collect()
    again = ngram_lm.lm_scores(docs.repartition(5), ngram_lm.fold("doc_id") != 1, lookup=lookup, shard_bytes=400).collect()
    assert len(found) == len(again) == len(rows)
    for r in (*found, *again):
        words = split(dict(rows)[r.doc_id])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert r.base_score == pytest.approx(base) and r.n_tokens == len(words)
        assert r.n_known == sum(counts[w] > 0 for w in words) and r.train_tokens == total
        score = sum(math.log10(probability(*x)) for x in zip([None, None, *words], [None, *words], words))
        assert r.score == pytest.approx(score, abs=0.002 * len(words))
    same = {r.doc_id: r.score for r in again}
    assert all(r.score == pytest.approx(same[r.doc_id], abs=1e-6) for r in found)


def test_rare_words_have_their_own_last_resort(spark):
    """Words left out of the broadcast lexicon score as if they were in it, whatever the shards."""
    docs = spark.createDataFrame([*corpus(4, 120), (500, None), (501, ""), (502, "never seen words"), (None, "alpha beta")], SCHEMA)
    learn = ngram_lm.fold("doc_id") != 1
    scores = lambda **kw: {r.doc_id: (r.score, r.base_score, r.n_known) for r in ngram_lm.lm_scores(docs, learn, **kw).collect()}
    whole = scores(lookup=1e-9, shard_bytes=10**9)
    for size in (10**9, 400):
        few = scores(lookup=0.004, shard_bytes=size, rare_apart=True)
        assert few.keys() == whole.keys()
        for i in whole:
            n = len((docs.where(F.col("doc_id").eqNullSafe(i)).first().text or "").split()) + 1 if i in (None, 502) else 400
            assert few[i][0] == pytest.approx(whole[i][0], abs=0.0003 * n) and few[i][1:] == pytest.approx(whole[i][1:])


def test_one_model_whatever_the_partitions(spark):
    """Equal scores for any number of shards and order of rows, and for equal texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    learn = F.col("doc_id") < 1_000_000
    docs = docs.unionByName(docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))

    def scores(rows, partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            return {r.doc_id: r.score for r in ngram_lm.lm_scores(rows, learn).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)

    one = scores(docs, 1)
    assert all(one[i] == pytest.approx(one[i + 1_000_000], abs=1e-6) for i in one if i < 1_000_000)
    for rows, partitions in ((docs, 97), (docs.repartition(7), 8), (docs.orderBy(F.desc("doc_id")), 200)):
        many = scores(rows, partitions)
        assert many.keys() == one.keys() and all(many[i] == pytest.approx(one[i], abs=1e-6) for i in one)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [64, 512, 4096])
def test_words_that_only_polynomial_hashes_take_for_one(spark, size):
    """Two such words are different words, to repeated spans, to sets of shingles and to counts."""
    one, rest = thue_morse(size), " ".join(f"word{i}" for i in range(25))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{other} {rest} end")], SCHEMA)
    for contexts in (1, 64):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeated_spans(docs, contexts=contexts).collect()}
        assert found == {1: (26, 0, f"{one} {rest}"), 2: (26, 25, other), 3: (27, 26, "end")}
    known = {r.doc_id: r.n_known for r in ngram_lm.lm_scores(docs, F.col("doc_id") == 1).collect()}
    assert known == {1: 27, 2: 26, 3: 26}
    pair = spark.createDataFrame([(1, one), (2, other)], SCHEMA)
    assert {r.component_id for r in simhash.near_texts(pair).collect()} == {1, 2}


@pytest.mark.parametrize("most", [100_000, 0])
def test_contamination(spark, most):
    rows, items = corpus(7), [(i, " ".join(t.split()[5:30]).upper()) for i, t in corpus(7)[:20]] + [(90, "x"), (91, "Éa b c"), (92, None)]
    rows.append((99, "éA b c X. Éa B-C x"))
    ten = " one two three four five six seven eight nine"
    items += [(93, "ΑΣ.Α" + ten + " ten"), (94, "three four five six seven"), (95, "same " * 14)]
    rows += [(100, "ΑΣ.Α" + ten + " ten"), (101, "αΣ" + ten), (102, "x same" * 3 + " same" * 30)]
    word = lambda t: [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) if w]
    found = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), broadcast_prints=most).collect()
    assert next(r.n_hit for r in found if r.doc_id == 100) == 12
    for r in found:
        own, hit, names = word(dict(rows)[r.doc_id]), set(), set()
        for i, t in items:
            w = word(t)
            n = min(10, len(w))
            windows = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if n else set()
            for p in range(len(own) - n + 1 if n else 0):
                if tuple(own[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    names.add(str(i))
        assert (r.n_words, r.n_hit, list(r.items)) == (len(own), len(hit), sorted(names))


def test_contamination_of_a_long_text(spark):
    words = [f"w{i}" for i in range(150_000)]
    items = [(1, " ".join(words[70_000:70_030]))]
    r = decontaminate.contamination(spark.createDataFrame([(1, " ".join(words))], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).first()
    assert (r.n_words, r.n_hit, list(r.items)) == (150_000, 30, ["1"])


def test_licenses(spark):
    import textwrap

    s = licenses.SENTENCES
    mit = ". ".join((s["mit-title"], s["mit-grant"] + "\n\n" + s["mit-notice"], s["as-is-mit"]))
    bsd = "\n".join(("", s["bsd-grant"], "1. " + s["bsd-source"] + ".", "2. " + s["bsd-binary"] + ".", "3. " + s["bsd-endorse"] + "."))
    fill = lambda t, mark="": "\n".join(textwrap.wrap(t, 70, initial_indent=mark, subsequent_indent=mark))
    whole = "\n\n".join(("MIT License", "Copyright (c) 2020 Some One. All rights reserved.", fill(s["mit-grant"]), fill(s["mit-notice"] + "."), fill(s["as-is-mit"] + ".")))
    header = s["apache-header"] + "; " + s["apache-use"] + ". " + s["apache-copy"]
    gpl2 = "This program is free software; " + "; ".join((s["gpl-terms"], s["later-2"])) + ". " + s["gpl-hope"] + "; " + s["gpl-implied"] + "."
    far = s["bsd-grant"] + "\n\n" + "Other words here. " * 5 + s["bsd-source"] + ". " + s["bsd-binary"] + "."
    rows = [
        (1, mit + "."), (2, bsd), (3, "text. Licensed under the Apache License, Version 2.0. more"), (4, "nothing"), (5, s["bsd-binary"] + "\n" + s["bsd-grant"]),
        (6, whole), (7, fill(whole.replace("\n\n", ". "), " * ")), (8, "#!/bin/sh\n" + fill(header, "# ") + "\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"), (9, "/*\n" + fill(gpl2, " * ") + "\n */"),
        (10, "// SPDX-License-Identifier: MIT\nint x;"), (11, "no stop before\nReleased under the MIT License\nnor after"), (12, far), (13, None),
        (14, fill(s["mpl2-subject"] + ". 2.0. " + s["mpl2-copy"] + ".", "// ")),
    ]
    got = {r.doc_id: list(r.licenses) for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ["MIT"], 2: ["BSD-3-Clause"], 3: ["Apache-2.0"], 4: [], 5: [], 6: ["MIT"], 7: ["MIT"], 8: ["Apache-2.0"], 9: ["GPL-2.0-or-later"], 10: ["MIT"], 11: ["MIT"], 12: [], 13: [], 14: ["MPL-2.0"]}


def test_licence_files_expressions_and_markup(spark):
    apache = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
    gpl2 = """  The licenses for most software are designed to take away your
freedom to share and change it.  By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free
software--to make sure the software is free for all its users.  This"""
    gpl3 = """  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.  By contrast,"""
    agpl3 = """  The GNU Affero General Public License is a free, copyleft license for
software and other kinds of works, specifically designed to ensure
cooperation with the community in the case of network server software."""
    isc = licenses.SENTENCES["isc-grant"]
    cases = {
        1: (apache, ["Apache-2.0"]), 2: (gpl2, ["GPL-2.0"]), 3: (gpl2.replace("License is", "Licenses are").replace("License\nis", "Licenses\nare"), ["LGPL-2.1"]), 4: (gpl3, ["GPL-3.0"]), 5: (agpl3, ["AGPL-3.0"]),
        6: ("# SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
        7: ("/* SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0 AND ISC) */", ["GPL-2.0-or-later", "ISC"]),
        8: ("<!-- SPDX-License-Identifier: Zlib. -->", ["Zlib"]), 9: ("SPDX-License-Identifier: LicenseRef-Own", []),
        10: (f"<html><p class='x'>Hello.<p>{isc}.</p>", ["ISC"]), 11: ("Released under\nthe MIT License\nby us", ["MIT"]),
        12: ("It is licensed under the <a href='x'>MIT license</a> - see LICENSE", ["MIT"]), 13: ("// distributed under the\n// Apache License,\n// Version 2.0, as you like", ["Apache-2.0"]),
        14: ("licensed under the mitre", []), 15: ("a < b under > c &quot; spdx-", []), 16: ("Licensed under Mozilla Public License 2.0!", ["MPL-2.0"]), 17: ("", []),
    }
    rows = [(i, text) for i, (text, _) in cases.items()]
    got = {r.doc_id: list(r.licenses) for r in licenses.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: want for i, (_, want) in cases.items()}


def test_licences_equal_sql(spark, tmp_path):
    import duckdb

    texts = [*licenses.SENTENCES.values(), "MIT License", None, "", "<p>Licensed under<br/>the ISC License", "spdx-license-identifier: mit and (isc or bsl-1.0)", "; released under CC BY 4.0.\n1. spdx"]
    rows = [(i, f"{a}. {b}\n\n{c}" if a is not None else None) for i, (a, b, c) in enumerate(zip(texts, texts[5:] + texts[:5], texts[2:] + texts[:2]))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, licenses.op8_licenses(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(licenses.ORACLES["op8_licenses"]).fetchall())


def test_chat_round_trip(spark):
    texts = [chat.PROBE_TEXT, "\\e \\h####</turn>\n\\", "a: b\n### user: x</turn>\n", "", "😀 é"]
    rows = [(c, t, r, texts[(c + t) % 5]) for c in range(5) for t, r in enumerate(("sys: tem", "user", "assistant", "assistant"))]
    made = chat.format_chat(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    for r in made.select("conv_id", "formatted", chat.read_chat(made.formatted).alias("t"), chat.read_loss("formatted", "loss_spans").alias("loss")).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.t] == [(x[2], x[3]) for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")


def test_layouts(spark):
    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]})),
        (3, json.dumps({"instruction": "q", "output": "a"})), (4, json.dumps({"prompt": "q", "completion": "a"})), (5, json.dumps({"other": 1})), (6, None),
        (7, json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]})),
        (8, json.dumps({"data": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}})),
        (9, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]})), (10, '{"prompt": "q"'), (11, "{}"),
    ]
    got = {r.id: r.turns for r in chat.record_turns(spark.createDataFrame(records, "id int, j string"), "id", "j").selectExpr("conv_id AS id", "turns").collect()}
    assert all([(t.role, t.text) for t in got[i]] == [("user", "q"), ("assistant", "a")] for i in (1, 2, 3, 4, 7, 8))
    assert all(got[i] is None for i in (5, 6, 9, 10, 11))
    marks = {r.conv_id: r.layout for r in chat.record_turns(spark.createDataFrame(records, "id int, j string"), "id", "j").collect()}
    assert marks[1] == chat.fingerprint(("messages[].role", "messages[].content")) and marks[10] is None and marks[1] != marks[7] and marks[9] not in (marks[1], marks[7])
    table = spark.createDataFrame([("q", "", "a")], "instruction string, input string, output string")
    assert [(t.role, t.text) for t in chat.canonical_turns(table).first().turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcdef", min_size=3, max_size=12), min_size=1, max_size=6), st.lists(st.text("abcdef", min_size=3, max_size=12), min_size=1, max_size=4))
def test_kernel_is_that_of_shared_subsequences(words, landmarks):
    import itertools

    def weights(word):
        found = collections.Counter()
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.MAX_SPAN:
                found[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
        return found

    def length(word):  # a unit's places, each by itself, have length one together
        return math.sqrt(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, _, k in itertools.combinations(range(len(word)), 3) if k - i < toxicity.MAX_SPAN))

    symbols = lambda w: "".join(chr(ord(c) - ord("a")) for c in w)
    got = toxicity.kernel([symbols(w) for w in words], toxicity.landmark_table([symbols(w) for w in landmarks]))
    want = [[sum(n * weights(b)[x] for x, n in weights(a).items()) / length(a) / length(b) for b in landmarks] for a in words]
    assert got == pytest.approx(np.array(want), rel=1e-4, abs=1e-6)


def test_held_out_toxicity(spark):
    """Labels of the fold that is never learnt from, over tables with few and with more of them."""
    import os

    for size, least in (("sf0.01", 0.75), ("sf0.1", 0.85)):
        where = f"/root/testdata/{size}"
        if not os.path.isdir(where):
            pytest.skip("no test tables")
        got = toxicity.op2_toxicity(spark, where).where("held_out").join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").where("toxic IS NOT NULL").select("score", "toxic").collect()
        bad, good = ([r.score for r in got if r.toxic == x] for x in (1, 0))
        area = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / max(1, len(bad) * len(good))
        print(size, len(bad), len(good), round(area, 3))
        assert area > least


def test_benchmark_prints_are_made_once(spark):
    """The plan of the result reads the written fingerprints; that of the benchmark itself is compiled once, not for each use."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "no such words")], SCHEMA)
    spark.createDataFrame([(7, "b c d e f g h i j k"), (8, "such words")], "item_id long, text string").createOrReplaceTempView("items_once")
    found = decontaminate.contamination(docs, spark.table("items_once"))
    assert "item_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found.collect()} == {1: (10, ["7"]), 2: (2, ["8"])}


def test_toxicity_is_learnt_in_a_task(spark, monkeypatch):
    """The sample meets away from the driver, and the model is that of its rows in order."""
    import os

    rows = [(i, f"good day number {i} {'you nitwit' * (i % 3 == 0)}") for i in range(60)] + [(None, "without an id"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    learnt = sorted(((i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5), key=lambda x: (x[0], x[1] is not None, x[1]))
    want = toxicity.train(pa.array([t for _, t in learnt], pa.string()), np.array([int(i % 3 == 0) for i, _ in learnt]))
    made = toxicity.fit(docs, labels)
    assert (made.weights == want.weights).all() and (made.bias, made.slope, made.offset) == (want.bias, want.slope, want.offset)
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: (os.getpid(), texts.to_pylist(), labels.tolist()))
    where, texts, _ = toxicity.fit(docs, labels)
    assert where != os.getpid() and texts == [t for _, t in learnt]
    assert toxicity.fit(docs.limit(0), labels) is None


def test_toxicity_tolerates_gaps():
    rng = random.Random(0)
    usual = ["".join(rng.choice(("th", "er", "on", "an", "re", "in", "es")) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    insults = ["blockhead", "nitwit", "dimwit", "numskull"]

    def text(bad):
        words = [rng.choice(usual) for _ in range(60)]
        if bad:
            words[rng.randrange(60)] = rng.choice(insults)
        return " ".join(words)

    labels = np.array([i % 5 == 0 for i in range(600)], int)
    model = toxicity.train(pa.array([text(b) for b in labels]), labels)
    fresh = [text(i % 2) for i in range(200)]
    right = (model.scores(pa.array(fresh)) >= 0.5) == (np.arange(200) % 2 == 1)
    assert right.mean() > 0.97
    assert (model.scores(pa.array(["you bl-ockhead", "b l o c k h e a d", "blocxkhead", "NITWIT!"])) >= 0.5).all()
    assert (model.scores(pa.array(["", None, "there on", "x" * 5000])) < 0.5).all()
    assert toxicity.train(pa.array(["a"]), np.array([1])) is None


def test_registered_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert hashlib.sha256(b"").hexdigest()


def lzw_bits(data, size=4094):
    """The bits of an LZW stream, code by code."""
    table, following, prefix, out = {bytes([i]): i for i in range(256)}, 258, b"", f"{256:09b}"
    put = lambda code, known: f"{code:0{max(9, known.bit_length())}b}"
    for i in range(len(data)):
        if prefix + data[i : i + 1] in table:
            prefix += data[i : i + 1]
            continue
        out += put(table[prefix], following)
        table[prefix + data[i : i + 1]] = following
        following, prefix = following + 1, data[i : i + 1]
        if following == size:
            out += put(256, following)
            table, following = {bytes([i]): i for i in range(256)}, 258
    if prefix:
        out += put(table[prefix], following)
        following += 1
    out += put(257, following)
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8))


@pytest.mark.parametrize("n", [0, 1, 2, 252, 253, 254, 255, 256, 764, 765, 766, 767, 1788, 1789, 1790, 1791, 3834, 3835, 3836, 3837, 3838, 9000])
def test_lzw_bytes_at_each_width(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), rng.integers(97, 101, n, dtype=np.uint8).tobytes(), b"a" * n):
        assert tiff.lzw_encode(data) == lzw_bits(data)
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_broken_lzw_says_what_it_said():
    coded = lambda *codes: np.packbits([int(b) for c in codes for b in f"{c:09b}"]).tobytes()
    assert tiff.lzw_decode(coded(97, 98, 258, 257, 99)) == b"abab"  # no code that clears, and one behind the end
    assert tiff.lzw_decode(coded(256, 97, 258, 256, 256, 98)) == b"aaab"  # no end, a table without a code
    assert tiff.lzw_decode(b"") == b"" and tiff.lzw_decode(b"\x80") == b"" and tiff.lzw_decode(coded(256)) == b""
    with pytest.raises(ValueError, match="broken LZW data"):
        tiff.lzw_decode(coded(256, 97, 260))
    with pytest.raises(IndexError, match="list index out of range"):
        tiff.lzw_decode(coded(256, 258))
    many = np.random.default_rng(2).integers(0, 256, 9000)  # more than a table holds, and nothing clears it
    bits = "".join(f"{c:0{min(12, max(9, (j + 258).bit_length()))}b}" for j, c in enumerate(many.tolist()))
    assert tiff.lzw_decode(np.packbits([int(b) for b in bits]).tobytes()) == bytes(many.tolist())


def test_lzw_makes_no_call_for_each_code():
    data, calls = np.random.default_rng(3).integers(0, 256, 20_000, dtype=np.uint8).tobytes(), []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        tiff.lzw_encode(data)
    finally:
        sys.setprofile(None)
    assert len(calls) < 1000
