"""Language-model scores from an n-gram trie in Elias-Fano levels.

Words are lower-cased (A-Z); a text ends with one end token and begins after
two.  The model knows every pair and triple of words of the training rows, with
absolutely discounted, interpolated, quantised probabilities; what it holds
grows with them.  A triple a b c belongs to the shard of its middle word: there
all that is counted for a b c, for b c and for a b meets, so a shard builds the
trie of its words by itself, packs it, maps it, and scores the tokens that have
come with the counts.  One shuffle of tokens, as numbers of a small dictionary a
message, is all that training and scoring take.

A middle word that fills more than a shard is dealt over several by row.  Its
n-grams have one owner each all the same: every shard sends the distinct triples
and pairs that it saw of such words, with its counts, to the owner of their
context (a b) or pair (b c).  Owners add the counts of all shards up and send the
probabilities back, and the shards put them into their tries.  So there is one
model, whatever the number of shards or the order of rows.

The last resort, the probability of c alone, comes from the counts of all words
that make up at least `lookup` of all tokens (1/lookup at most, so the broadcast
has a bound); rarer words share what is left evenly there, and only there.  With
`rare_apart` they don't: where a rare word ends a triple its token is sent to its
block in two terms, where it is a middle word its count is sent there, and both
meet with the sums of the block's rows, so every word has its own probability.

Edge cases: null text is empty and is its end token alone; a null id has
remainder -1 and belongs to training; repeated rows count as often as they
occur; without training rows every count is 0; tokens of a long text are shards'
work like any others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .bodies import cut, pack, squeeze, stretched, unpack
from .common import drop_folder, fold, scratch, table, text_parts
from .eliasfano import Trie, context_codes, heads_of, quantise, restore

#: Hash that stands for the end token; words hash to other values but by accident.
END_HASH = np.uint64(0x5EED0E4D)
SENT = "shard int, hot boolean, block long, body binary"
#: What shards ask of owners, and the answers: triples, pairs, and (b, share) that all pairs of b take.
ASKED = "owner int, kind int, shard int, body binary"
TOLD = "shard int, kind int, owner int, body binary, b long, taken double"
TRIPLES, PAIRS, SHARES = 0, 1, 2
RESULT = "doc_id long, n_tokens long, n_known long, base double, score double"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, ids, offsets): the hashes of a block's distinct words, sorted, and the tokens of its texts as places there, ends included."""
    data, offsets = ta.buffers(column)
    data = ta.lower_ascii(data)
    starts, ends, rows = ta.word_spans(data, offsets)
    coded = ta.word_array(data, starts, ends).dictionary_encode()
    words, at = np.unique(np.append(ta.hashes_of(coded.dictionary), END_HASH), return_inverse=True)
    bounds = rows + np.arange(len(rows))
    ids = np.full(len(starts) + len(rows) - 1, at[-1], np.int32)
    inner = np.ones(len(ids), bool)
    inner[bounds[1:] - 1] = False
    ids[inner] = at[coded.indices.to_numpy()]
    return words, ids, bounds


class Lexicon:
    """Counts of frequent words, and what stands for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, ends: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.distinct, self.ends = total, distinct, ends

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(listed, count) of each word."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        listed = self.hashes[at] == hashes
        return listed, np.where(listed, self.counts[at], 0)

    def alone(self, count: np.ndarray) -> np.ndarray:
        """Probability of words with these counts by themselves."""
        return (count + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def unigram(self, hashes: np.ndarray) -> np.ndarray:
        """Probability of each word by itself; with one unknown word they sum to one."""
        listed, count = self.find(hashes)
        rest, others = self.total - int(self.counts.sum()), self.distinct - len(self.counts) + 1
        return np.where(listed, count + 0.5, (rest + 0.5 * others) / others) / (self.total + 0.5 * (self.distinct + 1))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): every token of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in ta.blocks(batch, "text", 8 << 20):
                words, ids, _ = tokens(block.column("text"))
                n = np.bincount(ids, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(words[n > 0].view(np.int64)), pa.array(n[n > 0])], ["h", "c"])
            ta.release()

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def lexicon_of(texts: DataFrame, lookup: float, shards: int) -> tuple[Lexicon, np.ndarray, np.ndarray]:
    """The lexicon, and the words that fill more than a shard with how many shards each."""
    spark = texts.sparkSession
    folder = scratch(spark, "word-counts")
    word_counts(texts).write.parquet(folder)
    counts = spark.read.schema("h long, c long").parquet(folder)
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total = int(total or 0)
    frequent = counts.where(F.col("c") >= max(1, int(np.ceil(lookup * total)))).toArrow()
    ends = counts.where(F.col("h") == int(END_HASH)).agg(F.sum("c")).first()[0]
    drop_folder(spark, folder)
    hashes, c = frequent.column("h").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    large = c * shards > total
    order = np.argsort(hashes[large])
    return Lexicon(hashes, c, total, int(distinct), int(ends or 0)), hashes[large][order], -(-c[large] * shards // max(total, 1))[order]


def home_of(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each middle word, or the first of its shards."""
    return (ta.mix64(words) % np.uint64(shards)).astype(np.int32)


def messages(learn: np.ndarray, words: np.ndarray, ids: np.ndarray, bounds: np.ndarray, lexicon: Lexicon, shards: int, hot: np.ndarray, slices: np.ndarray) -> Iterator[tuple[int, bool, bytes]]:
    """(shard, hot, body) of a block's tokens: a dictionary, then row, a, b, c and learn of each, by b, compressed.

    The dictionary has the steps between places in the lexicon, and the hashes of words that are not listed there.
    """
    end = int(np.searchsorted(words, END_HASH))
    b, a = np.full_like(ids, end), np.full_like(ids, end)
    b[1:], a[2:] = ids[:-1], ids[:-2]
    sizes = np.diff(bounds)
    b[bounds[:-1]] = a[bounds[:-1]] = end
    a[bounds[:-1][sizes > 1] + 1] = end
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    shard = home_of(words, shards)[b]
    many = np.zeros(len(b), bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        times = np.where(hot[at] == words, slices[at], 1)[b]
        many = times > 1
        deal = ta.mix64(row[many].astype(np.uint64) + ta.mix64(np.array([bounds[-1]], np.uint64))) % times[many].astype(np.uint64)
        shard[many] = (shard[many] + deal.astype(np.int32)) % shards
    shard = 2 * shard + many
    order = np.lexsort((b, shard))
    listed = lexicon.find(words)[0]
    place = np.searchsorted(lexicon.hashes, words)
    used, number = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    for s, at in cut(shard[order]):
        i = order[at]
        triple = (a[i], b[i], ids[i])
        for x in triple:
            used[x] = True
        known, other = np.flatnonzero(used & listed), np.flatnonzero(used & ~listed)
        own = np.concatenate((known, other))
        number[own] = np.arange(len(own))
        kind = np.uint16 if len(own) <= 1 << 16 and len(sizes) <= 1 << 16 else np.uint32
        head = np.array([len(known), len(other), len(i), np.dtype(kind).itemsize], np.int64)
        body = head.tobytes() + pack(np.diff(place[known], prepend=0).astype(np.uint32)) + pack(words[other]) + pack(*(x.astype(kind) for x in (row[i], *(number[x] for x in triple)))) + pack(np.packbits(learn[row[i]]))
        yield s // 2, s % 2 == 1, len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)
        used[own] = False


def read_message(body: bytes, lexicon: Lexicon) -> tuple[np.ndarray, ...]:
    """(dictionary, row, a, b, c, learn)."""
    body = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)
    known, other, n, size = np.frombuffer(body, np.int64, 4).tolist()
    at = 32 + 4 * known
    words = np.concatenate((lexicon.hashes[np.cumsum(np.frombuffer(body, np.uint32, known, 32), dtype=np.int64)], np.frombuffer(body, np.uint64, other, at)))
    at += 8 * other
    kind = {2: np.uint16, 4: np.uint32}[size]
    columns = unpack(body[at : at + 4 * size * n], kind, kind, kind, kind)
    learn = np.unpackbits(np.frombuffer(body, np.uint8, -1, at + 4 * size * n))[:n].astype(bool)
    return (words, *columns, learn)


class Gathered:
    """The tokens of a shard's messages: their distinct triples, sorted by b, a and c, and where each token's triple is."""

    def __init__(self, lexicon: Lexicon, messages: list[tuple[int, bytes]]):
        read = [(block, *read_message(body, lexicon)) for block, body in messages]
        self.words, at = np.unique(np.concatenate([r[1] for r in read]), return_inverse=True)
        starts = np.cumsum([0, *(len(r[1]) for r in read)])
        number = [at[s : s + len(r[1])] for s, r in zip(starts, read)]
        a, b, c = (np.concatenate([n[r[k]] for n, r in zip(number, read)]).astype(np.int32) for k in (3, 4, 5))
        learn = np.concatenate([r[6] for r in read])
        self.rows = [(r[0], r[2]) for r in read]
        v, self.middle = len(self.words), b
        order = np.lexsort((c, a, b)) if v >= 1 << 21 else np.argsort((b.astype(np.int64) * v + a) * v + c, kind="stable")
        a, b, c = a[order], b[order], c[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        triple = np.cumsum(fresh, dtype=np.int32) - 1
        self.a, self.b, self.c = (x[fresh].astype(np.int64) for x in (a, b, c))
        self.n = np.bincount(triple, learn[order], len(self.a)).astype(np.int64)
        self.of_token = np.empty(len(order), np.int32)
        self.of_token[order] = triple

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(b * words + c, n) of the distinct pairs, sorted."""
        pair = self.b * len(self.words) + self.c
        order = np.argsort(pair, kind="stable")
        heads = heads_of(pair[order])
        return pair[order][heads], np.add.reduceat(self.n[order], heads)

    def requests(self, owners: int) -> list[tuple[int, int, np.ndarray]]:
        """(kind, owner, places): triples by their context's owner, pairs by their own; places among this shard's."""
        w, v, out = self.words, len(self.words), []
        pair = self.pairs[0]
        own = (ta.mix64(w[self.b] + ta.mix64(w[self.a])) % np.uint64(owners), ta.mix64(w[pair // v] + ta.mix64(~w[pair % v])) % np.uint64(owners))
        for kind in (TRIPLES, PAIRS):
            order = np.argsort(own[kind], kind="stable")
            out += [(kind, owner, order[s]) for owner, s in cut(own[kind][order])]
        return out

    def columns(self, kind: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words and counts of some triples or pairs."""
        w, v = self.words, len(self.words)
        if kind == TRIPLES:
            return w[self.a[at]], w[self.b[at]], w[self.c[at]], self.n[at]
        pair, n = (x[at] for x in self.pairs)
        return w[pair // v], w[pair % v], n


def ask(lexicon: Lexicon, owners: int, group: pa.Table) -> pa.Table:
    """What a shard saw of words that are dealt over several, for the owners of their n-grams."""
    found = Gathered(lexicon, [*zip(group.column("block").to_pylist(), group.column("body").to_pylist())])
    made = [(owner, kind, squeeze(*found.columns(kind, at))) for kind, owner, at in found.requests(owners)]
    shard = group.column("shard")[0].as_py()
    return pa.table({"owner": pa.array([m[0] for m in made], pa.int32()), "kind": pa.array([m[1] for m in made], pa.int32()), "shard": pa.array([shard] * len(made), pa.int32()), "body": pa.array([m[2] for m in made], pa.binary())})


def answer(lexicon: Lexicon, discount: float, shards: int, group: pa.Table) -> pa.Table:
    """Rows of TOLD: the codes of each shard's triples and pairs, in the order in which it asked, from the counts of all."""
    asked = sorted(zip(group.column("kind").to_pylist(), group.column("shard").to_pylist(), group.column("body").to_pylist()), key=lambda x: x[:2])
    owner, out = group.column("owner")[0].as_py(), []
    for kind, columns in ((TRIPLES, (np.uint64, np.uint64, np.uint64, np.int64)), (PAIRS, (np.uint64, np.uint64, np.int64))):
        mine = [(shard, unpack(stretched(body), *columns)) for k, shard, body in asked if k == kind]
        if not mine:
            continue
        *words, n = (np.concatenate(x) for x in zip(*(c for _, c in mine)))
        # Sorted by b, then a and c, or c alone.
        order = np.lexsort(tuple(words[k] for k in ((2, 0, 1) if kind == TRIPLES else (1, 0))))
        words, n = [w[order] for w in words], n[order]
        fresh = np.ones(len(n), bool)
        fresh[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        at = np.empty(len(n), np.int64)
        at[order] = np.cumsum(fresh) - 1
        heads = np.flatnonzero(fresh)
        n, words = np.add.reduceat(n, heads), [w[heads] for w in words]
        if kind == TRIPLES:
            context = np.cumsum(np.append(True, (words[0][1:] != words[0][:-1]) | (words[1][1:] != words[1][:-1])))
            p3, left2 = context_codes(context, n, discount)
            codes = (p3, left2[context - 1])
        else:
            # Every time that a word is a middle one, it has occurred, and is followed by one token.
            total = lexicon.find(words[0])[1]
            codes = (quantise(np.where(n > 0, n - discount, 0) / np.maximum(total, 1)),)
            first = heads_of(words[0])
            taken = np.add.reduceat(restore(codes[0]), first)
            out += [(int(h), SHARES, owner, None, int(b), float(t)) for h, b, t in zip(home_of(words[0][first], shards), words[0][first].view(np.int64), taken)]
        sizes = np.cumsum([0, *(len(c[0]) for _, c in mine)])
        out += [(shard, kind, owner, pack(*(x[at[s:e]] for x in codes)), None, None) for (shard, _), s, e in zip(mine, sizes, sizes[1:])]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.float64())
    return pa.table({f.split()[0]: pa.array([o[i] for o in out], k) for i, (f, k) in enumerate(zip(TOLD.split(", "), kinds))})


def last_resort(lexicon: Lexicon, words: np.ndarray, rare_apart: bool) -> np.ndarray:
    """Probabilities of words by themselves; none for rare ones if these are added where their counts meet."""
    return np.where(lexicon.find(words)[0] | (not rare_apart), lexicon.unigram(words), 0)


def trie_from_codes(lexicon: Lexicon, rare_apart: bool, found: Gathered, owners: int, told: dict[tuple[int, int], bytes], shares: dict[int, float]) -> Trie:
    """The trie of a shard's part of dealt words, with the probabilities of their owners."""
    v, pair = len(found.words), found.pairs[0]
    p3, left2, p2 = np.zeros(len(found.a), np.uint16), np.zeros(len(found.a), np.uint16), np.zeros(len(pair), np.uint16)
    for kind, owner, places in found.requests(owners):
        if kind == TRIPLES:
            p3[places], left2[places] = unpack(told[kind, owner], np.uint16, np.uint16)
        else:
            p2[places] = unpack(told[kind, owner], np.uint16)[0]
    left1 = np.zeros(v, np.uint16)
    middle = np.unique(found.b)
    left1[middle] = quantise(1 - np.array([shares[h] for h in found.words[middle].view(np.int64).tolist()]))
    heads = heads_of(found.b * v + found.a)
    return Trie(Trie.pack(v, quantise(last_resort(lexicon, found.words, rare_apart)), left1, pair, p2, found.a, found.b, found.c, left2[heads], p3))


def score_shard(lexicon: Lexicon, discount: float, owners: int, rare_apart: bool, group: pa.Table, replies: pa.Table) -> pa.Table:
    """Sums of each block's rows over a shard's tokens: row, known words, base and score, packed; and what rare words need."""
    rows = [*zip(*(group.column(c).to_pylist() for c in ("shard", "hot", "block", "body")))]
    # What a block says of its rows goes on as it is.
    out = [(block, b"M" + body) for shard, _, block, body in rows if shard < 0]
    sums: dict[int, list] = {}
    for dealt in (False, True):
        mine = [(block, body) for shard, hot, block, body in rows if shard >= 0 and hot == dealt]
        if not mine:
            continue
        found = Gathered(lexicon, mine)
        words, a, b, c, n = found.words, found.a, found.b, found.c, found.n
        seen = n > 0
        if dealt:
            kinds, owner, body, word, taken = (replies.column(x).to_pylist() for x in ("kind", "owner", "body", "b", "taken"))
            told = {(k, o): x for k, o, x in zip(kinds, owner, body) if k != SHARES}
            trie = trie_from_codes(lexicon, rare_apart, found, owners, told, {w: t for k, w, t in zip(kinds, word, taken) if k == SHARES})
        else:
            trie = Trie(Trie.build(len(words), last_resort(lexicon, words, rare_apart), a[seen], b[seen], c[seen], n[seen], discount))
        score = np.concatenate([trie.probability(a[s : s + 65536], b[s : s + 65536], c[s : s + 65536]) for s in range(0, len(a), 65536)])
        listed, count = lexicon.find(words)
        rare = ~listed & rare_apart
        open_ = np.flatnonzero(rare[c])
        number = np.full(len(c), -1)
        number[open_] = np.arange(len(open_))
        last, shorter, rest = words[c[open_]], score[open_], trie.rest(a[open_], b[open_])
        score[open_] = 1
        score = np.log10(score)
        # A word that is not listed has no other shard, so its count is the one here.
        count = np.where(listed, count, np.bincount(b[seen], n[seen], len(words)).astype(np.int64))
        is_end = words == END_HASH
        base = np.where(is_end, np.log10(lexicon.ends + 0.5), np.log10(count + 0.5))
        known = np.where(is_end, lexicon.ends > 0, count > 0).astype(np.float64)
        each, middle, number = score[found.of_token], found.middle, number[found.of_token]
        del a, b, c, n, seen, trie, score
        at = 0
        for block, row in found.rows:
            own = slice(at, at + len(row))
            at += len(row)
            sums.setdefault(block, []).append((row, known[middle[own]], base[middle[own]], each[own]))
            few = np.flatnonzero(number[own] >= 0)
            if len(few):
                at_ = number[own][few]
                out.append((block, b"R" + squeeze(row[few].astype(np.uint32), last[at_], shorter[at_], rest[at_])))
            told_of = np.unique(middle[own])
            told_of = told_of[rare[told_of]]
            if len(told_of):
                out.append((block, b"C" + squeeze(words[told_of], count[told_of])))
    for block, parts in sums.items():
        row, *columns = (np.concatenate(x) for x in zip(*parts))
        which, back = np.unique(row, return_inverse=True)
        k, x, y = (np.bincount(back, c, len(which)) for c in columns)
        out.append((block, b"S" + pack(which.astype(np.uint32), k.astype(np.uint32), x, y)))
    return pa.table({"block": pa.array([x for x, _ in out], pa.int64()), "body": pa.array([x for _, x in out], pa.binary())})


def row_sums(lexicon: Lexicon, group: pa.Table) -> pa.Table:
    """The rows of a block with what all shards have found."""
    bodies = group.column("body").to_pylist()
    meta = next(b for b in bodies if b[:1] == b"M")
    doc_id, has_id, n_tokens = unpack(meta[1:], np.int64, np.int64, np.int64)
    known, base, score = np.zeros(len(doc_id), np.int64), np.zeros(len(doc_id)), np.zeros(len(doc_id))
    # In a fixed order, so that sums do not depend on how the shuffle came in.
    for body in sorted(b for b in bodies if b[:1] == b"S"):
        row, k, x, y = unpack(body[1:], np.uint32, np.uint32, np.float64, np.float64)
        known[row] += k
        base[row] += x
        score[row] += y
    counts = [unpack(stretched(b[1:]), np.uint64, np.int64) for b in bodies if b[:1] == b"C"]
    if counts:
        words, n = (np.concatenate(x) for x in zip(*counts))
        order = np.argsort(words)
        words, n = words[order], n[order]
        for body in sorted(b for b in bodies if b[:1] == b"R"):
            row, last, shorter, rest = unpack(stretched(body[1:]), np.uint32, np.uint64, np.float64, np.float64)
            np.add.at(score, row, np.log10(shorter + rest * lexicon.alone(n[np.searchsorted(words, last)])))
    ids = pa.array(doc_id, mask=has_id == 0)
    return pa.table({"doc_id": ids, "n_tokens": pa.array(n_tokens), "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(score)})


def lm_scores(
    docs: DataFrame,
    learn: Column | None = None,
    lookup: float = 2.5e-7,
    discount: float = 0.75,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_bytes: int = 10 << 20,
    rare_apart: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs, learning from those where `learn` holds (all without it).

    score is the log10 probability of the text's tokens after the two before
    each; base_score that of single tokens with half a count added.  With
    `rare_apart` words under `lookup` have their own last resort as well.
    """
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), learn.alias("learn"))
    shards = text_parts(rows, "text", shard_bytes)
    lexicon, hot, slices = lexicon_of(rows.where("learn"), lookup, shards)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, hot, slices))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, hot, slices = shared.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in ta.blocks(batch, "text", 16 << 20):
                number += 1
                words, ids, bounds = tokens(block.column("text"))
                own = block.column("doc_id")
                made = [(-1 - number % shards, False, pack(own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds)))]
                made += messages(block.column("learn").to_numpy(zero_copy_only=False), words, ids, bounds, lexicon, shards, hot, slices)
                for few in (made[i : i + 64] for i in range(0, len(made), 64)):
                    arrays = [pa.array([m[0] for m in few], pa.int32()), pa.array([m[1] for m in few]), pa.array([number] * len(few), pa.int64()), pa.array([m[2] for m in few], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["shard", "hot", "block", "body"])
            ta.release()

    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def asking(group: pa.Table) -> pa.Table:
        return released(ask(shared.value[0], owners, group))

    def answering(group: pa.Table) -> pa.Table:
        return released(answer(shared.value[0], discount, shards, group))

    def meet(group: pa.Table, replies: pa.Table) -> pa.Table:
        return released(score_shard(shared.value[0], discount, owners, rare_apart, group, replies))

    def finish(group: pa.Table) -> pa.Table:
        return row_sums(shared.value[0], group)

    def deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The share of each dealt word, to all of its shards."""
        _, hot, slices = shared.value
        for batch in batches:
            own = batch.column("b").to_numpy().view(np.uint64)
            times = slices[np.searchsorted(hot, own)]
            row = np.repeat(np.arange(len(own)), times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            shard = (home_of(own, shards)[row] + step) % shards
            n, none = len(row), pa.nulls(len(row), pa.int32())
            columns = [pa.array(shard, pa.int32()), pa.array(np.full(n, SHARES), pa.int32()), none, pa.nulls(n, pa.binary()), batch.column("b").take(pa.array(row)), batch.column("taken").take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in TOLD.split(", ")])

    sent = rows.mapInArrow(send, SENT).repartition(shards, "shard")
    if len(hot):
        told = sent.where(kept(F.col("hot"))).groupBy("shard").applyInArrow(asking, ASKED).groupBy("owner").applyInArrow(answering, TOLD).repartition(shards, "shard")
        taken = told.where(kept(F.col("kind") == SHARES)).groupBy("b").agg(F.sum("taken").alias("taken"))
        replies = told.where(kept(F.col("kind") != SHARES)).unionByName(taken.mapInArrow(deliver, TOLD))
    else:
        replies = docs.sparkSession.createDataFrame([], TOLD)
    found = sent.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(meet, "block long, body binary").groupBy("block").applyInArrow(finish, RESULT)
    whole = float(np.log10(lexicon.total + 0.5 * (lexicon.distinct + 1)))
    return found.select(
        "doc_id", "n_tokens", "n_known", F.lit(lexicon.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score"
    )


def kept(condition: Column) -> Column:
    """The condition, in a form that is not moved below a shuffle, so that the shuffle is one for all who read it."""
    return F.when(F.monotonically_increasing_id() >= 0, condition)


def released(made: pa.Table) -> pa.Table:
    ta.release()
    return made


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm_scores(docs, fold("doc_id") != 1, rare_apart=True)
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_lm_score": op4_lm_score}
ORACLES: dict[str, str] = {}
