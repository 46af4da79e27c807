"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

Units are words, letters only (some digits and signs read as the letters they
stand for); single letters that stand next to each other are read as one word.
Two units are as alike as the gapped subsequences of three symbols they share:
each counts decay^span in each unit, so inserted or left-out characters lower
the likeness but don't end it.  Landmark units span the feature space (the
kernel matrix among them, inverted and rooted, maps kernel values to features);
a squared-hinge SVM is trained there on the sentences of labelled documents:
of a toxic document its most suspicious unit, of clean ones their most
suspicious units and a fixed number of others, over a few rounds.  A document's
margin is that of its worst unit, made a probability by a fitted logistic.

A trained model is linear in the subsequences, so it ships as one table of
weights and scoring is a few table look-ups per subsequence.

Edge cases: null and empty text have no units and get the score of the lowest
margin; without labels of both kinds every score is 0; units longer than
`MAX_UNIT` are read through overlapping windows, so all of a text counts;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import fold, table

SYMBOLS = 32
MAX_UNIT, STRIDE = 24, 12
MAX_SPAN, DECAY = 8, 0.7

_SYMBOL = np.full(256, 255, np.uint8)
for _b in range(26):
    _SYMBOL[ord("a") + _b] = _SYMBOL[ord("A") + _b] = _b
for _sign, _letter in zip("013457@$", "oieastas"):
    _SYMBOL[ord(_sign)] = ord(_letter) - ord("a")
_SYMBOL[0x80:0xC0] = 26 + np.arange(0x40) % 6


@lru_cache(maxsize=None)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all three-symbol subsequences of n symbols within the span, and their weights, of length one together."""
    found = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + MAX_SPAN))]
    i, j, k = np.array(found).T
    weight = DECAY ** (k - i + 1.0)
    return i, j, k, (weight / np.sqrt((weight**2).sum())).astype(np.float32)


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, sizes, row) of the units of a block of texts, those under three symbols left out."""
    data, offsets = ta.buffers(column)
    starts, ends, rows = ta.word_spans(data, offsets)
    mapped = _SYMBOL[data]
    keep = mapped < 255
    before = np.concatenate(([0], np.cumsum(keep)))
    a, b = before[starts], before[ends]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    single = b - a == 1
    lead = np.ones(len(a), bool)
    lead[1:] = ~(single[1:] & single[:-1] & (owner[1:] == owner[:-1]))
    first = np.flatnonzero(lead)
    last = np.append(first[1:], len(a)) - 1 if len(a) else first
    begin, size, owner = a[first], b[last] - a[first], owner[first]
    parts = np.where(size > MAX_UNIT, -(-(size - MAX_UNIT) // STRIDE) + 1, 1)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, size, owner = (np.repeat(x, parts) for x in (begin, size, owner))
    shift = np.minimum(step * STRIDE, np.maximum(size - MAX_UNIT, 0))
    begin, size = begin + shift, np.minimum(size, MAX_UNIT)
    enough = size >= 3
    return mapped[keep], begin[enough], size[enough], owner[enough]


def by_length(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(unit numbers, subsequence codes, weights) for units of one length at a time."""
    for n in np.unique(sizes).tolist():
        i, j, k, weight = triples(n)
        chosen = np.flatnonzero(sizes == n)
        step = max(1, 250_000 // len(i))
        for at in range(0, len(chosen), step):
            few = chosen[at : at + step]
            letters = symbols[starts[few][:, None] + np.arange(n)].astype(np.int32)
            yield few, (letters[:, i] * SYMBOLS + letters[:, j]) * SYMBOLS + letters[:, k], weight


def unit_margins(weights: np.ndarray, bias: float, symbols, starts, sizes) -> np.ndarray:
    out = np.full(len(starts), bias, np.float32)
    for few, codes, weight in by_length(symbols, starts, sizes):
        out[few] += weights[codes] @ weight
    return out


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units given as strings of symbols."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbols = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return symbols, np.cumsum(sizes) - sizes, sizes


def landmark_table(landmarks: list[str]) -> np.ndarray:
    """Subsequence weights of each landmark, a column each."""
    out = np.zeros((SYMBOLS**3, len(landmarks)), np.float32)
    for few, codes, weight in by_length(*encode(landmarks)):
        for unit, row in zip(few, codes):
            np.add.at(out[:, unit], row, weight)
    return out


def kernel(words: list[str], table_: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), table_.shape[1]), np.float32)
    for few, codes, weight in by_length(*encode(words)):
        for at in range(0, len(few), 256):
            out[few[at : at + 256]] = np.einsum("utm,t->um", table_[codes[at : at + 256]], weight)
    return out


@dataclass(frozen=True)
class Model:
    """weights per subsequence code, a bias, and the logistic's slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, column: pa.Array) -> np.ndarray:
        """The margin of each text's worst unit; that of a unit without known subsequences if there is none."""
        symbols, starts, sizes, owner = units(column)
        out = np.full(len(column), self.bias, np.float32)
        if len(starts):
            prefix = ta.BYTES.prefix(ta.BYTES.table[symbols])
            _, at, back = np.unique(ta.BYTES.spans(prefix, starts, starts + sizes), return_index=True, return_inverse=True)
            each = unit_margins(self.weights, self.bias, symbols, starts[at], sizes[at])[back]
            np.maximum.at(out, owner, each)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margins(column).astype(np.float64) + self.offset)))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge SVM, by Newton steps on the points inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    inside = np.ones(len(x), bool)
    for _ in range(25):
        a, c = x[inside], cost[inside][:, None]
        penalty = ridge * np.eye(len(w))
        penalty[-1, -1] = 1e-6
        w = np.linalg.solve(penalty + a.T @ (a * c), a.T @ (y[inside] * cost[inside]))
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit the labels, with a mild ridge."""
    target = (y > 0).astype(np.float64)
    weight = np.full(len(y), 1 / len(y))
    x = np.stack([margin, np.ones_like(margin)], 1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * np.array([w[0], 0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        w = w - np.linalg.solve(curve, gradient)
    return float(max(w[0], 0.1)), float(w[1])


def vocabulary(texts: pa.Array) -> tuple[list[str], tuple[np.ndarray, np.ndarray]]:
    """Distinct units as strings of symbols, and (text, unit) wherever a text has a unit; worked off in blocks."""
    known: dict[int, str] = {}
    rows, hashes, row = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for block in ta.blocks(pa.RecordBatch.from_arrays([texts], ["text"]), "text", 1 << 20):
        symbols, starts, sizes, owner = units(block.column(0))
        if len(starts):
            h = ta.BYTES.spans(ta.BYTES.prefix(ta.BYTES.table[symbols]), starts, starts + sizes)
            order = np.lexsort((h, owner))
            h, owner, starts, sizes = h[order], owner[order], starts[order], sizes[order]
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
            rows.append(owner[fresh] + row)
            hashes.append(h[fresh])
            found, at = np.unique(h, return_index=True)
            for x, a, n in zip(found.tolist(), starts[at].tolist(), sizes[at].tolist()):
                if x not in known:
                    known[x] = symbols[a : a + n].tobytes().decode("latin-1")
        row += block.num_rows
    names, index = np.unique(np.concatenate(hashes), return_inverse=True)
    return [known[x] for x in names.tolist()], (np.concatenate(rows), index)


def train(
    texts: pa.Array, labels: np.ndarray, landmarks: int = 64, rounds: int = 4, background: int = 20_000, candidates: int = 2000
) -> Model | None:
    """A model from labelled texts; None without both labels.

    Bounds of the fit, as its sample has one: landmarks are chosen among the `candidates` units that speak most for
    either label, and `background` units of clean texts stand for all of them beside their most suspicious ones.
    """
    if not (labels > 0).any() or not (labels <= 0).any():
        return None
    names, pairs = vocabulary(texts)
    toxic = labels > 0
    bad = np.bincount(pairs[1][toxic[pairs[0]]], minlength=len(names))
    good = np.bincount(pairs[1], minlength=len(names)) - bad
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    worth = odds * np.sqrt(bad)
    chosen = spread([names[i] for i in np.lexsort((np.arange(len(names)), -worth))[:candidates] if worth[i] > 0], landmarks * 3 // 4)
    taken = set(chosen)
    usual = [names[i] for i in np.lexsort((np.arange(len(names)), -good))[:candidates] if names[i] not in taken]
    chosen += spread(usual, landmarks - len(chosen))
    spanned = landmark_table(chosen)
    values, vectors = np.linalg.eigh(kernel(chosen, spanned).astype(np.float64) + 1e-4 * np.eye(len(chosen)))
    root = (vectors / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    heads = np.flatnonzero(np.concatenate(([True], pairs[0][1:] != pairs[0][:-1])))
    documents = pairs[0][heads]
    order = np.argsort(ta.mix64(np.arange(len(names)).astype(np.uint64)), kind="stable")
    calm = order[bad[order] == 0][:background]
    margin, w, bias = worth, np.zeros(len(chosen)), 0.0
    made = None
    for _ in range(rounds):
        worst = []
        for h, end in zip(heads, np.append(heads[1:], len(pairs[0]))):
            own = pairs[1][h:end]
            worst.append(own[np.argmax(margin[own])])
        worst = np.array(worst)
        positive = worst[toxic[documents]]
        negative = np.concatenate((worst[~toxic[documents]], calm))
        points, inverse = np.unique(np.concatenate((positive, negative)), return_inverse=True)
        plus = np.bincount(inverse[: len(positive)], minlength=len(points)) / max(len(positive), 1)
        minus = np.bincount(inverse[len(positive) :], minlength=len(points)) / len(negative)
        x = kernel([names[i] for i in points], spanned) @ root
        both = np.concatenate((plus, minus))
        keep = both > 0
        y = np.concatenate((np.ones(len(points)), -np.ones(len(points))))[keep]
        w, bias = svm(np.vstack([x, x])[keep], y, both[keep] * 1000)
        made = (spanned.astype(np.float64) @ (root @ w)).astype(np.float32)
        margin = unit_margins(made, bias, *encode(names))
    document = np.full(len(labels), bias)
    np.maximum.at(document, pairs[0], margin[pairs[1]])
    return Model(made, bias, *logistic(document, np.where(toxic, 1, -1)))


def spread(words: list[str], n: int, alike: float = 0.75) -> list[str]:
    """The first n words of which no two are too alike; if there are not enough, the others fill up.  The first 600 are compared."""
    chosen: list[str] = []
    if not words or n <= 0:
        return chosen
    words = words[:600]
    own = landmark_table(words)
    likeness = own.T @ own
    taken: list[int] = []
    for i in range(len(words)):
        if len(taken) < n and all(likeness[i, j] < alike for j in taken):
            taken.append(i)
    taken += [i for i in range(len(words)) if i not in set(taken)][: n - len(taken)]
    return [words[i] for i in taken]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """A model from at most `sample` labelled documents, those with the least hash of their ids.

    Labels of ids whose crc32 mod 5 is 0 are held out; null labels and ids are left out.  The sample meets in a task,
    whose memory is an executor's; the driver gets the model alone.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold(doc_id) != 0))
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), "id")
    rows = chosen.repartition(1).sortWithinPartitions("id", "text").select("label", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            sampled = pa.Table.from_batches(found)
            made = train(sampled.column("text").combine_chunks(), sampled.column("label").to_numpy())
            del found, sampled
            ta.release()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["model"])

    made = rows.mapInArrow(learn, "model binary").first()
    return pickle.loads(made.model) if made else None


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs` and `toxicity`, from 0 to 1, of each whole text; a column of that name is replaced."""
    docs = docs.drop("toxicity")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for block in ta.blocks(batch, text, 1 << 19):
                made = known.scores(block.column(text)) if known else np.zeros(block.num_rows)
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(made, pa.float64())], [*names, "toxicity"])
            ta.release()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, toxicity double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold("doc_id") == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
