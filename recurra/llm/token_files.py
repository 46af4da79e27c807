"""Token ids as Arrow stream files of equal-length sequences, and their readers.

Documents are ranged by id, so the files, in order of their numbers, hold the ids
of all documents in ascending order.  A file is one stream of ids cut into
sequences of `length`: an Arrow file whose batches have two fixed-size-list
columns, `ids` and `mask`.  All batches but the last have the same number of
rows, so sequence i is row i % rows of batch i // rows, and a reader that maps
the file hands out views of it; nothing is parsed or copied.  Only a file's last
sequence is padded (mask false; a bit an id).  Beside each lies a file with one row per document:
where its ids start and how many it has.  Ids take two bytes where the
vocabulary allows it, else four.

A task writes under a name of its own and the table of written files, which
Spark commits, names the files that count; attempts that were lost or repeated
leave files that nothing names.  Files go to any store that Arrow has a driver
for, by the URI of the folder; only local ones can be mapped.

Tokenizer files that lower-case and drop white space are read in parts: the words
of a block are made distinct and cut into pre-tokens, and the library's model
encodes each distinct one.  Words with other letters than Latin-1's, and other
tokenizer files, go through the library whole.

Edge cases: null or empty text is the end id alone; null ids come first; rows
that repeat an id go by a hash of the text and then the text, and are documents
of their own; a hot id is dealt over several ranges by that hash; no rows give no files; strings of
added tokens have their ids; long texts are encoded in parts; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .bodies import spread
from .bpe import byte_of_char
from .common import scratch, table, text_parts

MANIFEST = "file int, ids_uri string, docs_uri string, n_ids long, n_docs long, sequences long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a pre-token is in the tokenizer files that are read in parts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def in_parts(spec: dict) -> bool:
    """Whether a tokenizer file composes, lower-cases and cuts texts as `parts_of` does, dropping white space."""
    made = lambda x, inner: [] if x is None else x.get(inner, [x])
    steps = [s["type"] for s in made(spec.get("normalizer"), "normalizers")]
    cuts = made(spec.get("pre_tokenizer"), "pretokenizers")
    added, model = spec.get("added_tokens", []), spec["model"]
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"]))) for t in added)
        and model["type"] == "BPE" and not model["dropout"] and not spec.get("truncation")
    )


#: Kinds of bytes: letters, digits, other printable ones; the rest has words go to the library whole.
_LETTER, _DIGIT, _OTHER, _REST = 0, 1, 2, 3
_KIND = np.full(256, _REST, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT


def parts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, part offsets, plain): the pre-tokens of plain words, in lower case; other words are one part, unchanged.

    Plain words are of printable ASCII and the letters from U+00C0 to U+00FF, whose first byte is 0xC3; they are
    composed already.  Words that may hold an added token are not plain.
    """
    n = len(data)
    before, after = np.append(np.uint8(0), data[:-1]), np.append(data[1:], np.uint8(0))
    kind = _KIND[data]
    kind[(data == 0xC3) & (after != 0x97) & (after != 0xB7)] = _LETTER
    accent = (before == 0xC3) & (data != 0x97) & (data != 0xB7)
    kind[accent] = _LETTER
    bad = (kind == _REST) | ((data == 0x3C) & (after == 0x7C))
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    plain = np.bincount(word[bad], minlength=len(offsets) - 1) == 0
    low = np.where(accent & (data <= 0x9E), data + np.uint8(0x20), ta.lower_ascii(data))
    data = np.where(plain[word], low, data)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    start[heads] = True
    first = np.zeros(n + 3, bool)  # of a word, so that what follows is known to be of the same
    first[heads] = True
    first[n:] = True
    # An apostrophe that begins a run of others takes one or two letters with it.
    quote = np.flatnonzero((data == 0x27) & start)
    c = [np.append(data, np.zeros(3, np.uint8))[quote + k] for k in (1, 2)]
    same = [~first[quote + 1], ~first[quote + 1] & ~first[quote + 2]]
    one = same[0] & np.isin(c[0], np.frombuffer(b"stmd", np.uint8))
    two = same[1] & np.logical_or.reduce([(c[0] == a) & (c[1] == b) for a, b in (b"re", b"ve", b"ll")])
    for taken, size in ((one, 1), (two, 2)):
        at = quote[taken]
        start[at + 1] = False
        start[(at + size + 1)[at + size + 1 < n]] = True
    start &= plain[word]
    start[heads] = True
    return data, np.append(np.flatnonzero(start), n), plain


class WordEncoder:
    """Ids of whole texts by the `tokenizers` library.

    Where the tokenizer file allows it, a text is cut into its pre-tokens here and the library's model encodes each
    distinct one; short ones are kept for later texts.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.parted = in_parts(json.load(f))
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        shown = {b: c for c, b in byte_of_char().items()}
        self.shown = {b: shown[b] for b in range(256)}
        self.kept: dict[bytes, bytes] = {}
        self.keep = keep
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens."""
        if len(self.kept) > self.keep:
            self.kept.clear()
        kept, tokenize, shown, code = self.kept, self.model.tokenize, self.shown, "H" if self.kind.itemsize == 2 else "I"
        out = [*map(kept.get, parts)]
        for i in [i for i, x in enumerate(out) if x is None]:
            part = parts[i]
            text = part.decode("latin-1")
            out[i] = ids = array(code, [t.id for t in tokenize(text if text.isascii() else text.translate(shown))]).tobytes()
            if len(part) <= 32:
                kept[part] = ids
        return out

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        data, bounds, plain = parts_of(data, offsets)
        owner = np.searchsorted(offsets, bounds[:-1], "right") - 1
        coded = ta.word_array(data, bounds[:-1], bounds[1:]).dictionary_encode()
        at, whole = coded.indices.to_numpy().astype(np.int64), ~plain[owner]
        # A word that goes to the library whole may look like a pre-token; it is numbered behind all of these.
        mine = np.unique(at[~whole])
        number = np.zeros(len(coded.dictionary), np.int64)
        number[mine] = np.arange(len(mine))
        each = self.parts(coded.dictionary.take(pa.array(mine)).to_pylist())
        others = coded.dictionary.take(pa.array(at[whole])).to_pylist()
        for i in range(0, len(others), 20_000):
            each += [x.tobytes() for x in self.encode([w.decode() for w in others[i : i + 20_000]])]
        number = number[at]
        number[whole] = len(mine) + np.arange(len(others))
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // self.kind.itemsize
        flat, first = np.frombuffer(b"".join(each), self.kind), np.cumsum(sizes) - sizes
        per_word = np.bincount(owner, sizes[number], len(words)).astype(np.int64)
        return flat[spread(first[number], sizes[number])], np.append(0, np.cumsum(per_word))

    def block(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block's texts, each with the end id behind it."""
        if not self.parted:
            each = [np.append(x, self.kind.type(end_id)) for x in self.encode([t or "" for t in texts.to_pylist()])]
            return (np.concatenate(each) if each else np.zeros(0, self.kind)), np.append(0, np.cumsum([len(x) for x in each])).astype(np.int64)
        data, offsets = ta.buffers(texts)
        starts, ends, rows = ta.word_spans(data, offsets)
        coded = ta.word_array(data, starts, ends).dictionary_encode()
        flat, bounds = self.words(coded.dictionary)
        # The end of a text is one more word with one id.
        flat = np.append(flat, self.kind.type(end_id))
        first, count = np.append(bounds[:-1], len(flat) - 1), np.append(np.diff(bounds), 1)
        order = np.insert(coded.indices.to_numpy().astype(np.int64), rows[1:], len(first) - 1)
        ends_at = rows[1:] + np.arange(1, len(rows))
        return flat[spread(first[order], count[order])], np.append(0, np.cumsum(count[order])[ends_at - 1])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """One for each Python worker, which outlives its tasks."""
    return WordEncoder(path)


class TokenWriter:
    """One file of sequences and its index, written as ids come in."""

    def __init__(self, folder: str, number: int, kind: np.dtype, length: int, rows: int):
        name = f"{number:07d}-{uuid.uuid4().hex}"
        self.uris = [f"{folder}/{name}.{x}.arrow" for x in ("ids", "docs")]
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        self.outs = [store.open_output_stream(f"{path}/{name}.{x}.arrow") for x in ("ids", "docs")]
        self.kind, self.length, self.rows = kind, length, rows
        item = pa.field("item", pa.from_numpy_dtype(kind), nullable=False)
        on = pa.field("item", pa.bool_(), nullable=False)
        self.schema = pa.schema([pa.field("ids", pa.list_(item, length), False), pa.field("mask", pa.list_(on, length), False)], {"length": str(length), "rows": str(rows)})
        self.ids = pa.ipc.new_file(self.outs[0], self.schema)
        self.docs = pa.ipc.new_file(self.outs[1], INDEX)
        self.number, self.held, self.waiting = number, [], 0
        self.n_ids = self.n_docs = self.sequences = 0

    def write(self, doc_id: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs.write_batch(pa.record_batch([doc_id, pa.array(offsets[:-1] + self.n_ids), pa.array(np.diff(offsets))], schema=INDEX))
        self.n_ids += len(ids)
        self.n_docs += len(offsets) - 1
        self.held.append(ids)
        self.waiting += len(ids)
        full = self.length * self.rows
        if self.waiting >= full:
            ids = np.concatenate(self.held)
            for at in range(0, len(ids) - full + 1, full):
                self.batch(ids[at : at + full], full)
            self.held = [ids[len(ids) - len(ids) % full :].copy()]
            self.waiting = len(self.held[0])

    def batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema)], schema=self.schema))
        self.sequences += len(ids) // self.length

    def close(self) -> pa.RecordBatch:
        """The row of MANIFEST."""
        if self.waiting:
            ids = np.concatenate(self.held)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.kind)
            padded[: len(ids)] = ids
            self.batch(padded, len(ids))
        for x in (self.ids, self.docs, *self.outs):
            x.close()
        row = [self.number, *self.uris, self.n_ids, self.n_docs, self.sequences]
        names = ["file", "ids_uri", "docs_uri", "n_ids", "n_docs", "sequences"]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3))], names)


def opened(uri: str):
    """A reader of an Arrow file; local ones are mapped."""
    store, path = fs.FileSystem.from_uri(uri)
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    return pa.ipc.open_file(source)


class TokenFile:
    """Random access to one written file."""

    def __init__(self, uri: str):
        self.reader = opened(uri)
        about = self.reader.schema.metadata
        self.length, self.rows = int(about[b"length"]), int(about[b"rows"])
        self.kind = self.reader.schema.field("ids").type.value_type.to_pandas_dtype()
        self.at, self.views = -1, ()

    def batch(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids by sequence, mask of all) of a batch as views of the file."""
        if i != self.at:
            ids, mask = self.reader.get_batch(i).columns
            self.views = ids.values.to_numpy(zero_copy_only=True).reshape(-1, self.length), mask.values
            self.at = i
        return self.views

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if not n else (n - 1) * self.rows + len(self.batch(n - 1)[0])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence i, without a copy."""
        ids, mask = self.batch(i // self.rows)
        return ids[i % self.rows], mask.slice(i % self.rows * self.length, self.length)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from a place of the stream on, as views, a batch at a time."""
        full = self.length * self.rows
        while n > 0:
            view = self.batch(start // full)[0].reshape(-1)[start % full : start % full + n]
            yield view
            start, n = start + len(view), n - len(view)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, length: int = 1024, rows: int = 256, doc_id: str = "doc_id", text: str = "text", file_bytes: int = 32 << 20
) -> DataFrame:
    """Write all documents under a folder that driver and executors share; returns the table of files, MANIFEST."""
    if length < 1 or rows < 1:
        raise ValueError("a sequence has at least one id, and a batch one sequence")
    spark = docs.sparkSession
    path = tokenizer or default_path()
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = text_parts(named, "text", file_bytes)
    keys = ("doc_id", F.xxhash64("text"), "text")
    ranged = named.repartitionByRange(parts, *keys[:2]).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encoder = None, None
        for batch in batches:
            for block in ta.blocks(batch, "text", 4 << 20):
                encoder = encoder or encoder_of(path)
                writer = writer or TokenWriter(folder, TaskContext.get().partitionId(), encoder.kind, length, rows)
                writer.write(block.column("doc_id"), *encoder.block(block.column("text"), end_id))
            ta.release()
        if writer:
            yield writer.close()

    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/files")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/files")


def with_starts(files: DataFrame, group: int = 1024) -> DataFrame:
    """The files with `base`, how many ids all files before them hold: a sum over groups of files, and one within each."""
    grouped = files.withColumn("group", F.floor(F.col("file") / group))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("group").agg(F.sum("n_ids").alias("n"))
    groups = groups.select("group", F.coalesce(F.sum("n").over(before(Window.orderBy("group"))), F.lit(0)).alias("sum_before"))
    within = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("group").orderBy("file"))), F.lit(0))
    return grouped.withColumn("within", within).join(groups, "group").select(*files.columns, (F.col("sum_before") + F.col("within")).alias("base"))


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids_uri, docs_uri, base in zip(*(c.to_pylist() for c in batch.columns)):
                file, index = TokenFile(ids_uri), opened(docs_uri)
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    crcs = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                        crc = 0
                        for view in file.ids(start, n):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    start = docs.column("start").to_numpy() + base
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(start), docs.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread_ = with_starts(files).select("ids_uri", "docs_uri", "base").repartition(F.col("ids_uri"))
    return spread_.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "token-files")))


QUERIES = {"op12_token_files": op12_token_files}
ORACLES: dict[str, str] = {}
