"""Texts stored as TIFF images, and TIFF columns read page by page.

Edge cases: null or empty bytes become one padded row; equal bytes give equal
files; rows may repeat; a null media value has no pages; one that isn't a readable
file gives a single row without a page that says why; a file is read whole, so a
text's pages are worked off together; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiff
from .common import table

ROW_BYTES = 192
CHUNK = 64


#: How "mixed" stores a text, by a hash of it: compression, predictor, side of tiles.
LAYOUTS = (("deflate", False, None), ("deflate", True, None), ("packbits", False, None), ("packbits", True, 64), ("lzw", False, None), ("lzw", True, 32), ("deflate", False, 16), ("none", False, None))


def encode_text(
    docs: DataFrame, compression: str = "deflate", predictor: bool = False, page_rows: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_bytes, media): UTF-8 bytes, padded with spaces to whole rows of 64 RGB pixels, as a TIFF file.

    With compression "mixed" a text's hash chooses among all compressions, with and without predictor, in strips and tiles.
    """
    if compression != "mixed" and compression not in tiff.NAMES:
        raise ValueError(f"compression is one of {sorted(tiff.NAMES)}, or mixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                few = batch.slice(i, CHUNK)
                sizes, files = [], []
                for value in few.column(1).cast(pa.binary()).to_pylist():
                    value = value or b""
                    rows = max(1, -(-len(value) // ROW_BYTES))
                    image = np.frombuffer(value.ljust(rows * ROW_BYTES, b" "), np.uint8).reshape(rows, ROW_BYTES // 3, 3)
                    cut = [image[a : a + page_rows] for a in range(0, rows, page_rows)]
                    sizes.append(len(value))
                    kind, differ, tile = LAYOUTS[zlib.crc32(value) % len(LAYOUTS)] if compression == "mixed" else (compression, predictor, None)
                    files.append(tiff.write(cut, kind, differ, tile=tile))
                arrays = [few.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [key, "n_bytes", "media"])

    chosen = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def read_pages(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per page: (key, page, width, height, samples, pixels, error), pixels row by row; error is null but for a value that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "page", "width", "height", "samples", "pixels", "error"]
        for batch in batches:
            for i in range(batch.num_rows):
                value, error = batch.column(1)[i].as_py(), None
                try:
                    found = [] if value is None else list(tiff.pages(value))
                except tiff.BROKEN as broken:
                    found, error = [None], f"{type(broken).__name__}: {broken}"
                if not found:
                    continue
                shape = [(None,) * 3 if x is None else x.shape for x in found]
                pages = [None if error else n for n in range(len(found))]
                arrays = [batch.column(0).take(pa.array([i] * len(found)))]
                arrays += [pa.array(c, pa.int32()) for c in (pages, *([x[j] for x in shape] for j in (1, 0, 2)))]
                pixels = pa.array([None if x is None else x.tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*arrays, pixels, pa.array([error] * len(found), pa.string())], names)

    chosen = media.select(F.col(key), F.col(column))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {kind}, page int, width int, height int, samples int, pixels binary, error string")


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def digest_media(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """What is read back from each file, all its pages in order, in the task that has it.

    feature: pages, rows, mean and spread of the samples, and how many values occur; of a file that can't be read, why.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                few = batch.slice(i, CHUNK)
                cols: list[list] = [[] for _ in range(7)]
                for value in few.column(2).to_pylist():
                    for c, x in zip(cols, digest(value)):
                        c.append(x)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
                arrays = [few.column(0), few.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, [key, "n_bytes", *(x.split()[0] for x in DIGEST.split(", "))])

    chosen = media.select(F.col(key), F.col("n_bytes"), F.col(column))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {kind}, n_bytes long, {DIGEST}")


def digest(value: bytes | None) -> tuple:
    if value is None:
        return (None,) * 7
    try:
        found = list(tiff.pages(value))
    except tiff.BROKEN as broken:
        return None, None, None, len(value), hashlib.sha256(value).hexdigest(), f"{type(broken).__name__}: {broken}", None
    payload = b"".join(x.tobytes() for x in found)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    total, levels = counts.sum(), np.arange(256)
    mean = float((counts * levels).sum() / total)
    spread = float(np.sqrt((counts * (levels - mean) ** 2).sum() / total))
    rows = sum(x.shape[0] for x in found)
    feature = f"pages={len(found)};rows={rows};mean={mean:.4f};spread={spread:.4f};values={np.count_nonzero(counts)}"
    return (
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-16:]),
        len(value),
        hashlib.sha256(value).hexdigest(),
        feature,
        len(found),
    )


def op3_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(encode_text(table(spark, sf_dir, "documents"), "mixed"))


QUERIES = {"op3_media_tiff": op3_media_tiff}
ORACLES: dict[str, str] = {}
