"""Columns of numbers that travel as one binary value, and what is done with sorted columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Stands for the null id, before all others.
NULL_ID = np.iinfo(np.int64).min


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of equal length as one binary value."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(body: bytes, *kinds) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(body) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * size
    return out


def squeeze(*arrays: np.ndarray) -> bytes:
    """Columns of equal length as one compressed value."""
    body = pack(*arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def stretched(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)


def unpack_all(bodies: pa.ChunkedArray, *kinds, squeezed: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of many values one after the other, and how many rows each gave."""
    parts = [unpack(stretched(b) if squeezed else b, *kinds) for b in bodies.to_pylist()]
    if not parts:
        return [np.zeros(0, k) for k in kinds], np.zeros(0, np.int64)
    return [np.concatenate(x) for x in zip(*parts)], np.array([len(p[0]) for p in parts])


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def leads(fresh: np.ndarray) -> np.ndarray:
    """For each row the last one at or before it that is fresh."""
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0)) if len(fresh) else np.zeros(0, np.int64)


def cut(owner: np.ndarray) -> list[tuple[int, slice]]:
    """Slices of a sorted column, one per value."""
    heads = np.flatnonzero(changes(owner)) if len(owner) else np.zeros(0, int)
    stops = np.append(heads[1:], len(owner))
    return [(int(owner[a]), slice(a, b)) for a, b in zip(heads, stops)]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first+1, ... for `count` numbers each, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the rows, sorted, those that touch or overlap made one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    wide = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(row * wide + end)
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] * wide + start[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    stops = np.append(heads[1:], len(row)) - 1
    return row[heads], start[heads], reach[stops] - row[heads] * wide


def sorted_rows(part: pa.Table, columns: list[str]) -> pa.Table:
    """A part's rows in an order that doesn't depend on the shuffle."""
    return part.select(columns).sort_by([(c, "ascending") for c in columns])


def ids_of(rows: pa.Table) -> np.ndarray:
    return rows.column("doc_id").combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def by_part(part: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """(part, body): rows packed by the part that they are for."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    slices = cut(part)
    bodies = [pack(*(c[s] for c in columns)) for _, s in slices]
    return pa.table({"part": pa.array([p for p, _ in slices], pa.int32()), "body": pa.array(bodies, pa.binary())})
