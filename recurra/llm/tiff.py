"""Reading and writing TIFF images of 8-bit samples in memory."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: tags, compression codes, and bytes per field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I"}
NAMES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals."""
    out = bytearray()
    values = np.frombuffer(data, np.uint8)
    if not len(values):
        return b""
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    sizes = np.diff(np.append(heads, len(values)))
    at = 0

    def literals(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(b, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for i in np.flatnonzero(sizes >= 3):
        head, size = int(heads[i]), int(sizes[i])
        literals(at, head)
        at = head + size
        while size:
            n = min(size, 128)
            out.extend((257 - n, data[head]) if n > 1 else (0, data[head]))
            size -= n
    literals(at, len(data))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


#: How many codes a table has given out where its codes become a bit longer; they have 9 bits at first and 12 at most.
WIDER = (254, 766, 1790)
CLEAR, END, FULL = 256, 257, 4094


def code_widths(first: int, n: int) -> np.ndarray:
    """Bits of a table's n codes from the one numbered `first` on."""
    return 9 + np.searchsorted(WIDER, np.arange(first, first + n), "right")


def code_bits(codes: list[int]) -> np.ndarray:
    """The bits of all codes of one table, high bit first."""
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return bits[np.arange(16) >= 16 - code_widths(0, len(codes))[:, None]]


OPENING = code_bits([CLEAR])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, the width growing one code early."""
    parts, codes, table, following = [OPENING], [], {}, 258
    known, prefix = table.get, data[0] if data else None
    for value in data[1:]:
        pair = prefix << 8 | value
        longer = known(pair)
        if longer is not None:
            prefix = longer
            continue
        codes.append(prefix)
        table[pair] = following
        following += 1
        if following == FULL:
            parts.append(code_bits([*codes, CLEAR]))
            codes, following = [], 258
            table.clear()
        prefix = value
    if data:
        codes.append(prefix)
    return np.packbits(np.concatenate([*parts, code_bits([*codes, END])])).tobytes()


def table_codes(data: np.ndarray, at: int, size: int) -> Iterator[tuple[list[int], int, int]]:
    """One table's codes from bit `at` on, in parts: (codes, place behind them, what closes the table, 0 if more follows).

    data has three bytes more than the `size` bits that count.
    """
    seen = 0
    while n := min(4096, (size - at) // 9):
        widths = code_widths(seen, n)
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, size, "right"))
        places, widths = ends[:n] - widths[:n], widths[:n]
        byte = places >> 3
        three = data[byte].astype(np.int64) << 16 | data[byte + 1].astype(np.int64) << 8 | data[byte + 2]
        codes = three >> (24 - (places & 7) - widths) & ((1 << widths) - 1)
        closing = np.flatnonzero((codes == CLEAR) | (codes == END))
        if len(closing):
            n = int(closing[0])
            yield codes[:n].tolist(), int(ends[n]), int(codes[n])
        if len(closing) or not n:
            return
        yield codes.tolist(), int(ends[n - 1]), 0
        at, seen = int(ends[n - 1]), seen + n


def lzw_decode(data: bytes) -> bytes:
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    values, out, at, closed = np.frombuffer(data + bytes(3), np.uint8), [], 0, CLEAR
    while closed == CLEAR:
        table, before, closed = list(start), b"", END
        for codes, at, closed in table_codes(values, at, 8 * len(data)):
            if codes and not before:
                before = table[codes.pop(0)]
                out.append(before)
            for code in codes:
                try:
                    entry = table[code]
                    table.append(before + entry[:1])
                except IndexError:
                    if code > len(table):
                        raise ValueError("broken LZW data") from None
                    entry = before + before[:1]
                    table.append(entry)
                out.append(entry)
                before = entry
    return b"".join(out)


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}
DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}


def difference(rows: np.ndarray) -> np.ndarray:
    """Horizontal differences by sample of (rows, width, samples)."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def summed(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(rows, axis=1, dtype=np.uint8)


#: What reading bytes that are no readable TIFF file may raise.
BROKEN = (ValueError, struct.error, KeyError, IndexError, TypeError, StopIteration, RuntimeError, MemoryError, OverflowError, zlib.error)


def blocks_of(page: np.ndarray, across: int, down: int, padded: bool) -> Iterator[np.ndarray]:
    """A page cut into strips or tiles, row by row; tiles are padded with zeros."""
    height, width, samples = page.shape
    for top in range(0, height, down):
        for left in range(0, width, across):
            block = page[top : top + down, left : left + across]
            if padded:
                whole = np.zeros((down, across, samples), np.uint8)
                whole[: block.shape[0], : block.shape[1]] = block
                block = whole
            yield block


def write(pages: list[np.ndarray], compression: str = "deflate", predictor: bool = False, rows_per_strip: int = 128, tile: int | None = None) -> bytes:
    """A little-endian file with one directory per (height, width, samples) page, in strips or in square tiles."""
    if tile is not None and (tile < 16 or tile % 16):
        raise ValueError("a tile's side is a multiple of 16")
    out = bytearray(b"II*\0" + bytes(4))
    link = 4
    code = NAMES[compression]
    for page in pages:
        height, width, samples = page.shape
        offsets, counts = [], []
        for rows in blocks_of(page, tile or width, tile or rows_per_strip, tile is not None):
            data = ENCODE[code]((difference(rows) if predictor else rows).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = {
            WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * samples), COMPRESSION: (3, [code]),
            PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [1 + predictor]),
        }
        if tile:
            tags |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)}
        else:
            tags |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [rows_per_strip]), STRIP_COUNTS: (4, counts)}
        fields = b""
        for tag, (kind, values) in sorted(tags.items()):
            data = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(data) > 4:
                out += bytes(len(out) % 2)
                data, place = struct.pack("<I", len(out)), data
                out += place
            fields += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out += bytes(len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + fields
        link = len(out)
        out += bytes(4)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tag -> values) of each image directory, in order; a loop of links is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        n = struct.unpack_from(f"{order}H", data, at)[0]
        tags = {}
        for i in range(n):
            place = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, place)
            if kind not in FIELD:
                continue
            form = f"{order}{count}{FIELD[kind]}"
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(f"{order}I", data, place + 8)[0]
            else:
                place += 8
            tags[tag] = struct.unpack_from(form, data, place)
        yield order, tags
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def pages(data: bytes) -> Iterator[np.ndarray]:
    """(height, width, samples) of 8-bit samples for each page."""
    for _, tags in directories(data):
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        samples = tags.get(SAMPLES, (1,))[0]
        if set(tags.get(BITS, (1,))) != {8}:
            raise ValueError("only 8-bit samples are read")
        decode = DECODE.get(tags.get(COMPRESSION, (NONE,))[0])
        if decode is None:
            raise ValueError("unknown compression")
        planes = samples if tags.get(PLANAR, (1,))[0] == 2 else 1
        depth = samples // planes
        tiled = TILE_OFFSETS in tags
        across = tags[TILE_WIDTH][0] if tiled else width
        down = tags[TILE_HEIGHT][0] if tiled else min(height, tags.get(ROWS_PER_STRIP, (height,))[0])
        offsets = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]
        counts = tags[TILE_COUNTS if tiled else STRIP_COUNTS]
        image = np.zeros((height, width, samples), np.uint8)
        blocks = iter(zip(offsets, counts))
        for plane in range(planes):
            for top in range(0, height, down):
                for left in range(0, width, across):
                    offset, count = next(blocks)
                    rows = down if tiled else min(down, height - top)
                    raw = np.frombuffer(decode(data[offset : offset + count]), np.uint8)
                    block = raw[: rows * across * depth].reshape(rows, across, depth)
                    if tags.get(PREDICTOR, (1,))[0] == 2:
                        block = summed(block)
                    room = block[: height - top, : width - left]
                    image[top : top + room.shape[0], left : left + room.shape[1], plane * depth : (plane + 1) * depth] = room
        yield image
