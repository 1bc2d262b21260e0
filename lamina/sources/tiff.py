"""TIFF files page by page: classic and BigTIFF, strips and tiles, plain, LZW, Deflate or PackBits.

A directory is read without any pixels; lines of a page are read from the strips or tiles that
hold them, so a part of a page needs a part of the file. Samples are whole bytes, side by side or in planes.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np

#: Fixed values of the format: tags, and the size and struct letter of a field by its type.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FIELDS = {1: "B", 3: "H", 4: "I", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
PLAIN, LZW, DEFLATE, PACKBITS = 1, 5, (8, 32946), 32773
CLASSIC, BIG = 42, 43


class Page(NamedTuple):
    """One image: its size and type, and where the lists of its blocks' places and sizes stand."""

    height: int
    width: int
    samples: int
    dtype: str
    planes: bool
    compression: int
    predictor: int
    block: tuple[int, int]
    tiled: bool
    offsets: tuple[int, int, str]
    sizes: tuple[int, int, str]


def read_directory(file: BinaryIO) -> list[Page]:
    """All pages, from the chain of directories; ValueError for what can't be read."""

    def get(code: str, at: int) -> tuple:
        file.seek(at)
        data = file.read(struct.calcsize(order + code))
        if len(data) < struct.calcsize(order + code):
            raise ValueError("a TIFF file ends within its directory")
        return struct.unpack(order + code, data)

    file.seek(0)
    order = {b"II": "<", b"MM": ">"}.get(file.read(2))
    version = get("H", 2)[0] if order else None
    if version not in (CLASSIC, BIG):
        raise ValueError("not a TIFF file")
    big = version == BIG
    word, n_entries, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    at, pages, seen = get(word, 8 if big else 4)[0], [], set()
    while at:
        if at in seen:
            raise ValueError("a TIFF file's directories form a circle")
        seen.add(at)
        head = struct.calcsize(order + n_entries)
        count = get(n_entries, at)[0]
        fields: dict[int, tuple[int, int, str]] = {}
        for i in range(count):
            start = at + head + entry * i
            tag, kind, n = get("HH" + word, start)
            if kind in FIELDS:
                place = start + entry - inline
                size = struct.calcsize(f"{order}{n}{FIELDS[kind]}")
                fields[tag] = (place if size <= inline else get(word, place)[0], n, order + FIELDS[kind])
        first = lambda tag, default: get(fields[tag][2][1:], fields[tag][0])[0] if tag in fields else default  # noqa: B023, E731
        tiled = TILE_OFFSETS in fields
        places, sizes = (TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)
        height, width, bits = first(HEIGHT, 0), first(WIDTH, 0), first(BITS, 1)
        packed, predictor, kind = first(COMPRESSION, PLAIN), first(PREDICTOR, 1), KINDS.get(first(SAMPLE_FORMAT, 1))
        if places not in fields or sizes not in fields or bits not in (8, 16, 32, 64) or kind is None:
            raise ValueError(f"a TIFF page of {bits} bits, sample format {first(SAMPLE_FORMAT, 1)}, can't be read")
        if packed not in (PLAIN, LZW, PACKBITS, *DEFLATE) or predictor not in (1, 2) or (predictor == 2 and kind == "f"):
            raise ValueError(f"TIFF compression {packed} with predictor {predictor} can't be read")
        block = (first(TILE_HEIGHT, 0), first(TILE_WIDTH, 0)) if tiled else (min(first(ROWS, height), height), width)
        pages.append(Page(height, width, first(SAMPLES, 1), f"{order}{kind}{bits // 8}", first(PLANAR, 1) == 2, packed, predictor, block, tiled, fields[places], fields[sizes]))
        at = get(word, at + head + entry * count)[0]
    return pages


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, wider one code early."""
    clear, end = 256, 257
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(start), [], b""
    held = n_held = 0
    width = 9
    for byte in data:
        held, n_held = held << 8 | byte, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code, held = held >> n_held, held & ((1 << n_held) - 1)
        if code == end:
            break
        if code == clear:
            table, last, width = list(start), b"", 9
            continue
        if code > len(table) or not last and code >= clear:
            raise ValueError("broken LZW data")
        now = table[code] if code < len(table) else last + last[:1]
        out.append(now)
        if last:
            table.append(last + now[:1])
            width = max(9, min(12, (len(table) + 1).bit_length()))
        last = now
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 1 + (n > 128)
    return b"".join(out)


def _unpacked(page: Page, data: bytes) -> bytes:
    return {PLAIN: bytes, LZW: lzw, PACKBITS: packbits}.get(page.compression, zlib.decompress)(data)


def read_lines(file: BinaryIO, page: Page, y0: int, y1: int) -> np.ndarray:
    """(y, x, sample) of the lines y0 to y1 - 1, from the blocks that hold them."""
    height, width = page.block
    across, down = -(-page.width // width), -(-page.height // height)
    planes, own = (page.samples, 1) if page.planes else (1, page.samples)
    out = np.zeros((y1 - y0, page.width, page.samples), page.dtype)

    def listed(field: tuple[int, int, str], first: int, n: int) -> tuple:
        at, count, code = field
        if first + n > count:
            raise ValueError("a TIFF page has fewer blocks than its size asks for")
        size = struct.calcsize(code)
        file.seek(at + first * size)
        return struct.unpack(f"{code[0]}{n}{code[1]}", file.read(n * size))

    for plane in range(planes):
        first, last = y0 // height, (y1 - 1) // height + 1
        begin = (plane * down + first) * across
        places, sizes = (listed(f, begin, (last - first) * across) for f in (page.offsets, page.sizes))
        for i, (place, size) in enumerate(zip(places, sizes)):
            row, column = first + i // across, i % across
            file.seek(place)
            raw = _unpacked(page, file.read(size))
            lines = height if page.tiled else min(height, page.height - row * height)  # tiles are whole at the edges, strips end with the page
            block = np.frombuffer(raw, page.dtype, lines * width * own).reshape(lines, width, own)
            if page.predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
            a, b = max(y0, row * height), min(y1, row * height + lines)
            end = min(page.width, (column + 1) * width)
            part = block[a - row * height : b - row * height, : end - column * width]
            target = slice(plane, plane + 1) if page.planes else slice(None)
            out[a - y0 : b - y0, column * width : end, target] = part
    return out


def tiff_pages(data: bytes) -> Iterator[np.ndarray]:
    """(y, x, sample) of every page of a file in memory."""
    file = io.BytesIO(data)
    for page in read_directory(file):
        yield read_lines(file, page, 0, page.height)


def tiff_bytes(slices: np.ndarray, deflate: bool = True, planes: bool = False) -> bytes:
    """A little-endian TIFF of (z, y, x) or (z, y, x, sample), one strip a page or, with planes, a sample."""
    out = io.BytesIO()
    out.write(struct.pack("<2sHI", b"II", CLASSIC, 0))
    link = 4
    for page in slices:
        parts = [page] if page.ndim == 2 or not planes else list(np.moveaxis(page, -1, 0))
        samples = 1 if page.ndim == 2 else page.shape[2]
        start, sizes = out.seek(0, io.SEEK_END), []
        for part in parts:
            pixels = np.ascontiguousarray(part).astype(page.dtype.newbyteorder("<")).tobytes()
            sizes.append(out.write(zlib.compress(pixels) if deflate else pixels))
        out.write(b"\0" * (out.tell() % 2))

        def listed(code: str, values: list[int]) -> tuple[int, int]:
            """(count, value or place) of a list, which stands apart where it doesn't fit."""
            data = struct.pack(f"<{len(values)}{code}", *values)
            if len(data) <= 4:
                return len(values), int.from_bytes(data, "little")
            at = out.tell()
            out.write(data + b"\0" * (len(data) % 2))
            return len(values), at

        offsets = [start + sum(sizes[:i]) for i in range(len(sizes))]
        lists = {BITS: (3, *listed("H", [page.dtype.itemsize * 8] * samples)), STRIP_OFFSETS: (4, *listed("I", offsets)), STRIP_BYTES: (4, *listed("I", sizes))}
        single = {WIDTH: page.shape[1], HEIGHT: page.shape[0], ROWS: page.shape[0], COMPRESSION: DEFLATE[0] if deflate else PLAIN, 262: 2 if samples >= 3 else 1, SAMPLES: samples, PLANAR: 2 if planes else 1, SAMPLE_FORMAT: {"u": 1, "b": 1, "i": 2, "f": 3}[page.dtype.kind]}
        entries = sorted((lists | {tag: (4 if tag in (WIDTH, HEIGHT, ROWS) else 3, 1, value) for tag, value in single.items()}).items())
        at = out.tell()
        out.write(struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, *e) for tag, e in entries) + struct.pack("<I", 0))
        out.seek(link)
        out.write(struct.pack("<I", at))
        link = at + 2 + 12 * len(entries)
    return out.getvalue()
