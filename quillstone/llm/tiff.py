"""TIFF media columns: a reader that walks image directories and a writer for 8-bit grey pages.

The reader takes little- and big-endian files, any number of pages, strips or tiles, chunky samples of 8 or 16 bits,
compression none (1), LZW (5), deflate (8 and 32946) and PackBits (32773), and horizontal differencing (predictor 2).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import released, save, small_batches

# Fixed values of the TIFF 6.0 format: field types' sizes, tags and compression codes.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 284, 317, 322, 323, 324, 325
KNOWN = frozenset((WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES))
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257


class TiffError(ValueError):
    """The bytes are not a TIFF file that this reader takes."""


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """PackBits: a count byte n below 128 copies n+1 bytes, over 128 repeats one byte 257-n times, 128 does nothing.
    Decoders stop when they have ``most`` bytes."""
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits runs of equal bytes, other bytes literally."""
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        stop = at + 1
        while stop < len(data) and stop - at < 128 and (stop + 1 >= len(data) or data[stop] != data[stop + 1]):
            stop += 1
        out += bytes([stop - at - 1]) + data[at:stop]
        at = stop
    return bytes(out)


def unpack_lzw(data: bytes, most: int | None = None) -> bytes:
    """LZW with codes of 9 to 12 bits, high bit first; the width grows one code early."""
    out: list[bytes] = []
    size = 0
    table: list[bytes] = []
    bits = held = 0
    width, last = 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise TiffError("LZW data without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        size += len(entry)
        if most is not None and size >= most:
            break
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """The inverse of unpack_lzw, with a clear code whenever the table is full."""
    held = bits = 0
    out = bytearray()
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(LZW_CLEAR)
    table = {bytes([k]): k for k in range(256)}
    free, word = 258, b""
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = free
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        if free == 4094:
            put(LZW_CLEAR)
            table = {bytes([k]): k for k in range(256)}
            free, width = 258, 9
        word = data[k : k + 1]
    if word:
        put(table[word])
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    put(LZW_END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


#: How many bytes one stored byte can give: a bound of each format, which no valid block is over.
MOST_RATIO = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}


def _decoded(data: bytes, code: int, size: int) -> bytes:
    """The first ``size`` bytes of a block; never holds many more."""
    if size > len(data) * MOST_RATIO[code] + 64:
        raise TiffError("block is larger than its bytes can give")
    try:
        raw = data[:size] if code == NONE else unpack_bits(data, size) if code == PACKBITS else unpack_lzw(data, size) if code == LZW else zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(str(e)) from None
    if len(raw) < size:
        raise TiffError("block is too short")
    return raw[:size]


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen, held = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen or at + 2 > len(data) or len(seen) >= 65_536:
            raise TiffError("image directories are broken")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise TiffError("image directory is cut off")
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            place, size = at + 10 + 12 * k, TYPE_SIZES.get(kind, 0) * count
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if kind in TYPE_CODES and tag in KNOWN:
                held += size
                if place + size > len(data):
                    raise TiffError("field is cut off")
                if held > len(data):
                    raise TiffError("fields share bytes")
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, place)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _layout(tags: dict[int, tuple], size: int, max_bytes: int) -> dict:
    """The checked fields of a page: sizes, sample type, and the place and length of each block."""

    def one(tag: int, default: int | None = None) -> int:
        found = tags.get(tag) or (default,)
        if found[0] is None:
            raise TiffError(f"field {tag} is missing")
        return found[0]

    w, h, samples, bits, code, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if min(w, h, samples) < 1 or bits not in (8, 16) or len(set(tags.get(BITS) or (1,))) > 1 or one(PLANAR, 1) != 1:
        raise TiffError("size or sample layout isn't taken")
    if code not in MOST_RATIO or predictor not in (1, 2):
        raise TiffError(f"compression {code} or predictor {predictor}")
    if w * h * samples * bits // 8 > max_bytes:
        raise TiffError(f"page is over {max_bytes} bytes")
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    if min(bw, bh) < 1 or bw * bh * samples * bits // 8 > max_bytes:
        raise TiffError("block size isn't taken")
    offsets, sizes = (tags.get(o) or () for o in ((TILE_OFFSETS, TILE_SIZES) if tiled else (STRIP_OFFSETS, STRIP_SIZES)))
    across, down = -(-w // bw), -(-h // bh)
    if min(len(offsets), len(sizes)) < across * down:
        raise TiffError("blocks are missing")
    if any(o < 0 or n < 0 or o + n > size for o, n in zip(offsets, sizes)):
        raise TiffError("block is cut off")
    return {"w": w, "h": h, "samples": samples, "width": bits // 8, "code": code, "predictor": predictor, "tiled": tiled, "bw": bw, "bh": bh, "across": across, "down": down, "blocks": list(zip(offsets, sizes))}


def _layouts(data: bytes, max_bytes: int, max_file_bytes: int) -> list[tuple[str, dict]]:
    """Byte order and layout of each page, before anything is decoded. All pages together may take ``max_file_bytes``, and their
    blocks no more than the file has: directories that share blocks could decode to any size."""
    found, pixels, stored = [], 0, 0
    for order, tags in _directories(data):
        p = _layout(tags, len(data), max_bytes)
        size, held = p["w"] * p["h"] * p["samples"] * p["width"], sum(n for _, n in p["blocks"][: p["across"] * p["down"]])
        if held * MOST_RATIO[p["code"]] + 64 * len(p["blocks"]) < size:
            raise TiffError("page is larger than its bytes can give")
        pixels, stored = pixels + size, stored + held
        if pixels > max_file_bytes:
            raise TiffError("pages are too large together")
        if stored > len(data):
            raise TiffError("pages share blocks")
        found.append((order, p))
    return found


def read_pages(data: bytes, max_bytes: int = 1 << 28, max_file_bytes: int = 1 << 30) -> Iterator[np.ndarray]:
    """Pixels of each page as (height, width, samples), in the file's order. Whatever is wrong with the bytes raises
    TiffError, and no page over ``max_bytes``, or over what its blocks can decode to, is ever held. A file whose pages take
    over ``max_file_bytes`` together is refused before a page is decoded."""
    for order, p in _layouts(data, max_bytes, max_file_bytes):
        kind = np.uint8 if p["width"] == 1 else np.uint16
        page = np.zeros((p["h"], p["w"], p["samples"]), kind)
        for k in range(p["across"] * p["down"]):
            y, x = k // p["across"] * p["bh"], k % p["across"] * p["bw"]
            rows = p["bh"] if p["tiled"] else min(p["bh"], p["h"] - y)
            at, n = p["blocks"][k]
            count = rows * p["bw"] * p["samples"]
            raw = _decoded(data[at : at + n], p["code"], count * p["width"])
            block = np.frombuffer(raw, f"{order}u{p['width']}", count).reshape(rows, p["bw"], p["samples"]).astype(kind)
            if p["predictor"] == 2:
                block = np.cumsum(block, axis=1, dtype=kind)
            part = page[y : y + rows, x : x + p["bw"]]
            part[:] = block[: part.shape[0], : part.shape[1]]
        yield page


def write_pages(pages: list[tuple[np.ndarray, int, int, int]], strip_bytes: int = 1 << 16, big_endian: bool = False, level: int = 6) -> bytes:
    """A file of 8-bit grey pages. Each is (pixels of (height, width), compression, predictor, tile): square tiles of
    ``tile`` pixels, or with 0 strips of about ``strip_bytes``."""
    order, out = (">" if big_endian else "<"), bytearray()
    out += (b"MM" if big_endian else b"II") + struct.pack(order + "HI", 42, 8)
    deflate = lambda d: zlib.compress(d, level)
    packers = {NONE: bytes, DEFLATE: deflate, OLD_DEFLATE: deflate, PACKBITS: pack_bits, LZW: pack_lzw}
    for p, (page, compression, predictor, tile) in enumerate(pages):
        h, w = page.shape
        rows = tile or max(1, min(h, strip_bytes // w))
        cuts = [(y, x) for y in range(0, h, rows) for x in (range(0, w, tile) if tile else [0])]
        blocks = []
        for y, x in cuts:
            b = page[y : y + rows, x : x + tile] if tile else page[y : y + rows]
            if tile:
                b = np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1])))
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((b.shape[0], 1), np.uint8))
            blocks.append(packers[compression](np.ascontiguousarray(b).tobytes()))
        names = (TILE_OFFSETS, TILE_SIZES) if tile else (STRIP_OFFSETS, STRIP_SIZES)
        fields = {WIDTH: [w], HEIGHT: [h], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor], names[1]: [len(b) for b in blocks]}
        fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile]} if tile else {ROWS_PER_STRIP: [rows]}
        start, n = len(out), len(fields) + 1
        tail = start + 2 + 12 * n + 4
        data_at = tail + (8 * len(blocks) if len(blocks) > 1 else 0)
        starts = np.cumsum([data_at] + [len(b) for b in blocks])
        fields[names[0]] = [int(s) for s in starts[:-1]]
        extra, entries = b"", b""
        for tag in sorted(fields):
            v = fields[tag]
            place = struct.pack(order + "I", v[0]) if len(v) == 1 else struct.pack(order + "I", tail + len(extra))
            extra += struct.pack(f"{order}{len(v)}I", *v) if len(v) > 1 else b""
            entries += struct.pack(order + "HHI", tag, 4, len(v)) + place
        end = int(starts[-1]) + int(starts[-1]) % 2
        out += struct.pack(order + "H", n) + entries + struct.pack(order + "I", end if p + 1 < len(pages) else 0) + extra + b"".join(blocks)
        out += b"\0" * (end - len(out))
    return bytes(out)


PAYLOAD_WIDTH = 192


PAGE_ROWS, TILE = 1024, 64
#: Of 32 pages, one is stored by each of these; all others by deflate.
RARE_CODES = {0: LZW, 1: PACKBITS, 2: NONE, 3: OLD_DEFLATE}


def page_layout(pixels: bytes) -> tuple[int, int, int]:
    """Compression, predictor and tile size of a page, by a digest of its samples: equal pages are stored alike."""
    d = zlib.crc32(pixels)
    return RARE_CODES.get(d % 32, DEFLATE), 2 if d >> 8 & 15 == 0 else 1, TILE if d >> 12 & 15 == 0 else 0


def text_file(raw: bytes, level: int = 6) -> bytes:
    """A payload of whole rows as a TIFF file: pages of at most PAGE_ROWS rows, and for one payload in 16 a short first page."""
    d, rows = zlib.crc32(raw), len(raw) // PAYLOAD_WIDTH
    first = rows // 2 if d >> 16 & 15 == 0 else 0
    cuts = sorted({0, first, *range(first, rows, PAGE_ROWS), rows})
    parts = [raw[a * PAYLOAD_WIDTH : b * PAYLOAD_WIDTH] for a, b in zip(cuts, cuts[1:])]
    return write_pages([(np.frombuffer(p, np.uint8).reshape(-1, PAYLOAD_WIDTH), *page_layout(p)) for p in parts], big_endian=d >> 20 & 1 == 1, level=level)


def _encode(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                media, sizes = [], []
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode()
                    media.append(text_file(raw.ljust(max(1, -(-len(raw) // PAYLOAD_WIDTH)) * PAYLOAD_WIDTH, b" "), level))
                    sizes.append(len(raw))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())})

    return released(run)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """Stores each whole text as a TIFF file of pages of 192 samples a row: (doc_id, n_bytes, media), in the shared folder.

    The payload is the text's UTF-8 bytes, a null text's being empty, followed by blanks up to a positive multiple of
    192. Compression, predictor, strips or tiles, pages and byte order go by digests of the payload, so every decoder is
    in use and equal texts get equal media. Every row gets a row.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return save(d.mapInArrow(_encode(level), "doc_id long, n_bytes long, media binary"), "tiff-media", compression="none")


def _histogram(page: np.ndarray) -> np.ndarray:
    return np.bincount(page.ravel() >> (0 if page.dtype == np.uint8 else 8), minlength=256).reshape(16, 16).sum(1)


def _file_rows(key: int | None, size: int | None, media: bytes | None, max_bytes: int, max_file_bytes: int) -> list[tuple]:
    if media is None:
        return [(key, None, None, None, None, None, size, None, None, None, None, None, None, "null")]
    digest, rows, whole, tail, total, shares, sums = hashlib.sha256(media).hexdigest(), [], hashlib.sha256(), b"", 0, np.zeros(16, np.int64), 0
    try:
        for n, page in enumerate(read_pages(media, max_bytes, max_file_bytes)):
            flat = page.tobytes()
            whole.update(flat)
            tail, total, shares, sums = (tail + flat[-16:])[-16:], total + len(flat), shares + _histogram(page), sums + int(page.sum(dtype=np.int64))
            rows.append((n, page.shape[1], page.shape[0], len(flat), hashlib.sha256(flat).hexdigest()))
    except (TiffError, struct.error) as e:
        return [(key, None, None, None, None, None, size, None, None, None, len(media), digest, None, str(e))]
    feature = f"{len(rows)}x{rows[0][1]}:" + ",".join(map(str, shares.tolist())) + f":{sums}"
    return [(key, *r, size, total, whole.hexdigest(), zlib.crc32(tail), len(media), digest, feature, None) for r in rows]


PAGES = "doc_id long, page long, width long, height long, page_bytes long, page_sha256 string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
_PAGE_NAMES = [c.split(" ")[0] for c in PAGES.split(", ")]
_PAGE_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in PAGES.split(", ")]


def _pages(max_bytes: int, max_file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                columns = (b.slice(k, 256).column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
                rows = [r for each in zip(*columns) for r in _file_rows(*each, max_bytes, max_file_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PAGE_TYPES)] if rows else [pa.array([], t) for t in _PAGE_TYPES], _PAGE_NAMES)

    return released(run)


def tiff_pages(media: DataFrame, max_bytes: int = 1 << 28, max_file_bytes: int = 1 << 30) -> DataFrame:
    """One row per page of each file of (doc_id, n_bytes, media): the page's size and digest, and size, digests and feature
    of all samples of the file, pages one after another.

    The feature is the number and width of pages, a histogram of the samples' high four bits and their sum. Null media, bytes
    that are no readable TIFF, files with a page over ``max_bytes`` and files whose pages take over ``max_file_bytes`` together
    or share blocks give one row with ``error`` set and no page.
    """
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_pages(max_bytes, max_file_bytes), PAGES)
