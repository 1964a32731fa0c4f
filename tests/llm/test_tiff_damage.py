import struct
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import tiff

LIMIT = 1 << 20


def files():
    rng = np.random.default_rng(7)
    page = (np.arange(40 * 64) % 251).astype(np.uint8).reshape(40, 64)
    for code in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS):
        for tile in (0, 16):
            for big in (False, True):
                yield tiff.write_pages([(page, code, 2, tile), (rng.integers(0, 5, (30, 48)).astype(np.uint8), code, 1, tile)], strip_bytes=700, big_endian=big)


def test_damaged_files_raise_only_tiff_errors_and_hold_no_page_over_the_bound():
    """10,000 files with changed, cut or added bytes, many of them in headers and directories."""
    rng, good, seen = np.random.default_rng(1), list(files()), Counter()
    tracemalloc.start()
    for k in range(10_000):
        raw = bytearray(good[k % len(good)])
        for _ in range(int(rng.integers(1, 6))):
            at = int(rng.integers(len(raw)))
            if rng.random() < 0.6:
                at = int(struct.unpack_from("<I" if raw[:2] == b"II" else ">I", raw, 4)[0] + rng.integers(0, 180)) % len(raw)
            raw[at] = int(rng.choice([0, 1, 255, 127, rng.integers(256)]))
        if k % 7 == 0:
            del raw[int(rng.integers(len(raw))) :]
        try:
            for page in tiff.read_pages(bytes(raw), LIMIT):
                assert page.nbytes <= LIMIT
            seen["read"] += 1
        except tiff.TiffError:
            seen["error"] += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen["read"] > 500 and seen["error"] > 2000 and peak < 64 * LIMIT


@pytest.mark.parametrize("tag,value", [(tiff.WIDTH, 0), (tiff.WIDTH, 1 << 31), (tiff.HEIGHT, 1 << 31), (tiff.SAMPLES, 60_000), (tiff.ROWS_PER_STRIP, 0), (tiff.BITS, 7), (tiff.COMPRESSION, 6), (tiff.PREDICTOR, 3), (tiff.STRIP_SIZES, 1 << 30)])
def test_bad_fields_are_errors(tag, value):
    raw = bytearray(tiff.write_pages([(np.zeros((3, 4), np.uint8), tiff.DEFLATE, 1, 0)]))
    n = struct.unpack_from("<H", raw, 8)[0]
    at = next(p for p in (10 + 12 * k for k in range(n)) if struct.unpack_from("<H", raw, p)[0] == tag)
    struct.pack_into("<I", raw, at + 8, value)
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(bytes(raw)))


def test_a_damaged_file_is_one_error_row_and_the_job_goes_on(spark):
    good = tiff.text_file(b"x" * 192 * 3000)
    bad = bytearray(good)
    bad[len(bad) // 2 :] = b""
    rows = {r.doc_id: r for r in tiff.tiff_pages(spark.createDataFrame([(1, 5, bytearray(good)), (2, 5, bad)], "doc_id long, n_bytes long, media binary")).where("page = 0 or error is not null").collect()}
    assert rows[1].payload_bytes == 192 * 3000 and rows[2].error and rows[2].payload_bytes is None


def chained(raw: bytes, n: int) -> bytes:
    """The one-page file with n more directories that are copies of its own, and so share its strips."""
    at = struct.unpack_from("<I", raw, 4)[0]
    size = 2 + 12 * struct.unpack_from("<H", raw, at)[0]
    first, out = len(raw) + len(raw) % 2, bytearray(raw + b"\0" * (len(raw) % 2))
    struct.pack_into("<I", out, at + size, first)
    for k in range(n):
        out += raw[at : at + size] + struct.pack("<I", first + (k + 1) * (size + 4) if k + 1 < n else 0)
    return bytes(out)


@pytest.mark.parametrize("n", [500, 65_536])
def test_directories_that_share_a_strip_are_refused_at_once(n):
    page = np.zeros((2000, 1920), np.uint8)
    page[::7] = np.arange(1920) % 251
    raw = chained(tiff.write_pages([(page, tiff.DEFLATE, 1, 0)], strip_bytes=1 << 23), n)
    began = time.process_time()
    with pytest.raises(tiff.TiffError, match="share|together|directories"):
        next(tiff.read_pages(raw))
    assert time.process_time() - began < 2
    row = tiff._file_rows(1, 5, raw, 1 << 28, 1 << 30)
    assert len(row) == 1 and row[0][-1] and row[0][1] is None


def test_pages_of_a_file_are_bounded_together():
    pages = [(np.full((100, 100), k, np.uint8), tiff.DEFLATE, 1, 0) for k in range(20)]
    raw = tiff.write_pages(pages)
    assert len(list(tiff.read_pages(raw, max_file_bytes=200_000))) == 20
    with pytest.raises(tiff.TiffError, match="together"):
        next(tiff.read_pages(raw, max_file_bytes=199_999))
