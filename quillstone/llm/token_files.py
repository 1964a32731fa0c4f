"""Token ids as Arrow stream files of equal-length sequences.

A shard is two Arrow IPC streams. ``shard-00007.arrow`` has record batches of ``batch_rows`` rows with the columns
``input_ids`` (fixed-size list of ``seq_len`` unsigned integers) and ``mask`` (fixed-size list of booleans, false on the
padding after the shard's last id). All batches but the last have the same size in bytes, and fixed-size lists have no
offsets, so sequence i lies at a computed place of a memory map. ``shard-00007.docs.arrow`` lists the documents in
order: doc_id, start (ids before it in this shard), n_tokens.

Documents lie in ascending doc_id order over all shards, each whole in one shard; the rows of one doc_id come in any order,
null ids come first. Null and empty texts have the end id alone. An empty table gives no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.store import n_buckets, released, shared_folder, small_batches
from quillstone.llm.wordtok import id_width, tokenizer

MANIFEST = "shard int, path string, docs_path string, n_docs long, n_tokens long, n_sequences long"


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI that Spark may spell in Hadoop's way."""
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def _open_out(uri: str):
    files, path = _files(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    return files, path, part


def _write_stream(uri: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> None:
    """Under a name of its own first: a task that is run again, or twice, leaves one whole file."""
    files, path, part = _open_out(uri)
    with files.open_output_stream(part) as out, pa.ipc.new_stream(out, schema) as writer:
        for b in batches:
            writer.write_batch(b)
    files.move(part, path)


def _open_stream(uri: str) -> pa.ipc.RecordBatchStreamReader:
    files, path = _files(uri)
    if isinstance(files, pafs.LocalFileSystem):
        return pa.ipc.open_stream(pa.memory_map(path))
    return pa.ipc.open_stream(files.open_input_stream(path))


def write_sequences(uri: str, parts: Iterator[np.ndarray], seq_len: int, dtype: np.dtype) -> int:
    """Writes a shard out of arrays of ids, each but the last a whole number of sequences; returns how many these are."""
    schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
    n = 0

    def batches():
        nonlocal n
        for part in parts:
            short = -len(part) % seq_len
            flat, mask = np.pad(part, (0, short)) if short else part, np.arange(len(part) + short) < len(part)
            n += len(flat) // seq_len
            yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), seq_len)], schema=schema)

    _write_stream(uri, schema, batches())
    return n


class TokenShard:
    """Random access to a shard's sequences: on a local disk they are views of the memory map."""

    def __init__(self, uri: str):
        self._batches = [b for b in _open_stream(uri)]
        self._rows = self._batches[0].num_rows if self._batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self._batches)

    def _values(self, k: int, column: int):
        list_ = self._batches[k].column(column)
        return list_.flatten() if list_.offset else list_.values

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (no copy) and mask of sequence i."""
        k, row = divmod(i, self._rows)
        n = self._batches[k].column(0).type.list_size
        ids = self._values(k, 0)[row * n : (row + 1) * n].to_numpy(zero_copy_only=True)
        return ids, self._values(k, 1)[row * n : (row + 1) * n].to_numpy(zero_copy_only=False)

    def ids(self) -> np.ndarray:
        """All ids without the padding."""
        parts = [self._values(k, 0).to_numpy(zero_copy_only=True)[self._values(k, 1).to_numpy(zero_copy_only=False)] for k in range(len(self._batches))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_ENCODED = "shard int, doc_id long, n_tokens int, ids binary"
_NULL = np.iinfo(np.int64).min


def _encoded(vocab: str, end_id: int, bounds: list[int]):
    """A row a document with its ids and its shard. A key that fills whole quantiles has that many shards, taken in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, edges, turn = tokenizer(vocab, end_id), np.array(bounds, np.int64), 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, counts = tok.encode(b.column("text"))
            keys = b.column("doc_id").fill_null(_NULL).to_numpy(zero_copy_only=False)
            first, stop = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
            shard = first + (turn + np.arange(len(keys))) % np.maximum(1, stop - first)
            turn += len(keys)
            offsets = np.concatenate([[0], counts.cumsum()]) * ids.itemsize
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.record_batch({"shard": pa.array(shard.astype(np.int32)), "doc_id": pa.array(keys), "n_tokens": pa.array(counts.astype(np.int32)), "ids": blobs})
        tok.forget()

    return released(run)


def _sequences(parts: Iterator[np.ndarray], seq_len: int, batch_rows: int, dtype: np.dtype) -> Iterator[np.ndarray]:
    """Cuts a stream of id arrays into arrays of ``batch_rows`` sequences and a last one that ends anywhere."""
    held, size, step = [], 0, seq_len * batch_rows
    for p in parts:
        held.append(p)
        size += len(p)
        while size >= step:
            flat = np.concatenate(held)
            yield flat[:step]
            held, size = [flat[step:]], size - step
    if size:
        yield np.concatenate(held)


def _shard_writer(folder: str, seq_len: int, batch_rows: int, width: int):
    """Writes the shards of rows that come in the order of shards and documents, a batch of sequences at a time."""

    def runs(batches):
        for b in batches:
            shard = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            yield from ((int(shard[x]), b.slice(x, y - x)) for x, y in zip(cuts, cuts[1:]) if y > x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(f"<u{width}")
        for shard, mine in groupby(runs(batches), key=lambda r: r[0]):
            keys, counts = [], []

            def parts(mine=mine, keys=keys, counts=counts):
                for _, b in mine:
                    keys.append(b.column("doc_id").to_numpy())
                    counts.append(b.column("n_tokens").to_numpy().astype(np.int64))
                    ids = b.column("ids").cast(pa.large_binary())
                    offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
                    yield np.frombuffer(ids.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype)

            at = f"{folder}/shard-{shard:07d}"
            sequences = write_sequences(f"{at}.arrow", _sequences(parts(), seq_len, batch_rows, dtype), seq_len, dtype)
            key, n = np.concatenate(keys), np.concatenate(counts)
            index = pa.record_batch([pa.array(key, mask=key == _NULL), pa.array(np.cumsum(n) - n), pa.array(n)], schema=_DOCS)
            _write_stream(f"{at}.docs.arrow", _DOCS, iter([index]))
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "path": [f"{at}.arrow"], "docs_path": [f"{at}.docs.arrow"], "n_docs": [len(key)], "n_tokens": [int(n.sum())], "n_sequences": [sequences]})

    return released(run)


def write_token_files(docs: DataFrame, vocab: str, end_id: int, folder: str | None = None, seq_len: int = 2048, batch_rows: int = 256, shards: int | None = None, shard_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and writes the shards; returns their manifest, read back from ``<folder>/manifest``.

    Ids are dealt to shards by quantiles of the id column, so a shard holds about 1/shards of the documents whatever the
    ids look like; an id (or null) that many rows share fills as many shards as it needs, its rows in any order. ``shards``
    is by default the texts' bytes over ``shard_bytes``. Only ids are shuffled, never texts; Spark sorts them and a task
    writes them as they come, so its memory is bounded by a batch, or by the longest text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark, "token-files")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if shards is None:
        shards = max(n_buckets(spark), -(-(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    cuts = [k / shards for k in range(1, shards)]
    key = F.coalesce("doc_id", F.lit(_NULL))
    bounds = (d.agg(F.percentile_approx(key, cuts, max(10_000, 20 * shards)).alias("q")).first().q if cuts else None) or []
    encoded = d.mapInArrow(_encoded(vocab, end_id, bounds), _ENCODED)
    dealt = encoded.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "ids")
    dealt.mapInArrow(_shard_writer(folder, seq_len, batch_rows, id_width(vocab)), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each shard's two streams side by side, a batch of sequences at a time."""
    for b in batches:
        for r in b.to_pylist():
            left, flats = np.zeros(0, np.uint32), _valid_ids(r["path"])
            for docs in _open_stream(r["docs_path"]):
                crcs = []
                for n in docs.column("n_tokens").to_numpy().tolist():
                    crc = 0
                    while n:
                        if not len(left):
                            left = next(flats)
                        crc = zlib.crc32(left[:n], crc)
                        n, left = n - len(left[:n]), left[n:]
                    crcs.append(crc)
                start = pa.array(docs.column("start").to_numpy() + r["base"])
                yield pa.record_batch({"doc_id": docs.column("doc_id"), "start": start, "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(crcs, pa.int64()), "shard": pa.array([r["shard"]] * docs.num_rows, pa.int32())})


def _valid_ids(uri: str) -> Iterator[np.ndarray]:
    for b in _open_stream(uri):
        yield b.column(0).flatten().to_numpy()[b.column(1).flatten().to_numpy(zero_copy_only=False)].astype("<u4")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start over all shards, n_tokens, ids_crc32 and shard.

    The running total goes over one row a shard; the files themselves are read by as many tasks as there are shards.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return rows.repartition(n_buckets(manifest.sparkSession), "shard").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
