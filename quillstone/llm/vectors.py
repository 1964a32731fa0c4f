"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to unit length, where a cosine of c is a distance of sqrt(2 - 2c). A table's key is ``per_table``
quantised projections floor((a.x + b) / width) with normal a and uniform b. With the defaults a pair at cosine 0.95 meets
in some of the tables with probability over 0.99, and closer pairs almost surely.

Equal vectors are one class before they are hashed. A bucket gives sums and a spanning set of links, never its pairs: each
linked pair is counted in the first table where it meets, and a class gets its number of links there and the smallest
class it reaches. Buckets over ``max_bucket`` classes are dealt out as pairs of slices, so none grows beyond a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import connected_components
from quillstone.llm.store import n_buckets, save, small_batches


class PStableTables:
    """The projections of all tables for vectors of one dimension."""

    def __init__(self, dim: int, tables: int, per_table: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.a = rng.standard_normal((dim, tables * per_table)) / width
        self.b = rng.random(tables * per_table)
        self.mix = rng.integers(1, 1 << 63, per_table, dtype=np.uint64) | np.uint64(1)
        self.shape = (tables, per_table)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One 64-bit key a table of each unit vector."""
        cell = np.floor(unit @ self.a + self.b).astype(np.int64).view(np.uint64).reshape(-1, *self.shape)
        h = (cell * self.mix).sum(axis=2, dtype=np.uint64)
        return (h ^ h >> np.uint64(29)).view(np.int64)


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_dim(raw: list[bytes]) -> dict[int, np.ndarray]:
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    return {int(n) // 8: np.flatnonzero(size == n) for n in np.unique(size)}


def _bucket_rows(tables: int, per_table: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("vec").to_pylist()
            keys = np.zeros((len(raw), tables), np.int64)
            for dim, at in _by_dim(raw).items():
                keys[at] = PStableTables(dim, tables, per_table, width, seed).keys(unit_rows([raw[k] for k in at]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch({"rep": b.column("rep"), "n": b.column("n"), "vec": b.column("vec"), "keys": lists})

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by ``columns``, cut so that no group is parted; a group is bounded by the caller."""
    rest = None
    for b in batches:
        b = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        codes = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1 if b.num_rows else []
        if len(changed):
            yield b.slice(0, int(changed[-1]))
            rest = b.slice(int(changed[-1]))
        else:
            rest = b
    if rest is not None and rest.num_rows:
        yield rest


def _candidates(stops: np.ndarray, side: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within groups that end at ``stops``, about a million at a time; of cross groups, pairs of two sides."""
    starts = np.concatenate([[0], stops[:-1]])
    sizes = stops - starts
    for n in np.unique(sizes[sizes > 1]):
        of = starts[sizes == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(of), step):
            a, b = (of[k : k + step, None] + i).ravel(), (of[k : k + step, None] + j).ravel()
            ok = ~cross[a] | (side[a] != side[b])
            yield a[ok], b[ok]


def _bucket_links(tables: int, per_table: int, width: float, seed: int, cosine: float):
    def first_meeting(raw: list[bytes], i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        unit = unit_rows([raw[k] for k in used])
        keys = PStableTables(unit.shape[1], tables, per_table, width, seed).keys(unit)
        i, j = back[: len(i)], back[len(i) :]
        out = np.empty(len(i), bool)
        for k in range(0, len(i), 100_000):
            s = slice(k, k + 100_000)
            out[s] = (keys[i[s]] == keys[j[s]]).argmax(axis=1) == t[s]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, ["t", "key", "s1", "s2"]):
            codes = np.array([b.column(c).to_numpy() for c in ("t", "key", "s1", "s2")])
            stops = np.append(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1, b.num_rows)
            t, rep, n = codes[0], b.column("rep").to_numpy(), b.column("n").to_numpy()
            side, cross, raw = b.column("mine").to_numpy(), codes[2] != codes[3], b.column("vec").to_pylist()
            dims = np.fromiter(map(len, raw), np.int64, len(raw))
            many = np.flatnonzero(np.repeat(np.diff(stops, prepend=0) > 1, np.diff(stops, prepend=0)))
            unit: dict[int, np.ndarray] = {}
            place = np.zeros(len(raw), np.int64)
            for d in np.unique(dims[many]):
                at = many[dims[many] == d]
                unit[d], place[at] = unit_rows([raw[k] for k in at]), np.arange(len(at))
            links = []
            for i, j in _candidates(stops, side, cross):
                for d, x in unit.items():
                    same = (dims[i] == d) & (dims[j] == d)
                    a, c = i[same], j[same]
                    near = np.einsum("ij,ij->i", x[place[a]], x[place[c]]) >= cosine
                    a, c = a[near], c[near]
                    if len(a):
                        keep = first_meeting(raw, a, c, t[a])
                        links.append((a[keep], c[keep]))
            if not links:
                continue
            i, j = np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
            members, back = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
            size = np.bincount(back, weights=np.concatenate([n[j], n[i]]), minlength=len(members)).astype(np.int64)
            label, u, v = np.arange(len(members)), back[: len(i)], back[len(i) :]
            while True:
                low, was = np.minimum(label[u], label[v]), label.copy()
                np.minimum.at(label, u, low)
                np.minimum.at(label, v, low)
                label = label[label]
                if (label == was).all():
                    break
            if len(members):
                yield pa.record_batch({"a": members, "b": members[label], "n": size})

    return run


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.95, tables: int = 32, per_table: int = 14, width: float = 2.0, seed: int = 7, max_bucket: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links (other rows at ``cosine`` or more), component_id, kept.

    Null, empty and zero vectors and such with null or non-finite components link with nothing, and so do vectors of
    different length, and rows with a null vec_id (whose component is null and which are not kept). Repeated rows count
    as rows each. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("e", lambda x: x != 0), F.lit(False))
    valid = v.where(good)
    classes = save(valid.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    packed = classes.mapInArrow(_packed, "rep long, n long, vec binary")
    hashed = save(packed.mapInArrow(_bucket_rows(tables, per_table, width, seed), "rep long, n long, vec binary, keys array<long>"), "vector-keys")
    # Only keys and class numbers are counted and joined; vectors follow to the buckets that more than one class shares.
    dealt = hashed.select("rep", F.posexplode("keys").alias("t", "key"))
    sized = dealt.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1")
    slices = F.when(F.col("m") > max_bucket, F.ceil(F.col("m") / (max_bucket // 2))).otherwise(1).cast("int")
    shared = save(dealt.join(sized, ["t", "key"]).select(F.col("t").cast("long").alias("t"), "key", "rep", slices.alias("slices")), "vector-buckets")
    sliced = shared.withColumn("mine", F.pmod(F.xxhash64("rep"), "slices").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sliced = sliced.select("t", "key", F.least("mine", "other").cast("long").alias("s1"), F.greatest("mine", "other").cast("long").alias("s2"), F.col("mine").cast("long").alias("mine"), "rep")
    sliced = sliced.join(hashed.select("rep", "n", "vec"), "rep")
    keys = ["t", "key", "s1", "s2"]
    work = sliced.repartition(n_buckets(spark), *keys).sortWithinPartitions(*keys)
    links = save(work.mapInArrow(_bucket_links(tables, per_table, width, seed, cosine), "a long, b long, n long"), "vector-links")
    placed = connected_components(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("n").alias("others"))
    found = classes.join(counts, classes["rep"] == counts["a"], "left").join(placed, F.col("rep") == F.col("node"), "left")
    found = found.select("e", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    result = valid.join(found, "e").select("vec_id", "n_links", "component_id")
    rest = v.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        e = b.column("e")
        flat = e.flatten().to_numpy(zero_copy_only=False)
        stops = np.cumsum(e.value_lengths().to_numpy(zero_copy_only=False))
        vec = [flat[s:t].astype("<f8").tobytes() for s, t in zip(np.concatenate([[0], stops[:-1]]), stops)] if len(e) else []
        yield pa.record_batch({"rep": b.column("rep"), "n": b.column("n"), "vec": pa.array(vec, pa.binary())})
