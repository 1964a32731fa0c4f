"""SimHash near-duplicates found by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit b is set if it is set in over half of the 64-bit hashes of a text's word shingles.
Covering masks for radius r: bit positions get labels from the nonzero vectors of r+1 bits, and the mask of a nonzero
vector v keeps the positions whose label has an odd inner product with v. At most r differing positions span at most r
of the r+1 dimensions, so some v is orthogonal to all their labels and its mask hides every difference: each pair
within the radius meets in at least one of the 2^(r+1)-1 tables.

Fingerprints are made distinct before they enter the tables, and a table's bucket gives a spanning set of its links,
not all its pairs. A bucket over ``max_bucket`` fingerprints is dealt again by covering masks over the positions that
its own mask hides; what such a second bucket can still hold differs only in the positions that both masks hide.

``similar_documents`` goes by the Jaccard similarity of shingle sets instead: fingerprints within a wide radius are only
candidates, each of which is checked on the shingles themselves. Of two halves of 32 bits one holds at most half of the
differing bits, so covering masks for half the radius, over each half, keep the tables few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import connected_components
from quillstone.llm.store import released, save, small_batches, spare
from quillstone.llm.vectors import whole_groups

BITS = 64


def shingle_hashes(words: list[bytes], per_shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of words joined by blanks, repeats included; fewer words are one shingle, none give none."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= per_shingle:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], stops[:-per_shingle] + 1])
    return np.array([digest(joined[a:b], 42) for a, b in zip(first.tolist(), stops[per_shingle - 1 :].tolist())], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _words(text: str | None) -> list[bytes]:
    """A-Z are lowered and ASCII white space cuts."""
    return (text or "").encode().lower().split()


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """The majority of the shingles' hashes bit by bit; no words: 0."""
    return _majority(shingle_hashes(_words(text), words_per_shingle))


def fingerprints(text: str | Column, words_per_shingle: int = 3) -> Column:
    """The fingerprint of a whole text as a long (the same 64 bits); null and wordless texts get 0."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).astype(np.int64))

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(lambda them: map(of, them))(batches)

    return simhash(text)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions; labels are dealt round robin, so masks keep about half the positions."""
    size = 1 << radius + 1
    label = {p: 1 + k % (size - 1) for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (label[p] & v).bit_count() % 2) for v in range(1, size)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _spanning_links(radius: int):
    """Per bucket: for each fingerprint the smallest one reachable within the bucket by links; only true links count."""

    def labels(f: np.ndarray) -> np.ndarray:
        label = np.arange(len(f))
        pairs = []
        for k in range(0, len(f), 512):
            near = np.bitwise_count(f[k : k + 512, None] ^ f[None, :]) <= radius
            i, j = np.nonzero(near)
            pairs.append((i[j > i + k] + k, j[j > i + k]))
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            low, was = np.minimum(label[i], label[j]), label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == was).all():
                return label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_a, out_b = [], []
            for fps in b.column("fps"):
                f = np.sort(fps.values.to_numpy().view(np.uint64))
                label = labels(f)
                moved = label != np.arange(len(f))
                out_a.append(f[moved])
                out_b.append(f[label[moved]])
            if out_a:
                yield pa.record_batch({"a": np.concatenate(out_a).view(np.int64), "b": np.concatenate(out_b).view(np.int64)})

    return run


def fingerprint_links(fps: DataFrame, radius: int = 3, max_bucket: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct longs ``fp``, enough of them to join every two fingerprints within the radius."""
    small_batches(fps.sparkSession)
    masks = covering_masks(list(range(BITS)), radius)
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("t", "k"))
    sized = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = save(keyed.join(sized, ["t", "k"]), "simhash-buckets")
    small = shared.where(F.col("n") <= max_bucket).select(F.col("t").cast("long").alias("t"), "k", F.lit(0).cast("long").alias("k2"), "fp")
    again = [covering_masks([p for p in range(BITS) if not m >> p & 1], radius) for m in masks]
    table = F.array(*(F.array(*(F.lit(_signed(x)) for x in row)) for row in again))
    large = (
        shared.where(F.col("n") > max_bucket)
        .select("t", "k", "fp", F.posexplode(F.get(table, F.col("t"))).alias("t2", "mask"))
        .select((F.col("t") + F.lit(len(masks)) * (F.col("t2") + 1)).cast("long").alias("t"), "k", F.col("fp").bitwiseAND(F.col("mask")).alias("k2"), "fp")
    )
    buckets = small.union(large).groupBy("t", "k", "k2").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return buckets.select("fps").mapInArrow(_spanning_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over links of at most ``radius`` bits.

    Null, empty and blank texts share fingerprint 0, which links like any other. Repeated rows stay, each with the same
    result. A null doc_id stays null and names no component; texts that only such rows have get a null component. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    marked = save(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col).cast("string"), words_per_shingle).alias("fp")), "simhash")
    groups = save(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    return marked.join(fingerprint_components(groups, radius), "fp").select("doc_id", "fp", "component_id")


def fingerprint_components(groups: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) from distinct (fp, rep): components over fingerprints, then each one's smallest rep."""
    joined = connected_components(fingerprint_links(groups.select("fp"), radius))
    placed = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return placed.join(least, "component").select("fp", "component_id")


def part_masks(radius: int) -> list[int]:
    """Covering masks for half the radius over each half of the fingerprint. Labels are dealt from the largest down: for
    radius 10 or 11 these are the words of a Reed-Muller code, and every mask keeps 16 bits of its half or all 32."""
    size = 1 << radius // 2 + 1
    label = [size - 1 - k % (size - 1) for k in range(BITS // 2)]
    half = [sum(1 << p for p, x in enumerate(label) if (x & v).bit_count() % 2) for v in range(1, size)]
    return half + [m << BITS // 2 for m in half]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text with fewer words is one shingle, no words give none."""
    return np.unique(shingle_hashes(_words(text), words))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of the same shingles."""
    x = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sketch(text: str | None, per_shingle: int) -> tuple[int, int, int]:
    """Two independent fingerprints of the set of a text's shingles, and the hash of its words."""
    words = _words(text)
    found = np.unique(shingle_hashes(words, per_shingle))
    return _majority(found), _majority(_mixed(found)), xxhash.xxh64_intdigest(b" ".join(words), 42)


def _sketches(text: str, per_shingle: int) -> Column:
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = np.array([sketch(t, per_shingle) for t in texts], np.uint64).reshape(-1, 3).view(np.int64)
        return pd.DataFrame({"fp": rows[:, 0], "fp2": rows[:, 1], "node": rows[:, 2]})

    @F.pandas_udf("fp long, fp2 long, node long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(lambda them: map(of, them))(batches)

    return udf(text)


#: Minima that screen a candidate, a byte each. Of two sets with similarity 0.8 some 205 of 256 agree, give or take 6.4.
MINIMA = 256
_FACTORS = _mixed(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def minima(shingles: np.ndarray) -> bytes:
    """The lowest byte of the smallest hash of a set under each of MINIMA hash functions; zeros for the empty set."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[k : k + 4096, None] * _FACTORS[None, :]).min(axis=0))
    return (_mixed(least) & np.uint64(255)).astype(np.uint8).tobytes() if len(shingles) else bytes(MINIMA)


def _sets(text: str, words: int) -> Column:
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"shingles": [x.view(np.int64) for x in sets], "minima": [minima(x) for x in sets]})

    @F.pandas_udf("shingles array<long>, minima binary")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(lambda them: map(of, them))(batches)

    return udf(text)


def _least_agreement(similarity: float) -> float:
    """How many minima agree at the similarity, less five standard deviations."""
    return MINIMA * similarity - 5 * (MINIMA * similarity * (1 - similarity)) ** 0.5


def _agreeing(similarity: float):
    """Pairs (a, b) whose minima agree often enough."""
    least = _least_agreement(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                x, y = (np.stack([np.frombuffer(v, np.uint8) for v in part.column(c).to_pylist()]) for c in ("x", "y"))
                yield part.filter(pa.array((x == y).sum(axis=1) >= least)).select(["a", "b"])

    return run


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Rows of longs with ``fp``, each once a table, and a key in front, sorted by key and ``fp2`` within tasks."""
    schema = ", ".join(f"{c} long" for c in ["key", *rows.columns])
    return rows.mapInArrow(_by_tables(masks), schema).repartition("key").sortWithinPartitions("key", "fp2")


def _by_tables(masks: list[int]):
    """Each row once a table. The key is the table in its highest byte and below it a hash of the bits that the table's mask
    keeps; that two buckets may share a key costs comparisons only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, t = np.array(masks, np.uint64)[:, None], np.arange(len(masks), dtype=np.uint64)[:, None] << np.uint64(56)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                key = t | _mixed(part.column("fp").to_numpy().view(np.uint64)[None, :] & m) >> np.uint64(8)
                yield pa.record_batch({"key": key.ravel().view(np.int64)} | {c: np.tile(part.column(c).to_numpy(), len(masks)) for c in part.schema.names})

    return released(run)


def _buckets(batches: Iterator[pa.RecordBatch], few: int = 400_000) -> Iterator[list[np.ndarray]]:
    """Whole buckets of rows sorted by key, several at a time: the columns, and where each row's bucket stops."""
    held, size = [], 0

    def whole(rows: list[np.ndarray]) -> list[np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], np.diff(rows[0]) != 0]))
        length = np.diff(np.append(first, len(rows[0])))
        return [*rows, np.repeat(first + length, length)]

    for b in batches:
        rows = [b.column(c).to_numpy() for c in b.schema.names]
        held.append([c.view(np.uint64) if n in ("fp", "fp2") else c for n, c in zip(b.schema.names, rows)])
        size += len(rows[0])
        if size >= few:
            rows = [np.concatenate(c) for c in zip(*held)]
            # The last bucket's rows may go on in the next batch.
            cut = int(np.flatnonzero(rows[0] != rows[0][-1]).max(initial=-1)) + 1
            if cut:
                yield whole([c[:cut] for c in rows])
            held, size = [[c[cut:].copy() for c in rows]], size - cut
    if size:
        yield whole([np.concatenate(c) for c in zip(*held)])


def _sampled(radius: int, radius2: int, most: int = 256):
    """For each row with candidates of other components in its bucket the nearest one and one at random: (a, b, bits, c). Rows of
    buckets over ``most`` look at as many neighbours only, and all of them come, with themselves where these hold no candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, none = (1 << 31) - 1, np.iinfo(np.int64).max
        for _, fp, fp2, node, component, stop in _buckets(batches):
            i, best, any_ = np.arange(len(fp)), np.full(len(fp), none), np.full(len(fp), none)
            d = 1
            while d < most and len(i := i[i + d < stop[i]]):
                j = i + d
                one, two = np.bitwise_count(fp[i] ^ fp[j]), np.bitwise_count(fp2[i] ^ fp2[j])
                near = (one <= radius) & (two <= radius2) & (component[i] != component[j])
                x, y, bits = i[near], j[near], (one[near].astype(np.int64) + two[near]) << 32
                chance = (_mixed(fp2[x] ^ fp2[y] ^ fp[x]) >> np.uint64(33) << np.uint64(31)).view(np.int64)
                for u, v in ((x, y), (y, x)):
                    best[u], any_[u] = np.minimum(best[u], bits | v), np.minimum(any_[u], chance | v)
                d += 1
            _, bucket, size = np.unique(stop, return_inverse=True, return_counts=True)
            big = np.flatnonzero(size[bucket] > most)
            best[big], any_[big] = np.minimum(best[big], (200 << 32) | big), np.minimum(any_[big], none - 1 & ~low | big)
            found = np.flatnonzero(best < none)
            yield pa.record_batch({"a": node[found], "b": node[best[found] & low], "bits": best[found] >> 32, "c": node[any_[found] & low]})

    return released(run)


def _spanning(radius: int, radius2: int):
    """Edges (a, b) between the blobs of a bucket, rows of one blob being connected already: they connect any two rows of different
    components that are within both radii, and a bucket has fewer than it has blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fp, fp2, node, component, *blobs, stop in _buckets(batches):
            blob = blobs[0] if blobs else node  # without that column each row is one of its own
            order = np.lexsort((blob, stop))  # stable: the first row of each blob and bucket leads
            leads = np.concatenate([[True], (np.diff(blob[order]) != 0) | (np.diff(stop[order]) != 0)])
            first = np.empty(len(fp), np.int64)
            first[order] = order[leads][np.cumsum(leads) - 1]
            i, label, d = np.arange(len(fp)), first.copy(), 1
            while len(i := i[i + d < stop[i]]):
                j = i + d
                near = (label[i] != label[j]) & (component[i] != component[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (np.bitwise_count(fp2[i] ^ fp2[j]) <= radius2)
                x, y = i[near], j[near]
                while len(x):
                    u, v = label[x], label[y]
                    np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
                    while (label != (lower := label[label])).any():
                        label = lower
                    apart = label[x] != label[y]
                    x, y = x[apart], y[apart]
                d += 1
            moved = np.flatnonzero((first == np.arange(len(first))) & (label != first))
            yield pa.record_batch({"a": blob[moved], "b": blob[label[moved]]})

    return released(run)


def _verified(similarity: float):
    """True links (a, b) between rows of one group (s1 = s2) or of its two sides; components that a link joins are one from then on."""
    least, slices = _least_agreement(similarity), ["blob", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, slices):
            codes = np.array([b.column(c).to_numpy() for c in slices])
            stops = np.append(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1, b.num_rows).tolist()
            for first, stop in zip([0, *stops], stops):
                g = b.slice(first, stop - first)
                node, side, cross = g.column("node").to_numpy(), g.column("mine").to_numpy(), codes[1, first] != codes[2, first]
                _, label = np.unique(g.column("component").to_numpy(), return_inverse=True)
                m = np.stack([np.frombuffer(v, np.uint8) for v in g.column("minima").to_pylist()])
                sets = [x.values.to_numpy() for x in g.column("shingles")]
                out = []
                for k in range(0, len(m), 64):
                    i, j = np.nonzero((m[k : k + 64, None, :] == m[None, :, :]).sum(axis=2) >= least)
                    i += k
                    ok = (i < j) & (side[i] != side[j] if cross else True)
                    for x, y in zip(i[ok].tolist(), j[ok].tolist()):
                        if label[x] != label[y]:
                            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                            if common >= similarity * (len(sets[x]) + len(sets[y]) - common):
                                out.append((node[x], node[y]))
                                label[label == label[y]] = label[x]
                if out:
                    x, y = zip(*out)
                    yield pa.record_batch({"a": np.array(x), "b": np.array(y)})

    return released(run)


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, fingerprint_words: int = 3, radius: int = 11, radius2: int = 18, partners: int = 4, most: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, node, component, rep) for each row. Rows of one component are joined by pairs of texts whose sets
    of ``words``-word shingles have at least the Jaccard similarity; ``rep`` is the component's (no_id, doc_id, text_hash)
    with the smallest doc_id, ids before nulls.

    Candidates are all pairs whose fingerprints differ in at most ``radius`` bits, found by covering masks, and second
    fingerprints in at most ``radius2``, which keeps out the pairs of unrelated texts that are near by chance. Every link is
    checked on the shingles. Two rounds check each text with its nearest candidate and ``partners`` random ones, the second
    with those that the first has not joined it with; in a bucket of over ``most`` texts they look at some of each text's
    neighbours and keep all texts. Then the texts that candidates still connect are compared with each
    other, components that are joined being left out, within tasks: no pair is written that is no link. Texts of the same
    words are one node from the start.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marked = save(d.withColumn("s", _sketches("text", fingerprint_words)).select("doc_id", "text_hash", "s.*"), "similar")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = save(marked.groupBy("node").agg(F.min(order).alias("rep"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2")), "similar-nodes")
    masks = part_masks(radius)
    ordered = lambda pairs: pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, links, sets = nodes.select("fp", "fp2", "node", F.col("node").alias("component")), None, None
    for _ in range(2):
        met = _dealt(left, masks).mapInArrow(_sampled(radius, radius2, most), "a long, b long, bits long, c long")
        some = F.slice(F.array_sort(F.transform(F.collect_set("c"), lambda c: F.struct(F.xxhash64("a", c).alias("h"), c.alias("c")))), 1, partners)
        chosen = save(met.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b"), some.alias("some")), "similar-chosen")
        pairs = ordered(chosen.select("a", F.explode(F.concat(F.array("b"), F.transform("some", lambda x: x["c"]))).alias("b")))
        # Candidates are mutual, so whoever a later step looks at has met one here: texts are fetched and cut once.
        sets = _set_table(d, nodes, chosen.select(F.col("a").alias("node")), words) if sets is None else sets
        true = _checked(sets, save(pairs, "similar-pairs"), similarity)
        links = true if links is None else links.union(true)
        joined = save(connected_components(links), "similar-components")
        # A text that meets no candidate of another component has no more links to find.
        left = left.select("fp", "fp2", "node").join(chosen.select(F.col("a").alias("node")), "node", "left_semi").join(joined, "node", "left")
        left = save(left.select("fp", "fp2", "node", F.coalesce("component", "node").alias("component")), "similar-left")
    true = _compared(sets, _connected(left, masks, radius, radius2), similarity)
    joined = save(connected_components(links.union(true)), "similar-components")
    placed = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("rep"))
    named = placed.select("node", "component").join(least, "component")
    return marked.select("doc_id", "text_hash", "node").join(named, "node")


def _connected(left: DataFrame, masks: list[int], radius: int, radius2: int, each: int = 16) -> DataFrame:
    """(node, component, blob) of the texts that candidates connect with one of another component; a blob is named by a node.

    A large group meets in every table, and each would give it a spanning tree of its own. So every ``each``-th table comes first,
    and the others give edges only between what is not connected by then.
    """
    few = masks[::each]
    blobs = left.withColumn("blob", F.col("node"))
    for some in (few, [m for m in masks if m not in few]):
        edges = save(_dealt(blobs, some).mapInArrow(_spanning(radius, radius2), "a long, b long").distinct(), "similar-edges")
        wider = connected_components(edges).select(F.col("node").alias("blob"), F.col("component").alias("wider"))
        blobs = save(blobs.join(wider, "blob", "left").select(*left.columns, F.coalesce("wider", "blob").alias("blob")), "similar-blobs")
    shared = blobs.groupBy("blob").agg(F.count("*").alias("n")).where("n > 1")
    return blobs.join(shared, "blob", "left_semi").select("node", "component", "blob")


def _set_table(d: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles, minima) of the wanted nodes, from the text of one row each."""
    asked = save(nodes.join(wanted, "node").select(F.col("rep.doc_id").alias("of"), F.col("rep.text_hash").alias("hash"), "node"), "similar-asked")
    found = d.join(asked, (d["text_hash"] == asked["hash"]) & d["doc_id"].eqNullSafe(asked["of"])).select("node", "text")
    return save(found.select("node", _sets("text", words).alias("s")).select("node", "s.*").dropDuplicates(["node"]), "similar-sets")


def _checked(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes that have the similarity."""
    both = lambda p, c: p.join(sets.select(F.col("node").alias("a"), F.col(c).alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col(c).alias("y")), "b")
    screened = save(both(pairs, "minima").select("a", "b", "x", "y").mapInArrow(_agreeing(similarity), "a long, b long"), "similar-screened")
    common = F.size(F.array_intersect("x", "y"))
    return save(both(screened, "shingles").where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b"), "similar-links")


def _compared(sets: DataFrame, blobs: DataFrame, similarity: float, texts: int = 512, shingles: int = 1_000_000) -> DataFrame:
    """Links between the components within each blob of texts that candidates connect. A blob over ``texts`` texts or ``shingles``
    shingles is dealt out as pairs of slices, so that pairs are looked at within tasks of bounded size and never written."""
    sets = sets.join(blobs, "node")
    size = sets.groupBy("blob").agg(F.greatest(F.ceil(F.count("*") / texts), F.ceil(F.sum(F.size("shingles")) / shingles)).cast("int").alias("slices"))
    dealt = sets.join(size, "blob").withColumn("mine", F.pmod(F.xxhash64("node"), "slices").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    long = lambda c: c.cast("long")
    dealt = dealt.select("blob", long(F.least("mine", "other")).alias("s1"), long(F.greatest("mine", "other")).alias("s2"), long(F.col("mine")).alias("mine"), "node", "component", "minima", "shingles")
    return save(dealt.repartition("blob", "s1", "s2").sortWithinPartitions("blob", "s1", "s2").mapInArrow(_verified(similarity), "a long, b long"), "similar-links")


def without_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar documents: the first by doc_id (null ids last), then by the text's hash.

    Rows are told apart by id and text: a text whose id other rows have too is not lost with them. Of rows with the same
    id and text, one stays: the first by the hash of all columns.
    """
    found = similar_documents(docs, words, similarity, id_col=id_col, text_col=text_col)
    first = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash"))
    rows = save(found.groupBy("doc_id", "text_hash").agg(F.first(first).alias("first"), F.count("*").alias("n")).where("not first or n > 1"), "similar-rows")
    # A table of its own, as its size tells whether texts must be shuffled to it.
    firsts = save(rows.where("first").select("doc_id", "text_hash"), "similar-repeated")
    mine = docs.withColumn(spare(docs, "of"), F.col(id_col).cast("long")).withColumn(spare(docs, "hash"), F.xxhash64(F.col(text_col).cast("string")))
    of, hash_ = F.col(spare(docs, "of")), F.col(spare(docs, "hash"))
    same = lambda these: of.eqNullSafe(these["doc_id"]) & (hash_ == these["text_hash"])
    single = mine.join(rows, same(rows), "left_anti").select(*docs.columns)
    repeated = mine.join(firsts, same(firsts), "left_semi")
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = repeated.groupBy(of, hash_).agg(F.min_by(every, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("row")).select("row.*")
    return single.union(one)
