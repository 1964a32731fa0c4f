"""A BM25 index that stays: postings of the whole vocabulary, bucketed by term, to which chunks are added and from which they
are removed.

Three tables lie below the index's root. ``postings`` has a row a term and chunk of each segment, in buckets by the term's
hash and sorted by term, so that a search reads the buckets and row groups of its terms. ``chunks`` has a row a chunk with
its length and segment. A chunk that is removed or added anew is out because ``chunks`` doesn't name its segment, so no
posting is rewritten; ``compact`` does that when it is worth it. Document frequencies and lengths are counted from what is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.retrieval import FILE_ROWS, QUERY_TERMS, dealt_by_parts, term_counts, tokens
from quillstone.operators.sizes import broadcast_if_small
from quillstone.operators.versions import Versioned
from quillstone.sources.tables import save_table

#: Of the tokenizer and the layout: an index of another format isn't read.
FORMAT = 1


class LexicalIndex:
    """An index below ``root``; other columns of ``chunks`` than chunk_id and text are kept with each chunk for filters."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.n_buckets = spark, root.rstrip("/"), buckets
        self.chunks = Versioned(spark, f"{self.root}/format-{FORMAT}/chunks", ["chunk_id"], buckets=buckets)

    def _postings(self) -> str:
        return f"{self.root}/format-{FORMAT}/postings"

    def add(self, chunks: DataFrame) -> int:
        """Adds chunks (chunk_id, text, ...) or puts them in place of chunks with the same id; gives the segment's number. Null
        texts have no terms. Rows with a null id are left out, and of repeated ids the text that sorts first stays."""
        segment = self.chunks.version() + 1
        more = [c for c in chunks.columns if c not in ("chunk_id", "text")]
        one = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min_by(F.struct("text", *more), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(F.lit(0), *more))).alias("c")).select("chunk_id", "c.*")
        cut = save_table(one.withColumn("terms", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))).drop("text"), "index-terms")
        rows = cut.where(F.size("terms") > 0).select("chunk_id", F.inline(term_counts(F.col("terms"))))
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.n_buckets)).cast("int"))
        # A frequent term's postings go to several files of its bucket.
        dealt = placed.repartition(self.n_buckets, "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("bucket", "term", "chunk_id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._postings()}/segment={segment}")
        self.chunks.upsert(cut.withColumn("dl", F.size("terms")).withColumn("segment", F.lit(segment)).drop("terms"), [])
        return segment

    def remove(self, ids: DataFrame) -> None:
        """Takes the chunks with these chunk_ids out."""
        if not self.chunks.folders():
            return
        gone = ids.select("chunk_id").where("chunk_id is not null").distinct()
        touched = [r["b"] for r in gone.select(self.chunks.bucket().alias("b")).distinct().collect() if r["b"] in self.chunks.folders()]
        if touched:
            self.chunks.change(touched, lambda old: old.join(gone, "chunk_id", "left_anti"))

    def _live(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema("chunk_id long, term string, tf int, segment int, bucket int").option("basePath", self._postings()).parquet(f"{self._postings()}/segment=*")
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))

    def compact(self) -> int:
        """Writes one segment of what is in; older segments go. Gives its number."""
        chunks = save_table(self.chunks.read(), "index-chunks")
        live = self._live().join(chunks.select("chunk_id", "segment"), ["chunk_id", "segment"]).drop("segment")
        old = [r["segment"] for r in chunks.select("segment").distinct().collect()]  # a row a call of add()
        segment = self.chunks.version() + 1
        live.repartition(self.n_buckets, "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("bucket", "term", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self._postings()}/segment={segment}")
        self.chunks.replace(chunks.withColumn("segment", F.lit(segment)))
        fs, path = self.chunks._fs()
        for s in old:
            fs.delete(path(f"{self._postings()}/segment={s}"), True)
        return segment

    def search(self, queries: DataFrame, k: int, fits: F.Column | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, chunk_id, score, rank): the best k chunks of each query (query_id, text, ...) by BM25 with statistics of the
        whole index. ``fits`` keeps pairs; it may name other columns of the queries and of the chunks.

        The queries' terms are broadcast behind a check of their size and only their postings are read. Scores are sums of
        whole billionths and so don't depend on the order of parts or on segments.
        """
        more = [c for c in queries.columns if c not in ("query_id", "text")]
        terms = save_table(queries.select("query_id", *more, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), "index-asked")
        asked = terms.select("term", F.pmod(F.xxhash64("term"), F.lit(self.n_buckets)).cast("int").alias("b")).distinct()
        buckets = [r["b"] for r in asked.select("b").distinct().collect()]  # n_buckets at most
        empty = self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
        if not buckets or not self.chunks.folders():
            return empty
        chunks = self.chunks.read()
        hits = self._live(buckets).join(broadcast_if_small(asked.select("term"), QUERY_TERMS), "term", "left_semi")
        live = save_table(hits.join(chunks, ["chunk_id", "segment"]).drop("segment", "bucket"), "index-hits", FILE_ROWS)
        whole = chunks.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        weighed = terms.join(live.groupBy("term").agg(F.count("*").alias("df")), "term").crossJoin(F.broadcast(whole)).select("query_id", *more, "term", "df", "avgdl", idf)
        weighed = save_table(weighed, "index-weighed")
        pairs = dealt_by_parts(live, weighed).join(broadcast_if_small(weighed.drop("df"), QUERY_TERMS), "term")
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        pairs = (pairs if fits is None else pairs.where(fits)).withColumn("part", F.floor(part * 1e9 + 0.5))
        scores = pairs.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part") / 1e9, 6).alias("score")).where("score > 0")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        return scores.withColumn("rank", rank).where(F.col("rank") <= k)
