"""Temperature mixing of sources, realised as budgeted block permutations.

The weights are source token shares to the power of an exponent in [0, 1], normalised. The exponent is found by interval
section so that the weights reach a target entropy, or so that no source is repeated more than a limit. Each source runs
through a keyed permutation of its documents, whole passes first and then a last pass as far as its token budget goes;
blocks of about ``block_tokens`` take every source at its weight, and are permuted again inside.

Documents' places in a permutation are keyed hashes, so whether a document is in the last pass is a comparison with its
source's threshold, and a hot source needs no task of its own. The schedule shuffles no texts; ``mix_documents`` shuffles
them once, by ranges of the schedule's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.store import save, spare

SECTIONS, STEPS, SLICES = 32, 6, 4096


def text_tokens(text: Column) -> Column:
    """Words of a text and one end token; null texts count the end alone."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long") + 1


def _place(key: Column, seed: int) -> Column:
    """A document's place in its source's permutation, 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1)


def find_exponent(totals: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The largest exponent at which the weights' entropy (nats) is at least the target, or the smallest at which no
    source is repeated more than ``max_repeats`` times while the one repeated least runs once. Each job measures
    ``SECTIONS`` inner points of the interval, where bisection measures one; the driver gets a row a point."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        points = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        p = totals.where("tokens > 0").select(F.log("share").alias("s"), F.explode(F.array(*map(F.lit, points))).alias("x"))
        z = p.groupBy("x").agg(F.sum(F.exp(F.col("x") * F.col("s"))).alias("z"), F.sum(F.exp(F.col("x") * F.col("s")) * F.col("x") * F.col("s")).alias("e"), F.max((F.col("x") - 1) * F.col("s")).alias("most"), F.min((F.col("x") - 1) * F.col("s")).alias("least"))
        rows = z.select("x", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"), F.exp(F.col("most") - F.col("least")).alias("repeats")).collect()
        if not rows:
            return 1.0
        if target_entropy is not None:
            good = [r.x for r in rows if r.entropy >= target_entropy]
            low = max(good, default=0.0)
            high = min((r.x for r in rows if r.x > low), default=low)
        else:
            good = [r.x for r in rows if r.repeats <= max_repeats * (1 + 1e-12)]
            high = min(good, default=1.0)
            low = max((r.x for r in rows if r.x < high), default=high)
    return low if target_entropy is not None else high


def source_plan(sizes: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """Per source of (source, n_tokens, place): tokens, share, weight, repeats, passes (whole ones) and last_place, up to
    which the last pass goes (-1: none). The budget is by default the least that uses every document at least once."""
    slices = save(sizes.groupBy("source", F.shiftright("place", 51).alias("slice")).agg(F.sum("n_tokens").alias("n")), "mix-slices")
    total = slices.agg(F.sum("n").alias("all"))
    totals = slices.groupBy("source").agg(F.sum("n").alias("tokens")).crossJoin(F.broadcast(total)).select("source", "tokens", (F.col("tokens") / F.col("all")).alias("share"))
    totals = save(totals, "mix-totals")
    x = find_exponent(totals, target_entropy, max_repeats)
    raised = totals.withColumn("raised", F.pow("share", F.lit(x)))
    norm = raised.agg(F.sum("raised").alias("norm"), F.max(F.col("tokens") / F.col("raised")).alias("need"))
    budget = F.lit(budget_tokens).cast("double") if budget_tokens else F.col("need") * F.col("norm")
    plan = raised.crossJoin(F.broadcast(norm)).select("source", "tokens", "share", (F.col("raised") / F.col("norm")).alias("weight"), budget.alias("budget"))
    # A repeat count within rounding of a whole number is that number.
    plan = plan.withColumn("repeats", F.col("weight") * F.col("budget") / F.col("tokens"))
    plan = plan.withColumn("repeats", F.when(F.abs(F.col("repeats") - F.round("repeats")) < 1e-9, F.round("repeats")).otherwise(F.col("repeats")))
    plan = save(plan.withColumn("passes", F.floor("repeats").cast("int")).withColumn("want", F.round((F.col("repeats") - F.col("passes")) * F.col("tokens")).cast("long")), "mix-plan")
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = slices.withColumn("upto", F.sum("n").over(upto)).join(_small(plan.select("source", "want")), "source")
    edge = sums.where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("n") <= F.col("want"))).select("source", "slice", "want", (F.col("upto") - F.col("n")).alias("before"))
    inside = sizes.withColumn("slice", F.shiftright("place", 51)).join(_small(edge), ["source", "slice"])
    inside = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "slice").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    # Rows of one place (repeated documents) are in or out together.
    chosen = inside.where("upto <= want").groupBy("source").agg(F.max("place").alias("at"))
    first = edge.select("source", (F.shiftleft("slice", 51) - 1).alias("slice_end"))
    last = F.when(F.col("want") > 0, F.coalesce("at", "slice_end")).otherwise(F.lit(-1))
    return save(plan.join(first, "source", "left").join(chosen, "source", "left").select("source", "tokens", "share", "weight", "budget", "repeats", "passes", last.alias("last_place")), "mix-sources")


def _small(table: DataFrame, rows: int = 10_000) -> DataFrame:
    """Hints at a broadcast only where a count shows that the table is small; otherwise the join shuffles as usual."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _sizes(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long")
    return save(docs.select(key.alias("doc_id"), source.alias("source"), text_tokens(F.col(text_col).cast("string")).alias("n_tokens"), _place(key, seed).alias("place")), "mix-sizes")


def _block(copy: str, place: str, repeats: str, budget: str, block_tokens: int) -> Column:
    """The block of a use: blocks take a source in the order of its passes, and of the places within a pass."""
    blocks = F.ceil(F.col(budget) / block_tokens)
    progress = (F.col(copy) + F.col(place) / F.lit(float(1 << 63))) / F.col(repeats)
    return F.least(F.floor(progress * blocks), blocks - 1)


def _mixed(key: str, copy: str, seed: int) -> Column:
    """What a block's uses are ordered by."""
    return F.xxhash64(F.lit(seed + 1), key, copy)


def mixing_schedule(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None, block_tokens: int = 1_000_000, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per use of a document: doc_id, source, n_tokens, copy, block, position, weight, repeats.

    A null source is the source ''. Null texts count one token; a null doc_id is an id like any other; repeated rows are
    used each; an empty table gives no rows.
    """
    sizes = _sizes(docs, seed, id_col, text_col, source_col)
    plan = source_plan(sizes, target_entropy, max_repeats, budget_tokens)
    used = sizes.join(_small(plan.select("source", "weight", "budget", "repeats", "passes", "last_place")), "source")
    used = used.withColumn("copies", F.col("passes") + (F.col("place") <= F.col("last_place")).cast("int")).where("copies > 0")
    used = used.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    used = used.withColumn("block", _block("copy", "place", "repeats", "budget", block_tokens)).withColumn("mixed", _mixed("doc_id", "copy", seed))
    position = F.row_number().over(Window.partitionBy("block").orderBy("mixed", "doc_id", "copy", "n_tokens")) - 1
    return used.select("doc_id", "source", "n_tokens", "copy", "block", position.alias("position"), "weight", "repeats")


def mix_documents(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None, block_tokens: int = 1_000_000, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mixture uses it, with the columns of ``docs``, in the schedule's order:
    by block, and permuted inside. The rows are dealt by ranges of that order, which can cut a block but not mix blocks
    up; uses of one row lie a pass apart. Rows of one id are in either order."""
    plan = source_plan(_sizes(docs, seed, id_col, text_col, source_col), target_entropy, max_repeats, budget_tokens)
    source, passes, last, repeats, budget, of, place, copies, copy, block, mixed = (spare(docs, f"mix_{n}") for n in "source passes last repeats budget id place copies copy block mixed".split())
    p = _small(plan.select(*(F.col(c).alias(n) for c, n in zip("source passes last_place repeats budget".split(), (source, passes, last, repeats, budget)))))
    used = docs.join(p, F.coalesce(docs[source_col].cast("string"), F.lit("")) == p[source])
    key = docs[id_col].cast("long")
    used = used.withColumn(of, key).withColumn(place, _place(key, seed))
    used = used.withColumn(copies, F.col(passes) + (F.col(place) <= F.col(last)).cast("int")).where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    used = used.withColumn(block, _block(copy, place, repeats, budget, block_tokens)).withColumn(mixed, _mixed(of, copy, seed))
    order = [block, mixed, of, copy]
    return used.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select(*(used[c] for c in docs.columns))
