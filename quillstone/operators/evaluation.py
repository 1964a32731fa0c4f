"""Scoring of answers: keyword hits, fluency, composite scores, percentiles, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.sizes import broadcast_if_small

# Weights of keywords, value and semantic similarity by type, with and without a similarity model.
WEIGHTS = {"Type1": (0.15, 0.65, 0.20), "Type2": (0.40, 0.10, 0.50), "Type3": (0.50, 0.00, 0.50)}
FINAL_WEIGHTS = {"Type1": (0.10, 0.60, 0.30), "Type2": (0.30, 0.05, 0.65), "Type3": (0.40, 0.00, 0.60)}
_UNITS = (("B", 1e9), ("M", 1e6), ("T", 1e12))


def keyword_hit_rate(answer: Column, keywords: Column) -> Column:
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(hits / F.size(keywords))


def fluency(text: Column) -> Column:
    """1 to 5 by length, a repeated run of five words (told by 64-bit hashes), and the last character."""
    t = F.trim(F.coalesce(text, F.lit("")))
    ends = t.rlike(r'[.!?"]$')

    def grade(words: Column) -> Column:
        n = F.size(words)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 5)))
        repeated = F.transform(F.array(runs), lambda r: F.size(r) > F.size(F.array_distinct(r)))[0]
        return F.when(F.length(t) < 10, 1).when((n >= 5) & repeated, 2).when(n < 15, 3).when((n >= 30) & ends, 5).when(ends, 4).otherwise(3)

    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    return F.transform(F.array(words), grade)[0]


def map_category(category: Column) -> Column:
    """Type1, Type2 or Type3 of a label in any case; null is Type1."""
    c = F.lower(category)
    return F.when(c.contains("type3"), "Type3").when(c.contains("type2") & ~c.contains("type1"), "Type2").otherwise("Type1")


def percentiles(rows: DataFrame, group: str, value: str, points: dict[str, float], accuracy: int = 10_000, most: float | None = None) -> DataFrame:
    """Exact floor-index percentiles per group: the element at floor(n q) of the sorted values, nulls left out. With ``most``,
    NaN, infinite values and those beyond it are left out too, as for perplexities (1e6).

    Approximate percentiles, whose error in rank is bounded, give a range of values that holds the element; below it values are
    only counted, and just those inside, a few ten-thousandths of a group, are counted one by one and put in order.
    """
    known = rows.where(F.col(value).isNotNull()).select(group, value)
    if most is not None:
        x = F.col(value).cast("double")
        known = known.where(~F.isnan(x) & (x > float("-inf")) & (x <= most))
    margin = 3 / accuracy
    edge = lambda q: F.min(value) if q <= 0 else F.max(value) if q >= 1 else F.percentile_approx(value, q, accuracy)
    ranges = [F.struct(F.lit(n).alias("point"), F.lit(float(q)).alias("q"), F.col(f"lo{k}").alias("lo"), F.col(f"hi{k}").alias("hi")) for k, (n, q) in enumerate(points.items())]
    edges = known.groupBy(group).agg(F.count("*").alias("total"), *(f(q).alias(f"{n}{k}") for k, q in enumerate(points.values()) for n, f in (("lo", lambda q: edge(q - margin)), ("hi", lambda q: edge(q + margin)))))
    edges = edges.select(group, "total", F.inline(F.array(*ranges))).withColumn("target", F.least(F.floor(F.col("total") * F.col("q")), F.col("total") - 1))
    counted = known.groupBy(group, value).agg(F.count("*").alias("n"))
    placed = counted.join(broadcast_if_small(edges), group).where(F.col(value) <= F.col("hi"))
    below = placed.where(F.col(value) < F.col("lo")).groupBy(group, "point").agg(F.sum("n").alias("below"))
    inside = placed.where(F.col(value) >= F.col("lo")).join(below, [group, "point"], "left")
    upto = F.coalesce("below", F.lit(0)) + F.sum("n").over(Window.partitionBy(group, "point").orderBy(value))
    found = inside.withColumn("upto", upto).where("upto > target").groupBy(group).pivot("point", list(points)).agg(F.min(value))
    return found


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join by case; ``disagree`` only where both runs have the case."""
    x, y = (r.select(key, F.col(value).alias(f"{n}_{value}"), F.lit(True).alias(f"in_{n}")) for r, n in ((a, "a"), (b, "b")))
    j = x.join(y, key, "full_outer")
    both = F.coalesce("in_a", F.lit(False)) & F.coalesce("in_b", F.lit(False))
    return j.select(key, f"a_{value}", f"b_{value}", (both & ~F.col(f"a_{value}").eqNullSafe(F.col(f"b_{value}"))).alias("disagree"))


def smooth(values: Column, alpha: float = 0.6) -> Column:
    """Exponential smoothing of an ordered array, each value after the one before."""
    empty = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))

    def add(s, v):
        new = F.when(s.last.isNull(), v).otherwise(alpha * s.last + (1 - alpha) * v)
        return F.struct(F.concat(s.out, F.array(new)).alias("out"), new.alias("last"))

    return F.aggregate(values, empty, add)["out"]


def _near(found: Column, wanted: Column, tolerance: float) -> Column:
    return F.abs(found - wanted) / (F.abs(wanted) + 1e-9) <= tolerance


def _times_unit(value: Column, unit: Column, otherwise: float | None) -> Column:
    out = F.when(unit == _UNITS[0][0], value * _UNITS[0][1])
    for name, times in _UNITS[1:]:
        out = out.when(unit == name, value * times)
    return out if otherwise is None else out.otherwise(value * otherwise)


def _numbers(answer: Column) -> Column:
    """array<struct<value, unit>> of the numbers in a text; the unit is B, M, T or empty."""
    pattern = F.lit(r"(\d[\d,]*(?:\.\d+)?)\s*([BbMmTt](?:illion|rillion)?)?(?:\b|$)")
    pairs = F.arrays_zip(F.regexp_extract_all(answer, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(answer, pattern, F.lit(2)).alias("u"))
    return F.transform(pairs, lambda p: F.struct(F.replace(p["n"], F.lit(","), F.lit("")).try_cast("double").alias("value"), F.upper(F.substring(p["u"], 1, 1)).alias("unit")))


def first_number(answer: Column) -> Column:
    """The first number of a text, times its B, M or T; signs are not read."""
    pattern = r"(?U)(\d+(?:\.\d+)?)\s*([BbMmTt]?)\b"
    bare = F.replace(answer, F.lit(","), F.lit(""))
    return _times_unit(F.regexp_extract(bare, pattern, 1).try_cast("double"), F.upper(F.regexp_extract(bare, pattern, 2)), 1.0)


def value_correct(answer: Column, expected: Column, acceptable: Column | None = None, tolerance: float = 0.05) -> Column:
    """Whether an answer states the expected value; null where none is expected.

    Below 1 in size: as a percentage or as 0.x. Negative: its first six digits or a number with B, M or T, and a minus
    or a word for loss. Otherwise its first six digits, a number with B, M or T, or a bare number in ones, thousands,
    millions or billions; last, any of ``acceptable`` in that way. A null answer counts as empty.
    """
    text = F.coalesce(answer, F.lit(""))
    bare = F.replace(F.replace(text, F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    size = F.abs(expected)
    all_of = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("double"))
    digits = lambda v: F.substring(v.cast("bigint").cast("string"), 1, 6)
    ratio = F.exists(all_of(r"(\d+(?:\.\d+)?)\s*%"), lambda x: _near(x, size * 100, tolerance)) | F.exists(all_of(r"\b(0\.\d+)\b"), lambda x: _near(x, size, tolerance))
    loss = text.rlike(r"(?i)\b(loss|negative|deficit)\b") | F.contains(text, F.lit("-"))
    scaled = F.exists(_numbers(text), lambda n: F.coalesce(_near(_times_unit(n["value"], n["unit"], None), size, tolerance), F.lit(False)))

    def stated(prefix: Column, wanted: Column) -> Column:
        def fits(n: Column) -> Column:
            plain = [_near(n["value"] * m, wanted, tolerance) for m in (1e9, 1e6, 1e3, 1.0)]
            return F.when(n["unit"] == "", plain[0] | plain[1] | plain[2] | plain[3]).otherwise(_near(_times_unit(n["value"], n["unit"], 1.0), wanted, tolerance))

        return F.contains(bare, digits(prefix)) | F.exists(_numbers(text), fits)

    positive = stated(expected, expected)
    if acceptable is not None:
        others = F.filter(acceptable, lambda a: (a != expected) & (a != 0))
        positive = positive | F.coalesce(F.exists(others, lambda a: stated(a, F.abs(a))), F.lit(False))
    return F.when(expected.isNull(), F.lit(None).cast("boolean")).when(size < 1, ratio).when(expected < 0, (F.contains(bare, digits(size)) | scaled) & loss).otherwise(positive)


def intent_correct(intent: Column, sub_intents: Column, expected: Column, expected_subs: Column) -> Column:
    """Equality of the lists where parts are expected, else of the intents; null where nothing is expected."""
    return F.when(F.size(F.coalesce(expected_subs, F.array())) > 0, F.coalesce(sub_intents == expected_subs, F.lit(False))).when(expected.isNotNull(), F.coalesce(intent == expected, F.lit(False)))


def case_score(category: Column, intent_ok: Column, value_ok: Column, keyword_rate: Column, similarity: Column | None = None, weights: dict = WEIGHTS) -> Column:
    """Weighted score to 4 decimals; an unknown value counts a half, a wrong intent caps it at 0.5. Without a similarity
    the keyword rate stands for it."""
    kind, key = map_category(category), F.coalesce(keyword_rate, F.lit(0.0))
    value = F.when(value_ok, 1.0).when(~value_ok, 0.0).otherwise(0.5)
    sem = key if similarity is None else F.coalesce(similarity, key)
    total = lambda w: F.lit(w[0]) * key + F.lit(w[1]) * value + F.lit(w[2]) * sem
    score = F.when(kind == "Type3", total(weights["Type3"])).when(kind == "Type2", total(weights["Type2"])).otherwise(total(weights["Type1"]))
    return F.round(F.when(~intent_ok, F.least(score, F.lit(0.5))).otherwise(score), 4)


def perplexity(tokens: DataFrame, group: list[str], logp: str, start: Column | None = None) -> DataFrame:
    """exp(-mean log probability) to 3 decimals of each group's tokens, one row a token; missing and infinite ones don't
    count, nor those for which ``start`` is false. Null for groups of fewer than two."""
    lp = F.col(logp).cast("double")
    used = F.when((F.abs(lp) != float("inf")) & ~F.isnan(lp) & (F.lit(True) if start is None else start), lp.cast("decimal(20,9)"))
    return tokens.groupBy(*group).agg(F.when(F.count(used) >= 2, F.round(F.exp(-F.avg(used).cast("double")), 3)).alias("perplexity"))


def burst(requests: DataFrame, group: str, latency: str, ok: Column, wall: Column, only_good: bool = False) -> DataFrame:
    """Request counts, rate and latencies of each burst; ``wall`` is an aggregate in seconds.

    The rate counts all requests, or with ``only_good`` those without an error. A burst of errors alone has latencies 0.
    """
    good = requests.withColumn("__latency", F.when(ok, F.col(latency)))
    total, errors, lat = F.count("*"), F.count_if(~F.coalesce(ok, F.lit(False))), F.col("__latency").cast("decimal(20,6)")
    stats = good.groupBy(group).agg(
        total.alias("total_requests"), errors.alias("errors"), F.round(wall, 3).alias("wall_time_s"), F.round(F.try_divide(total - (errors if only_good else 0), wall), 3).alias("qps"),
        *(F.round(f(lat).cast("double"), 3).alias(f"latency_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))),
    )
    points = percentiles(good, group, "__latency", {"latency_p50": 0.5, "latency_p95": 0.95})
    out = stats.join(points.select(group, *(F.round(p, 3).alias(p) for p in ("latency_p50", "latency_p95"))), group, "left")
    return out.na.fill(0.0, [c for c in out.columns if c.startswith("latency_")])


def build_reference(question: Column, keywords: Column, value: Column) -> Column:
    """The question with its keywords and value as an answer; the question alone where there is nothing to add."""
    shown = F.when(value > 1e6, F.format_string("$%.1f billion", value / 1e9)).when(value < 1, F.format_string("%.1f%%", value * 100)).otherwise(value.cast("string"))
    parts = F.concat(F.coalesce(keywords, F.array().cast("array<string>")), F.when(value.isNotNull(), F.array(shown)).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(parts) == 0, question).otherwise(F.concat(question, F.lit(" Answer: "), F.array_join(parts, ", ")))


def best_similarity(answer: Column, references: Column) -> Column:
    """Largest dot product of a unit vector with several, at least 0; 0 without references. Encoding is the caller's."""
    dot = lambda r: F.aggregate(F.zip_with(answer, r, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.greatest(F.array_max(F.transform(references, dot)), F.lit(0.0)), F.lit(0.0))


def aggregate_scores(cases: DataFrame, category: str, means: dict[str, str], decimals: int = 4) -> DataFrame:
    """Counts and rounded means (output name to column) per type and, as type 'all', of all cases; nulls don't count."""
    typed = cases.withColumn("__type", map_category(F.col(category)))
    rolled = typed.rollup("__type").agg(F.count("*").alias("n"), *(F.round(F.avg(c), decimals).alias(n) for n, c in means.items()))
    return rolled.withColumn("type", F.coalesce("__type", F.lit("all"))).drop("__type")


def category_summary(cases: DataFrame, category: str, judged: dict[str, str], positive: dict[str, str]) -> DataFrame:
    """Per category: cases, failures and means to 3 decimals. ``judged`` columns skip nulls, ``positive`` ones zeros too."""
    fails = (F.count_if(F.col(c) == 0).alias(f"{n}_fails") for n, c in judged.items())
    means = (F.round(F.avg(F.nullif(F.col(c).cast("double"), F.lit(0.0)) if n in positive else F.col(c)), 3).alias(n) for n, c in (judged | positive).items())
    return cases.groupBy(category).agg(F.count("*").alias("n"), *fails, *means)


# Openings of small talk and of questions about notions, companies that such a question isn't about, words of figures.
_TALK = (
    "hi|hello|hey|thanks|thank you|bye|goodbye|good morning|good afternoon|what can you|how are you|who are you|what do you do"
    "|what does .{3,60} mean|can you explain (what |how |why )?|how (do i|do you|does one) (read|calculate|compute|interpret|use|understand|measure)"
    "|explain (what |how |why )?|define |what('s| is) the difference between|why (is|does|do|are) .{0,30} (important|matter|used|work)"
)
_NAMED = (
    "apple|microsoft|google|amazon|nvidia|tesla|meta|adobe|walmart|costco|jpmorgan|disney|pfizer|nike|boeing|exxon|netflix|salesforce|merck|intel|qualcomm"
    "|abbvie|broadcom|unitedhealth|home depot|coca.cola|3m|caterpillar|fedex|ibm|chevron|procter|starbucks|amgen"
    "|aapl|msft|goog|amzn|nvda|tsla|adbe|wmt|cost|jpm|dis|pfe|nke|ba|xom"
)
_FIGURES = (
    r"revenue|income|profit|earnings|assets|liabilities|debt|cash|capex|cfo|ebit|margin|roa|current ratio|fy20\d{2}|fiscal 20\d{2}|in 20\d{2}"
    "|how much|how many|what was|what is the|total|balance|ratio"
)


def fast_intent(question: Column) -> Column:
    """Type3 for small talk and notions, which needs no model; null for what a model has to tell."""
    notion = question.rlike(r"(?iU)^\s*what is \b") & ~question.rlike(rf"(?i)^\s*what is ({_NAMED})")
    return F.when(question.rlike(rf"(?iU)^\s*({_TALK})\b") | notion, "Type3")


def fallback_intent(question: Column, label: Column | None = None) -> Column:
    """The type in a model's answer, else Type1 for questions with a word of figures and Type2 for others."""
    by_words = F.when(question.rlike(rf"(?iU)\b({_FIGURES})\b"), "Type1").otherwise("Type2")
    return by_words if label is None else F.coalesce(F.nullif(F.regexp_extract(label, "Type[123]", 0), F.lit("")), by_words)


def _keywords(value: Column, names: list[Column]) -> Column:
    size = F.abs(value)
    number = F.when(size >= 1e9, F.bround(value / 1e9)).when(size >= 1e6, F.bround(value / 1e6)).cast("bigint").cast("string")
    return F.filter(F.array(*names, number), lambda x: x.isNotNull())


def point_cases(panel: DataFrame, templates: list[tuple[str, str]], years: int = 3, largest: float = 1e13) -> DataFrame:
    """Questions with ground truth: each (column, template with {name} and {fy}) for the last fiscal years of each ticker.

    Values that are null or beyond ``largest`` give no case; a question comes once, by its first template.
    """
    recent = Window.partitionBy("ticker").orderBy(F.desc("year"))
    rows = panel.where("year like 'FY%'").withColumn("__n", F.row_number().over(recent)).where(F.col("__n") <= years)
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{name}"), F.col("ticker")), F.lit("{fy}"), F.col("year"))
    made = F.array(*(F.struct(F.lit(i).alias("template"), filled(t).alias("question"), F.col(c).cast("double").alias("expected_value")) for i, (c, t) in enumerate(templates)))
    asked = rows.select("ticker", "year", F.explode(made).alias("m")).select("ticker", "year", "m.*").where(F.abs("expected_value") <= largest)
    once = asked.withColumn("__n", F.row_number().over(Window.partitionBy("question").orderBy("template", "ticker", "year"))).where("__n = 1").drop("__n")
    return once.withColumn("keywords", _keywords(F.col("expected_value"), [F.lower("ticker")]))


def change_cases(panel: DataFrame, column: str, template: str) -> DataFrame:
    """Questions on the change between adjacent years that both have a value; {name}, {fy1} and {fy2} are filled in."""
    w = Window.partitionBy("ticker").orderBy("year")
    pairs = panel.withColumn("__next", F.lead("year").over(w)).withColumn("__then", F.lead(column).over(w)).where(F.col(column).isNotNull() & F.col("__then").isNotNull())
    q = F.lit(template)
    for mark, c in (("{name}", "ticker"), ("{fy1}", "year"), ("{fy2}", "__next")):
        q = F.replace(q, F.lit(mark), F.col(c))
    return pairs.select("ticker", q.alias("question"), (F.col("__then") - F.col(column)).alias("change"))
