"""Statistics of ratings by order and counts. All work on histograms (metric, level, score) -> n, a few rows for each group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone import schemas as S

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within [0, 1]; null for n = 0."""
    p, d = k / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(middle - half, F.lit(0.0))), F.when(n > 0, F.least(middle + half, F.lit(1.0)))


def histogram(long: DataFrame, by: list[str]) -> DataFrame:
    return long.filter("score is not null").groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"))


def describe_ordinal(hist: DataFrame, by: list[str]) -> DataFrame:
    """n, median, mode (least on ties), quartiles (linear), top-2 and worst counts. There are no means of ordinal scores."""
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    mode = F.max_by(F.col("score"), F.struct(F.col("n"), -F.col("score")))
    out = hist.groupBy(*by).agg(F.sum("n").alias("total"), q.alias("q"), mode.alias("mode"), F.sum(F.when(F.col("score") >= 3, F.col("n")).otherwise(0)).alias("top2_n"), F.sum(F.when(F.col("score") <= 1, F.col("n")).otherwise(0)).alias("worst_n"))
    return out.select(
        *by, F.col("total").alias("n"), F.col("q")[1].alias("median"), "mode", F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        "top2_n", F.round(100 * F.col("top2_n") / F.col("total"), 6).alias("top2_pct"), "worst_n",
    )


def with_labels(summary: DataFrame) -> DataFrame:
    """summary(metric, median, mode, ...) with median_label and mode_label; a median that no label has is ``between labels``."""
    label = lambda c: F.coalesce(*[F.when(F.col("metric") == m, F.try_element_at(F.array(*map(F.lit, labels)), (len(labels) + 1 - F.col(c)).cast("int"))) for m, labels in S.SCALES.items()])
    between = F.when(F.col("median") != F.floor("median"), "between labels").otherwise(label("median"))
    return summary.withColumns({"median_label": between, "mode_label": label("mode")})


def binary_pass_rate(long: DataFrame, by: list[str]) -> DataFrame:
    one = long.filter("pass is not null").groupBy(*by).agg(F.sum("pass").alias("pass_n"), F.count("pass").alias("pass_total"))
    low, high = wilson(F.col("pass_n"), F.col("pass_total"))
    return one.select(*by, "pass_n", "pass_total", F.round(100 * F.col("pass_n") / F.col("pass_total"), 6).alias("pass_pct"), F.round(low, 6).alias("pass_low"), F.round(high, 6).alias("pass_high"))


def summary_overall(long: DataFrame) -> DataFrame:
    """A row for each metric: ordinal description with the Wilson interval of top-2, and the pass rate of the binary question."""
    low, high = wilson(F.col("top2_n"), F.col("n"))
    ordinal = describe_ordinal(histogram(long, ["metric"]), ["metric"]).withColumns({"top2_low": F.round(low, 6), "top2_high": F.round(high, 6)})
    return ordinal.join(binary_pass_rate(long, ["metric"]), "metric", "full_outer")


def summary_by_group(long: DataFrame, group: str) -> DataFrame:
    """(metric, group, n, median, top2_pct); no rows for a metric with one level only."""
    out = describe_ordinal(histogram(long, ["metric", group]), ["metric", group])
    levels = F.count(F.lit(1)).over(Window.partitionBy("metric"))
    return out.withColumn("levels", levels).filter("levels >= 2").select("metric", group, "n", "median", "top2_pct")


def label_distribution(long: DataFrame, group: str) -> DataFrame:
    """(metric, group, label, score, n, pct), unused labels with 0."""
    spark = long.sparkSession
    dim = spark.createDataFrame([(m, label, 4 - k) for m, labels in S.SCALES.items() for k, label in enumerate(labels)], "metric string, label string, score int")
    hist = histogram(long, ["metric", group])
    groups = hist.select("metric", group).distinct()
    full = groups.join(F.broadcast(dim), "metric").join(hist, ["metric", group, "score"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("metric", group)), 6)).select("metric", group, "label", "score", "n", "pct")


def approach_top2_table(long: DataFrame, first: str, second: str) -> DataFrame:
    """n, top-2 share with its interval for two approaches, and the difference in percentage points."""
    d = describe_ordinal(histogram(long, ["metric", "approach"]), ["metric", "approach"])
    low, high = wilson(F.col("top2_n"), F.col("n"))
    d = d.withColumns({"low": F.round(100 * low, 6), "high": F.round(100 * high, 6)})
    side = lambda level, x: d.filter(F.col("approach") == level).select("metric", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "top2_pct", "low", "high")])
    return side(first, "a").join(side(second, "b"), "metric").withColumn("delta_pp", F.round(F.col("top2_pct_a") - F.col("top2_pct_b"), 6))


def mann_whitney(long: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """(metric, n1, n2, u, ties, cliffs_delta, magnitude, p): U of the first level, from two histograms; p is asymptotic with tie and continuity correction."""
    hist = histogram(long, ["metric", group])
    both = hist.groupBy("metric", "score").agg(F.coalesce(F.sum(F.when(F.col(group) == first, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col(group) == second, F.col("n"))), F.lit(0)).alias("b"))
    below = F.coalesce(F.sum("b").over(Window.partitionBy("metric").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = (F.col("a") + F.col("b")).cast("double")  # its cube is more than a long holds from 2,097,152 equal scores on
    one = both.withColumn("u", F.col("a") * (below + F.col("b") / 2)).groupBy("metric").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum("u").alias("u"), F.sum(t * t * t - t).alias("ties")).filter("n1 > 0 and n2 > 0")
    delta = F.round(2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1, 6)
    size = F.when(F.abs("cliffs_delta") < 0.147, "negligible").when(F.abs("cliffs_delta") < 0.33, "small").when(F.abs("cliffs_delta") < 0.474, "medium").otherwise("large")

    @F.pandas_udf("double")
    def p_value(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for a, x, y, t in zip(u, n1, n2, ties, strict=True):
            n = x + y
            var = x * y / 12 * ((n + 1) - t / (n * (n - 1))) if n > 1 else 0
            out.append(1.0 if var <= 0 else math.erfc(max(0.0, abs(a - x * y / 2) - 0.5) / math.sqrt(2 * var)))
        return pd.Series(out)

    return one.withColumn("cliffs_delta", delta).withColumns({"magnitude": size, "p": p_value("u", "n1", "n2", "ties")})


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of [[a, b], [c, d]]: the tables with these margins that are no likelier, from both ends of the likelier ones outwards until nothing is added."""
    r, s, k = a + b, c + d, a + c
    if 0 in (r, s, k, b + d):
        return 1.0
    low, high = max(0, k - s), min(r, k)
    log = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    at = lambda x: log(r, x) + log(s, k - x) - log(r + s, k)
    limit, mode = at(a) + 1e-7, min(high, max(low, (r + 1) * (k + 1) // (r + s + 2)))
    total = 0.0
    for end, way in ((low, -1), (high, 1)):
        # the likelihood falls from the mode to either end: halve to the first table that is no likelier
        near, far = mode, end
        if at(end) > limit:
            continue
        while abs(far - near) > 1:
            middle = (near + far) // 2
            near, far = (near, middle) if at(middle) <= limit else (middle, far)
        x = near if near != far and at(near) <= limit else far
        if x == mode and way == 1 and at(mode) <= limit:
            x += 1  # the mode itself is counted on the other side
        while low <= x <= high and (term := math.exp(at(x))) > total * 1e-17:
            total += term
            x += way
    return min(1.0, total)


def fisher_exact(counts: DataFrame) -> DataFrame:
    """counts(..., a, b, c, d) with p, two-sided for the table [[a, b], [c, d]]; a margin of 0 gives 1."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_fisher(*map(int, x)) for x in zip(a, b, c, d, strict=True)])

    return counts.withColumn("p", p("a", "b", "c", "d"))


def binary_tables(long: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """(metric, a, b, c, d): passes and failures of two levels in the binary questions."""
    n = lambda level, passed: F.count_if((F.col(group) == level) & (F.col("pass") == passed))
    return long.filter("pass is not null").groupBy("metric").agg(n(first, 1).alias("a"), n(first, 0).alias("b"), n(second, 1).alias("c"), n(second, 0).alias("d"))


def top2_tables(long: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """(metric, a, b, c, d): top-2 and other counts of two levels."""
    n = lambda level, top: F.sum(F.when((F.col(group) == level) & ((F.col("score") >= 3) == top), F.col("n")).otherwise(0))
    return histogram(long, ["metric", group]).groupBy("metric").agg(n(first, True).alias("a"), n(first, False).alias("b"), n(second, True).alias("c"), n(second, False).alias("d"))


def annotator_calibration(long: DataFrame) -> DataFrame:
    return describe_ordinal(histogram(long, ["annotator", "metric"]), ["annotator", "metric"]).select("annotator", "metric", "n", "median", "top2_pct")


def annotator_order(long: DataFrame) -> DataFrame:
    """(annotator, n, place): annotators by all their scores, most first, then by name; the last window has a row for each annotator."""
    n = long.filter("score is not null").groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("annotator").asc_nulls_last())))


def annotator_pace(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("annotator").agg(F.countDistinct("qa_uid").alias("pairs"), F.median("seconds_spent").alias("median_seconds"))


def krippendorff_alpha(long: DataFrame, unit: str = "qa_uid") -> DataFrame:
    """(metric, units, alpha) with the ordinal distance, over units with two scores or more.

    The unit's histogram of values is the only thing that is paired with itself (at most 16 rows), so a unit that everybody rated is no larger
    than another. No unit: null; one value only or no expected disagreement: 1.
    """
    hist = long.filter("score is not null").groupBy("metric", unit, "score").agg(F.count(F.lit(1)).alias("n"))
    units = hist.groupBy("metric", unit).agg(F.collect_list(F.struct("score", "n")).alias("v"), F.sum("n").alias("m")).filter("m > 1")
    pair = units.select("metric", "m", F.posexplode("v").alias("i", "c"), "v").select("metric", "m", "i", "c", F.posexplode("v").alias("j", "k"))
    weight = F.col("c.n") * (F.col("k.n") - (F.col("c.score") == F.col("k.score")).cast("int")) / (F.col("m") - 1)
    o = pair.groupBy("metric", F.col("c.score").alias("c"), F.col("k.score").alias("k")).agg(F.sum(weight).alias("o"), F.count_if((F.col("i") == 0) & (F.col("j") == 0)).alias("units"))
    # from here on a metric is one array of at most 16 pairs of scores
    one = o.groupBy("metric").agg(F.collect_list(F.struct("c", "k", "o")).alias("o"), F.sum("units").alias("units"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    mass = F.transform(F.array_sort(F.array_distinct("o.c")), lambda c: F.struct(c.alias("c"), add(F.transform(F.filter("o", lambda x: x["c"] == c), lambda x: x["o"])).alias("nc")))
    one = one.withColumn("mass", mass).withColumn("n", add(F.col("mass.nc")))
    # the middle of a score's mass on the line of all mass: distances are differences of middles
    middle = lambda c: add(F.transform("mass", lambda x: F.when(x["c"] < c, x["nc"]).when(x["c"] == c, x["nc"] / 2).otherwise(0.0)))
    one = one.withColumn("mass", F.transform("mass", lambda x: F.struct(x["c"].alias("c"), x["nc"].alias("nc"), middle(x["c"]).alias("at"))))
    place = lambda c: F.filter("mass", lambda x: x["c"] == c)[0]["at"]
    square = lambda x, y: (x - y) * (x - y)
    seen = add(F.transform("o", lambda x: x["o"] * square(place(x["c"]), place(x["k"]))))
    expected = add(F.transform("mass", lambda x: add(F.transform("mass", lambda y: x["nc"] * y["nc"] * square(x["at"], y["at"])))))
    one = one.select("metric", "units", "n", seen.alias("seen"), expected.alias("expected"))
    alpha = F.when(F.col("expected") == 0, 1.0).otherwise(1 - (F.col("n") - 1) * F.col("seen") / F.col("expected"))
    return one.select("metric", "units", F.round(alpha, 6).alias("alpha"))


def agreement_rates(long: DataFrame, unit: str = "qa_uid") -> DataFrame:
    """(metric, units, exact, within_one): shares of units with two scores or more that agree wholly, or to one step."""
    one = long.filter("score is not null").groupBy("metric", unit).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("score").alias("m")).filter("m > 1")
    return one.groupBy("metric").agg(F.count(F.lit(1)).alias("units"), F.round(F.avg((F.col("lo") == F.col("hi")).cast("int")), 6).alias("exact"), F.round(F.avg((F.col("hi") - F.col("lo") <= 1).cast("int")), 6).alias("within_one"))
