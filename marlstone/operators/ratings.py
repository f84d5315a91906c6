"""Rating logs: cleaning, the latest row of each rater and pair, label scores, and counts that need no statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone import schemas as S


def _lookup(value: Column, pairs: dict) -> Column:
    """value by a small literal map; null where it isn't in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), value) if pairs else F.lit(None)


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(c).rlike(r"^(?U)\s*$"), None).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def union_exports(exports: list[DataFrame]) -> DataFrame:
    """Exports of different vintages one after the other: old column names become new ones row by row, empty legacy columns go."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), exports)
    for old, new in S.RENAMED.items():
        if old in out.columns:
            out = out.withColumn(new, F.coalesce(*[c for c in (new, old) if c in out.columns])).drop(old)
    legacy = [c for c in S.LEGACY if c in out.columns]
    if legacy:
        counts = out.agg(*[F.count(c).alias(c) for c in legacy]).first()
        out = out.drop(*[c for c in legacy if not counts[c]])
    return out


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """The newest row of each (session_id, qa_uid) by (created_at, id): one shuffle and one sort, as hardly any pair of a rater and a pair comes twice."""
    place = F.row_number().over(Window.partitionBy("session_id", "qa_uid").orderBy(F.desc("created_at"), F.desc("id")))
    return ratings.withColumn("_place", place).filter("_place = 1").drop("_place")


def canonical_label(metric: str, c: Column) -> Column:
    return F.coalesce(_lookup(c, S.ALIASES.get(metric, {})), c)


def ordinal_score(metric: str, c: Column) -> Column:
    return _lookup(canonical_label(metric, c), {label: 4 - k for k, label in enumerate(S.SCALES[metric])}).cast("int")


def binary_score(metric: str, c: Column) -> Column:
    return F.when(c.isin("Yes", "No"), (c == S.PASSES[metric]).cast("int"))


def normalize_issue_cell(c: Column) -> Column:
    """Ticked problems, split at ``; ``, trimmed, by today's names."""
    return F.array_join(F.transform(F.split(c, "; "), lambda x: F.coalesce(_lookup(F.trim(x), S.ERROR_ALIASES), F.trim(x))), "; ")


def score_ratings(ratings: DataFrame) -> DataFrame:
    """Wide scores: {metric}_score 4..1, {metric}_pass 1/0, recommendation_score."""
    return ratings.withColumns(
        {f"{m}_score": ordinal_score(m, F.col(f"qna_{m}_attribute")) for m in S.ORDINAL}
        | {f"{m}_pass": binary_score(m, F.col(f"qna_{m}_binary")) for m in S.BINARY}
        | {"recommendation_score": ordinal_score("recommendation", F.col("caregiver_recommendation"))}
    )


def long_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, score, pass): one row for each rating and metric."""
    null = F.lit(None).cast("int")
    parts = [F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_score") if m in S.ORDINAL else null).alias("score"), F.col(f"{m}_pass").alias("pass")) for m in S.BINARY]
    parts.append(F.struct(F.lit("recommendation").alias("metric"), F.col("recommendation_score").alias("score"), null.alias("pass")))
    return scored.select(*keys, F.explode(F.array(*parts)).alias("m")).select(*keys, "m.*")


def unmapped_labels(ratings: DataFrame) -> DataFrame:
    """(metric, label, n): labels outside their scale."""
    cells = [F.struct(F.lit(m).alias("metric"), canonical_label(m, F.col(f"qna_{m}_attribute")).alias("label")) for m in S.ORDINAL]
    cells.append(F.struct(F.lit("recommendation").alias("metric"), canonical_label("recommendation", F.col("caregiver_recommendation")).alias("label")))
    known = reduce(lambda a, b: a | b, [(F.col("metric") == m) & F.col("label").isin(labels) for m, labels in S.SCALES.items()])
    return ratings.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("label").isNotNull() & ~known).groupBy("metric", "label").agg(F.count(F.lit(1)).alias("n"))


def issues(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, cell, error): one row for each problem ticked; a cell with none gives one row without an error."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), normalize_issue_cell(F.col(f"qna_{m}_issue")).alias("cell")) for m in S.BINARY])
    one = ratings.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").filter("cell is not null")
    return one.withColumn("error", F.explode_outer(F.array_except(F.split("cell", "; "), F.array(F.lit(S.NO_ISSUE)))))


def _known_error() -> Column:
    return reduce(lambda a, b: a | b, [(F.col("metric") == m) & F.col("error").isin(errors) for m, errors in S.ERRORS.items()])


def error_taxonomy(ratings: DataFrame, group: str | None = None) -> DataFrame:
    """(metric, [group], error, n, pct, flagged_pct) of known problems, against the ratings that have a cell."""
    by = ["metric", *([group] if group else [])]
    ticked = issues(ratings.withColumn("rid", F.col("id")), ["rid", *([group] if group else [])])
    totals = ticked.groupBy(*by).agg(F.countDistinct("rid").alias("cells"), F.countDistinct(F.when(F.col("cell") != S.NO_ISSUE, F.col("rid"))).alias("flagged"))
    counts = ticked.filter(_known_error()).groupBy(*by, "error").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(totals, by).select(*by, "error", "n", F.round(100 * F.col("n") / F.col("cells"), 6).alias("pct"), F.round(100 * F.col("flagged") / F.col("cells"), 6).alias("flagged_pct"))


def unexpected_labels(ratings: DataFrame) -> DataFrame:
    ticked = issues(ratings, [])
    return ticked.filter(F.col("error").isNotNull() & ~_known_error()).groupBy("metric", "error").agg(F.count(F.lit(1)).alias("n"))


def coverage(ratings: DataFrame, small: int = 100) -> DataFrame:
    """(grouping, level, ratings, pairs, annotators, sessions, small_n) for all rows, by approach, dataset and batch, in one pass."""
    sets = ratings.select("approach", "dataset", "batch", "qa_uid", "annotator", "session_id").groupingSets([[], ["approach"], ["dataset"], ["batch"]], "approach", "dataset", "batch")
    out = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("ratings"), F.countDistinct("qa_uid").alias("pairs"), F.countDistinct("annotator").alias("annotators"), F.countDistinct("session_id").alias("sessions"))
    name = F.when(F.col("g") == 3, "approach").when(F.col("g") == 5, "dataset").when(F.col("g") == 6, "batch").otherwise("all")
    return out.select(name.alias("grouping"), F.coalesce("approach", "dataset", "batch", F.lit("all")).alias("level"), "ratings", "pairs", "annotators", "sessions", (F.col("ratings") < small).alias("small_n"))


def annotator_by_approach(ratings: DataFrame, approaches: list[str]) -> DataFrame:
    return ratings.groupBy("annotator").pivot("approach", approaches).count().na.fill(0)


def overlap_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings of pairs that more than one annotator rated: least and greatest annotator differ, which needs no distinct count."""
    more = ratings.groupBy("qa_uid").agg(F.min("annotator").alias("a"), F.max("annotator").alias("b")).filter("a <> b").select("qa_uid")
    return ratings.join(more, "qa_uid", "left_semi")


def fast_ratings(ratings: DataFrame, seconds: int = 15) -> DataFrame:
    return ratings.filter(F.col("seconds_spent") < seconds)


def rated_rows(ratings: DataFrame) -> DataFrame:
    return ratings.filter(F.coalesce(*[F.col(f"qna_{m}_binary") for m in S.BINARY], F.col("caregiver_recommendation")).isNotNull())


def completeness(ratings: DataFrame) -> DataFrame:
    """ratings with {metric}_complete and complete: attribute set, binary Yes or No, and a problem ticked unless it is Yes."""
    done = {}
    for m in S.ORDINAL:
        problems = F.filter(F.split(F.coalesce(F.col(f"qna_{m}_issue"), F.lit("")), ";"), lambda x: (F.trim(x) != "") & (F.trim(x) != S.NO_ISSUE))
        done[f"{m}_complete"] = F.coalesce((F.col(f"qna_{m}_attribute") != "") & F.col(f"qna_{m}_binary").isin("Yes", "No") & ((F.col(f"qna_{m}_binary") == "Yes") | (F.size(problems) > 0)), F.lit(False))
    whole = reduce(lambda a, b: a & b, done.values()) & F.coalesce(canonical_label("recommendation", F.col("caregiver_recommendation")).isin(S.SCALES["recommendation"]), F.lit(False))
    return ratings.withColumns(done | {"complete": whole})


def label_counts_long(ratings: DataFrame) -> DataFrame:
    """(approach, cell, label, n) of every attribute, Yes/No, problem and recommendation cell, in one shuffle."""
    cells = [F.struct(F.lit(f"{m}_{k}").alias("cell"), F.col(f"qna_{m}_{k}").alias("label")) for m in S.BINARY for k in ("attribute", "binary", "issue") if not (m == "care_safety" and k == "attribute")]
    cells.append(F.struct(F.lit("recommendation").alias("cell"), F.col("caregiver_recommendation").alias("label")))
    return ratings.select("approach", F.explode(F.array(*cells)).alias("c")).select("approach", "c.*").filter("label is not null").groupBy("approach", "cell", "label").agg(F.count(F.lit(1)).alias("n"))


def annotator_progress(ratings: DataFrame) -> DataFrame:
    return latest_ratings(ratings).groupBy("annotator").agg(F.count(F.lit(1)).alias("rated"), F.max("created_at").alias("last_submission"))


def normalize_checkpoint_state(df: DataFrame, metric: str, attribute: str, severity: str, recommendation: str) -> DataFrame:
    """Numeric codes of old checkpoints as labels: attribute n is the option 4 - n, severity 0 to 3, recommendation 4 to 1."""
    number = lambda c: F.when(F.col(c).cast("string").rlike(r"^[0-9]$"), F.col(c).cast("string").cast("int"))
    scale, severe = S.SCALES[metric], [S.NO_ISSUE, "Minor", "Moderate", "Severe"]
    old = {4: "Yes", 3: "Yes, but with minor edits", 2: "Only after major revisions", 1: "No"}
    sev = F.coalesce(_lookup(number(severity), dict(enumerate(severe))), F.col(severity).cast("string"))
    return df.withColumns({
        attribute: F.coalesce(_lookup(number(attribute), {4 - k: label for k, label in enumerate(scale)}), F.col(attribute).cast("string")),
        severity: sev, "binary": F.when(sev == S.NO_ISSUE, "Yes").when(sev.isin(severe[1:]), "No"),
        recommendation: F.coalesce(_lookup(number(recommendation), old), F.col(recommendation).cast("string")),
    })


def restore_checkpoint(selection: DataFrame, saved: DataFrame, labels: list[str]) -> DataFrame:
    """Saved labels win over those of the current selection where they are there, by uid."""
    kept = saved.select("qa_uid", *[F.col(c).alias(f"saved_{c}") for c in labels])
    joined = selection.join(kept, "qa_uid", "left")
    return joined.withColumns({c: F.coalesce(f"saved_{c}", c) for c in labels}).drop(*[f"saved_{c}" for c in labels])


def row_numbered(df: DataFrame, partition: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
