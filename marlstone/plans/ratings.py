"""Queries of rating analysis and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone import schemas as S
from marlstone.operators import ratings as R
from marlstone.operators import stats as T
from marlstone.plans import adapters as A

KEYS = ["id", "session_id", "annotator", "qa_uid", "approach", "dataset"]


def _latest(spark, d):
    return R.latest_ratings(A.ratings(spark, d))


def _long(spark, d):
    return R.long_scores(R.score_ratings(_latest(spark, d)), KEYS)


def _case(metric: str, column: str) -> str:
    alias = S.ALIASES.get(metric, {})
    names = [(x, 4 - k) for k, label in enumerate(S.SCALES[metric]) for x in (label, *(a for a, b in alias.items() if b == label))]
    return f"CASE {column} " + " ".join(f"WHEN '{x}' THEN {n}" for x, n in names) + " END"


LATEST = A.RATINGS + ", latest AS (SELECT * FROM ratings QUALIFY row_number() OVER (PARTITION BY session_id, qa_uid ORDER BY created_at DESC, id DESC) = 1)"
_one = [
    f"SELECT {', '.join(KEYS)}, '{m}' AS metric, {_case(m, f'qna_{m}_attribute') if m in S.ORDINAL else 'NULL'} AS score, CASE WHEN qna_{m}_binary IN ('Yes', 'No') THEN CAST(qna_{m}_binary = '{S.PASSES[m]}' AS INT) END AS pass FROM latest" for m in S.BINARY
]
_one.append(f"SELECT {', '.join(KEYS)}, 'recommendation', {_case('recommendation', 'caregiver_recommendation')}, NULL FROM latest")
LONG = LATEST + ", long AS (" + " UNION ALL ".join(_one) + ")"


def _describe(by: str) -> str:
    return f"""modes AS (SELECT {by}, score AS mode FROM (SELECT {by}, score, COUNT(*) AS c FROM long WHERE score IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY c DESC, score) = 1),
 ordinal AS (SELECT {by}, COUNT(*) AS n, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3, COUNT(*) FILTER (score >= 3) AS top2_n, COUNT(*) FILTER (score <= 1) AS worst_n FROM long WHERE score IS NOT NULL GROUP BY ALL)"""


def _wilson(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k} * 1.0 / {n})", "1.96e0"
    mid, half, d = f"({p} + {z} * {z} / (2 * {n}))", f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n}))", f"(1 + {z} * {z} / {n})"
    return f"CASE WHEN {n} > 0 THEN greatest(({mid} - {half}) / {d}, 0) END", f"CASE WHEN {n} > 0 THEN least(({mid} + {half}) / {d}, 1) END"


_lo, _hi = _wilson("top2_n", "n")
_plo, _phi = _wilson("pass_n", "pass_total")
_CELLS = " UNION ALL ".join(f"SELECT id, approach, '{m}' AS metric, qna_{m}_issue AS raw FROM latest" for m in S.BINARY)
_fix = "CASE trim(e) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.ERROR_ALIASES.items()) + " ELSE trim(e) END"
ISSUES = LATEST + f", cells AS ({_CELLS}), ticked AS (SELECT id, approach, metric, raw, {_fix} AS error FROM (SELECT *, unnest(string_split(raw, '; ')) AS e FROM cells WHERE raw IS NOT NULL))"
_KNOWN = " OR ".join(f"(metric = '{m}' AND error IN ({', '.join(repr(e) for e in errors)}))" for m, errors in S.ERRORS.items())
_LABELS = " UNION ALL ".join(f"SELECT '{m}' AS metric, {_case(m, c)} AS score, {c} AS label FROM latest" for m, c in [*((m, f"qna_{m}_attribute") for m in S.ORDINAL), ("recommendation", "caregiver_recommendation")])
_CELLNAMES = [(f"{m}_{k}", f"qna_{m}_{k}") for m in S.BINARY for k in ("attribute", "binary", "issue") if (m, k) != ("care_safety", "attribute")] + [("recommendation", "caregiver_recommendation")]
_DIM = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{label}' AS label, {4 - k} AS score" for m, labels in S.SCALES.items() for k, label in enumerate(labels))
_done = {m: f"coalesce(qna_{m}_attribute <> '' AND qna_{m}_binary IN ('Yes', 'No') AND (qna_{m}_binary = 'Yes' OR len(list_filter(string_split(coalesce(qna_{m}_issue, ''), ';'), lambda x: trim(x) <> '' AND trim(x) <> 'No issue')) > 0), false)" for m in S.ORDINAL}


def completeness(spark, d):
    return R.completeness(_latest(spark, d)).select("id", *[f"{m}_complete" for m in S.ORDINAL], "complete")


def issue_cells(spark, d):
    return _latest(spark, d).select("id", R.normalize_issue_cell(F.col("qna_care_safety_issue")).alias("cell")).filter("cell is not null")


def union_exports(spark, d):
    """Half of the log under today's names, half under the older ones with an empty legacy column."""
    whole = A.ratings(spark, d).select("id", "qna_clarity_attribute", "qna_care_safety_binary")
    old = whole.filter("id % 2 = 1").withColumnsRenamed({"qna_clarity_attribute": "qa_accessibility_attribute", "qna_care_safety_binary": "qa_mental_health_binary"}).withColumn("q_fluency", F.lit(None).cast("string"))
    return R.union_exports([whole.filter("id % 2 = 0"), old])


def restore_checkpoint(spark, d):
    """The first rating of each rater and pair, with the labels of the latest one restored by uid and rater."""
    now = A.ratings(spark, d).select(F.concat_ws("|", "session_id", "qa_uid").alias("qa_uid"), "id", "caregiver_recommendation")
    saved = _latest(spark, d).select(F.concat_ws("|", "session_id", "qa_uid").alias("qa_uid"), "caregiver_recommendation")
    return R.restore_checkpoint(now, saved, ["caregiver_recommendation"]).select("id", "caregiver_recommendation")


def checkpoint_state(spark, d):
    codes = A.table(spark, d, "events").selectExpr("event_id AS id", "CAST(event_id % 6 AS STRING) AS attribute", "CASE WHEN event_id % 5 = 4 THEN 'Severe' ELSE CAST(event_id % 5 AS STRING) END AS severity", "CAST(event_id % 7 AS STRING) AS recommendation")
    return R.normalize_checkpoint_state(codes, "clarity", "attribute", "severity", "recommendation")


def _pick(labels: list[str], n: str, base: int = 0) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {k + base} THEN '{x}'" for k, x in enumerate(labels)) + f" ELSE CAST({n} AS VARCHAR) END"


def _fisher_sql(good: str, known: str) -> str:
    """p by adding up all tables with the same margins."""
    log = lambda x, y: f"(lgamma({x} + 1) - lgamma({y} + 1) - lgamma({x} - ({y}) + 1))"
    at = lambda x: f"({log('r', x)} + {log('s', f'k - {x}')} - {log('r + s', 'k')})"
    n = lambda level, x: f"COUNT(*) FILTER (approach = '{level}' AND {x}({good}))"
    return f"""WITH {LONG}, t AS (SELECT metric, {n('MultiAgent', '')} AS a, {n('MultiAgent', 'NOT ')} AS b, {n('SingleAgent', '')} AS c, {n('SingleAgent', 'NOT ')} AS d FROM long WHERE {known} IS NOT NULL GROUP BY metric),
 m AS (SELECT *, CAST(a + b AS DOUBLE) AS r, CAST(c + d AS DOUBLE) AS s, CAST(a + c AS DOUBLE) AS k FROM t), x AS (SELECT *, unnest(range(CAST(greatest(0, k - s) AS BIGINT), CAST(least(r, k) AS BIGINT) + 1)) AS x FROM m WHERE r > 0 AND s > 0 AND k > 0 AND b + d > 0),
 p AS (SELECT metric, SUM(CASE WHEN {at('x')} <= {at('a')} + 1e-7 THEN exp({at('x')}) ELSE 0 END) AS p FROM x GROUP BY metric)
 SELECT metric, a, b, c, d, round(least(1.0, coalesce(p, 1.0)), 9) AS p FROM m LEFT JOIN p USING (metric)"""


def fisher_exact(spark, d):
    return T.fisher_exact(T.top2_tables(_long(spark, d), "approach", "MultiAgent", "SingleAgent")).withColumn("p", F.round("p", 9))


def fisher_binary(spark, d):
    return T.fisher_exact(T.binary_tables(_long(spark, d), "approach", "MultiAgent", "SingleAgent")).withColumn("p", F.round("p", 9))


def median_labels(spark, d):
    return T.with_labels(T.describe_ordinal(T.histogram(_long(spark, d), ["metric"]), ["metric"])).select("metric", "median", "mode", "median_label", "mode_label")


def krippendorff_alpha(spark, d):
    return T.krippendorff_alpha(_long(spark, d))


QUERIES = {
    "latest_ratings": lambda s, d: _latest(s, d).select("id", "session_id", "qa_uid", "created_at"),
    "score_labels": lambda s, d: _long(s, d).select("id", "metric", "score", "pass"),
    "summary_overall": lambda s, d: T.summary_overall(_long(s, d)),
    "summary_by_approach": lambda s, d: T.summary_by_group(_long(s, d), "approach"),
    "label_distribution": lambda s, d: T.label_distribution(_long(s, d), "approach"),
    "binary_pass_rate": lambda s, d: T.binary_pass_rate(_long(s, d), ["metric"]),
    "approach_top2_table": lambda s, d: T.approach_top2_table(_long(s, d), "MultiAgent", "SingleAgent"),
    "coverage": lambda s, d: R.coverage(_latest(s, d)),
    "annotator_by_approach": lambda s, d: R.annotator_by_approach(_latest(s, d), ["MultiAgent", "SingleAgent"]),
    "error_taxonomy": lambda s, d: R.error_taxonomy(_latest(s, d), "approach"),
    "unexpected_labels": lambda s, d: R.unexpected_labels(_latest(s, d)),
    "unmapped_labels": lambda s, d: R.unmapped_labels(_latest(s, d)),
    "annotator_calibration": lambda s, d: T.annotator_calibration(_long(s, d)),
    "annotator_order": lambda s, d: T.annotator_order(_long(s, d)),
    "annotator_pace": lambda s, d: T.annotator_pace(_latest(s, d)),
    "annotator_progress": lambda s, d: R.annotator_progress(A.ratings(s, d)),
    "overlap_ratings": lambda s, d: R.overlap_ratings(_latest(s, d)).select("id", "qa_uid", "annotator"),
    "krippendorff_alpha": krippendorff_alpha,
    "agreement_rates": lambda s, d: T.agreement_rates(_long(s, d)),
    "fast_ratings": lambda s, d: R.fast_ratings(_latest(s, d)).select("id", "annotator", "seconds_spent"),
    "rated_rows": lambda s, d: R.rated_rows(A.ratings(s, d)).select("id"),
    "completeness": completeness,
    "label_counts_long": lambda s, d: R.label_counts_long(_latest(s, d)),
    "mann_whitney": lambda s, d: T.mann_whitney(_long(s, d), "approach", "MultiAgent", "SingleAgent").drop("p"),
    "fisher_exact": fisher_exact,
    "fisher_binary": fisher_binary,
    "median_labels": median_labels,
    "normalize_issue_cell": issue_cells,
    "union_exports": union_exports,
    "restore_checkpoint": restore_checkpoint,
    "normalize_checkpoint_state": checkpoint_state,
}
ORACLE_SQL = {
    "latest_ratings": f"WITH {LATEST} SELECT id, session_id, qa_uid, created_at FROM latest",
    "score_labels": f"WITH {LONG} SELECT id, metric, CAST(score AS BIGINT) AS score, CAST(pass AS BIGINT) AS pass FROM long",
    "summary_overall": f"""WITH {LONG}, {_describe('metric')}, passes AS (SELECT metric, SUM(pass) AS pass_n, COUNT(pass) AS pass_total FROM long WHERE pass IS NOT NULL GROUP BY metric)
 SELECT metric, n, median, CAST(mode AS BIGINT) AS mode, q1, q3, q3 - q1 AS iqr, top2_n, round(100.0 * top2_n / n, 6) AS top2_pct, worst_n, round({_lo}, 6) AS top2_low, round({_hi}, 6) AS top2_high,
 CAST(pass_n AS BIGINT) AS pass_n, pass_total, round(100.0 * pass_n / pass_total, 6) AS pass_pct, round({_plo}, 6) AS pass_low, round({_phi}, 6) AS pass_high
 FROM ordinal JOIN modes USING (metric) FULL JOIN passes USING (metric)""",
    "summary_by_approach": f"WITH {LONG}, {_describe('metric, approach')} SELECT metric, approach, n, median, round(100.0 * top2_n / n, 6) AS top2_pct FROM ordinal QUALIFY COUNT(*) OVER (PARTITION BY metric) >= 2",
    "label_distribution": f"""WITH {LONG}, dim AS ({_DIM}), g AS (SELECT DISTINCT metric, approach FROM long WHERE score IS NOT NULL), c AS (SELECT metric, approach, score, COUNT(*) AS n FROM long WHERE score IS NOT NULL GROUP BY ALL)
 SELECT metric, approach, label, CAST(dim.score AS BIGINT) AS score, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / SUM(coalesce(n, 0)) OVER (PARTITION BY metric, approach), 6) AS pct FROM g JOIN dim USING (metric) LEFT JOIN c USING (metric, approach, score)""",
    "binary_pass_rate": f"WITH {LONG}, p AS (SELECT metric, SUM(pass) AS pass_n, COUNT(pass) AS pass_total FROM long WHERE pass IS NOT NULL GROUP BY metric) SELECT metric, CAST(pass_n AS BIGINT) AS pass_n, pass_total, round(100.0 * pass_n / pass_total, 6) AS pass_pct, round({_plo}, 6) AS pass_low, round({_phi}, 6) AS pass_high FROM p",
    "approach_top2_table": f"""WITH {LONG}, {_describe('metric, approach')}, x AS (SELECT metric, approach, n, round(100.0 * top2_n / n, 6) AS top2_pct, round(100 * {_lo}, 6) AS low, round(100 * {_hi}, 6) AS high FROM ordinal)
 SELECT a.metric, a.n AS n_a, a.top2_pct AS top2_pct_a, a.low AS low_a, a.high AS high_a, b.n AS n_b, b.top2_pct AS top2_pct_b, b.low AS low_b, b.high AS high_b, round(a.top2_pct - b.top2_pct, 6) AS delta_pp
 FROM x a JOIN x b ON a.metric = b.metric AND a.approach = 'MultiAgent' AND b.approach = 'SingleAgent'""",
    "coverage": f"""WITH {LATEST}, c AS (SELECT 'all' AS grouping, 'all' AS level, * FROM latest UNION ALL SELECT 'approach', approach, * FROM latest UNION ALL SELECT 'dataset', dataset, * FROM latest UNION ALL SELECT 'batch', batch, * FROM latest)
 SELECT grouping, level, COUNT(*) AS ratings, COUNT(DISTINCT qa_uid) AS pairs, COUNT(DISTINCT annotator) AS annotators, COUNT(DISTINCT session_id) AS sessions, COUNT(*) < 100 AS small_n FROM c GROUP BY ALL""",
    "annotator_by_approach": f"WITH {LATEST} SELECT annotator, COUNT(*) FILTER (approach = 'MultiAgent') AS MultiAgent, COUNT(*) FILTER (approach = 'SingleAgent') AS SingleAgent FROM latest GROUP BY annotator",
    "error_taxonomy": f"""WITH {ISSUES}, totals AS (SELECT metric, approach, COUNT(*) AS cells, COUNT(*) FILTER (raw <> 'No issue') AS flagged FROM cells WHERE raw IS NOT NULL GROUP BY ALL)
 SELECT metric, approach, error, COUNT(*) AS n, round(100.0 * COUNT(*) / any_value(cells), 6) AS pct, round(100.0 * any_value(flagged) / any_value(cells), 6) AS flagged_pct FROM ticked JOIN totals USING (metric, approach) WHERE {_KNOWN} GROUP BY metric, approach, error""",
    "unexpected_labels": f"WITH {ISSUES} SELECT metric, error, COUNT(*) AS n FROM ticked WHERE error <> 'No issue' AND NOT ({_KNOWN}) GROUP BY ALL",
    "unmapped_labels": f"WITH {LATEST} SELECT metric, label, COUNT(*) AS n FROM ({_LABELS}) WHERE label IS NOT NULL AND score IS NULL GROUP BY ALL",
    "annotator_calibration": f"WITH {LONG}, {_describe('annotator, metric')} SELECT annotator, metric, n, median, round(100.0 * top2_n / n, 6) AS top2_pct FROM ordinal",
    "annotator_order": f"WITH {LONG} SELECT annotator, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, annotator) AS place FROM long WHERE score IS NOT NULL GROUP BY annotator",
    "annotator_pace": f"WITH {LATEST} SELECT annotator, COUNT(DISTINCT qa_uid) AS pairs, quantile_cont(seconds_spent, 0.5) AS median_seconds FROM latest GROUP BY annotator",
    "annotator_progress": f"WITH {LATEST} SELECT annotator, COUNT(*) AS rated, MAX(created_at) AS last_submission FROM latest GROUP BY annotator",
    "overlap_ratings": f"WITH {LATEST} SELECT id, qa_uid, annotator FROM latest WHERE qa_uid IN (SELECT qa_uid FROM latest GROUP BY qa_uid HAVING COUNT(DISTINCT annotator) > 1)",
    "krippendorff_alpha": f"""WITH {LONG}, v AS (SELECT metric, qa_uid, score, COUNT(*) AS n FROM long WHERE score IS NOT NULL GROUP BY ALL), u AS (SELECT metric, qa_uid, SUM(n) AS m FROM v GROUP BY ALL HAVING SUM(n) > 1),
 o AS (SELECT a.metric, a.score AS c, b.score AS k, SUM(a.n * (b.n - CASE WHEN a.score = b.score THEN 1 ELSE 0 END) * 1.0 / (m - 1)) AS o FROM v a JOIN u USING (metric, qa_uid) JOIN v b ON b.metric = a.metric AND b.qa_uid = a.qa_uid GROUP BY ALL),
 w AS (SELECT metric, c, SUM(o) AS nc FROM o GROUP BY ALL), t AS (SELECT metric, SUM(nc) AS n FROM w GROUP BY metric),
 d AS (SELECT a.metric, a.c, b.c AS k, a.nc * b.nc AS e, pow((SELECT SUM(g.nc) FROM w g WHERE g.metric = a.metric AND g.c BETWEEN least(a.c, b.c) AND greatest(a.c, b.c)) - (a.nc + b.nc) / 2, 2) AS d FROM w a JOIN w b USING (metric))
 SELECT metric, (SELECT COUNT(*) FROM u WHERE u.metric = d.metric) AS units, round(CASE WHEN SUM(e * d) = 0 THEN 1.0 ELSE 1 - (any_value(n) - 1) * SUM(coalesce(o, 0) * d) / SUM(e * d) END, 6) AS alpha FROM d LEFT JOIN o USING (metric, c, k) JOIN t USING (metric) GROUP BY metric""",
    "agreement_rates": f"WITH {LONG}, u AS (SELECT metric, qa_uid, MIN(score) AS lo, MAX(score) AS hi FROM long WHERE score IS NOT NULL GROUP BY ALL HAVING COUNT(*) > 1) SELECT metric, COUNT(*) AS units, round(AVG(CAST(lo = hi AS INT)), 6) AS exact, round(AVG(CAST(hi - lo <= 1 AS INT)), 6) AS within_one FROM u GROUP BY metric",
    "fast_ratings": f"WITH {LATEST} SELECT id, annotator, seconds_spent FROM latest WHERE seconds_spent < 15",
    "rated_rows": f"WITH {A.RATINGS} SELECT id FROM ratings WHERE coalesce({', '.join(f'qna_{m}_binary' for m in S.BINARY)}, caregiver_recommendation) IS NOT NULL",
    "completeness": f"WITH {LATEST} SELECT id, {', '.join(f'{x} AS {m}_complete' for m, x in _done.items())}, {' AND '.join(_done.values())} AND coalesce({_case('recommendation', 'caregiver_recommendation')} IS NOT NULL, false) AS complete FROM latest",
    "label_counts_long": f"WITH {LATEST} SELECT approach, cell, label, COUNT(*) AS n FROM ({' UNION ALL '.join(f'''SELECT approach, '{n}' AS cell, {c} AS label FROM latest''' for n, c in _CELLNAMES)}) WHERE label IS NOT NULL GROUP BY ALL",
    "fisher_exact": _fisher_sql("score >= 3", "score"),
    "fisher_binary": _fisher_sql("pass = 1", "pass"),
    "median_labels": f"""WITH {LONG}, {_describe("metric")}, dim AS ({_DIM}) SELECT o.metric, median, mode, CASE WHEN median <> floor(median) THEN 'between labels' ELSE a.label END AS median_label, b.label AS mode_label
 FROM ordinal o JOIN modes USING (metric) LEFT JOIN dim a ON a.metric = o.metric AND a.score = median LEFT JOIN dim b ON b.metric = o.metric AND b.score = mode""",
    "mann_whitney": f"""WITH {LONG}, h AS (SELECT metric, score, COUNT(*) FILTER (approach = 'MultiAgent') AS a, COUNT(*) FILTER (approach = 'SingleAgent') AS b FROM long WHERE score IS NOT NULL GROUP BY ALL),
 n AS (SELECT metric, CAST(SUM(a) AS BIGINT) AS n1, CAST(SUM(b) AS BIGINT) AS n2, SUM(CAST(a + b AS DOUBLE) * (a + b) * (a + b) - (a + b)) AS ties FROM h GROUP BY metric), u AS (SELECT x.metric, SUM(x.a * y.b * CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS u FROM h x JOIN h y USING (metric) GROUP BY ALL),
 r AS (SELECT metric, n1, n2, CAST(u AS DOUBLE) AS u, ties, round(2 * CAST(u AS DOUBLE) / (n1 * n2) - 1, 6) AS cliffs_delta FROM n JOIN u USING (metric) WHERE n1 > 0 AND n2 > 0)
 SELECT *, CASE WHEN abs(cliffs_delta) < 0.147 THEN 'negligible' WHEN abs(cliffs_delta) < 0.33 THEN 'small' WHEN abs(cliffs_delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM r""",
    "normalize_issue_cell": f"WITH {LATEST} SELECT id, list_aggregate(list_transform(string_split(qna_care_safety_issue, '; '), lambda e: {_fix}), 'string_agg', '; ') AS cell FROM latest WHERE qna_care_safety_issue IS NOT NULL",
    "union_exports": f"WITH {A.RATINGS} SELECT id, qna_clarity_attribute, qna_care_safety_binary FROM ratings",
    "restore_checkpoint": f"WITH {LATEST} SELECT r.id, coalesce(l.caregiver_recommendation, r.caregiver_recommendation) AS caregiver_recommendation FROM ratings r LEFT JOIN latest l USING (session_id, qa_uid)",
    "normalize_checkpoint_state": f"""SELECT event_id AS id, {_pick(list(reversed(S.SCALES['clarity'])), 'event_id % 6', 1)} AS attribute, {_pick(['No issue', 'Minor', 'Moderate', 'Severe', 'Severe'], 'event_id % 5')} AS severity,
 CASE WHEN event_id % 5 = 0 THEN 'Yes' ELSE 'No' END AS binary, {_pick(['No', 'Only after major revisions', 'Yes, but with minor edits', 'Yes'], 'event_id % 7', 1)} AS recommendation FROM events""",
}
