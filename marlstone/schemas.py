"""Row types of the domain tables, and the label scales as small tables."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("index", T.IntegerType()), ("url", T.StringType()), ("language", T.StringType()))])
SEGMENT = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])
CAPTIONS = "STRUCT<events: ARRAY<STRUCT<tStartMs: BIGINT, dDurationMs: BIGINT, segs: ARRAY<STRUCT<utf8: STRING>>>>>"
QA_PAIR = (
    "STRUCT<question: STRING, answer: STRING, timestamp: STRING, topic: STRING, source_segment: STRUCT<id: INT, topic: STRING>, "
    "time_start_sec: DOUBLE, time_end_sec: DOUBLE, time_start_hhmmss: STRING, time_end_hhmmss: STRING>"
)
BLUEPRINT = "ARRAY<STRUCT<id: INT, title: STRING, start_line: INT, end_line: INT>>"
GENERATION_META = (
    "approach STRING, prompt_version STRING, model STRING, backend STRING, provider STRING, endpoint STRING, generated_utc STRING, seed INT, thinking STRING, qa_target STRING, "
    "measured STRUCT<pairs: INT, grounded: STRING, answer_words_mean: DOUBLE, answer_words_p90: INT, answer_words_max: INT, within_60_80_target: STRING>, note STRING"
)

# The label scales of the rating form, best label first (scores 4 to 1).
SCALES = {
    "trustworthiness": ["Excellent", "Good", "Fair", "Poor"],
    "clarity": ["Very easy to understand", "Easy", "Somewhat difficult", "Difficult"],
    "usefulness": ["Highly useful", "Useful", "Limited useful", "Not useful"],
    "recommendation": ["Yes", "Yes, but with minor edits (meaning unchanged)", "No, it needs major edits", "No"],
}
# Older names of labels.
ALIASES = {
    "usefulness": {"Highly actionable": "Highly useful", "Very useful": "Highly useful", "Actionable": "Useful", "Limited usefulness": "Limited useful"},
    "recommendation": {
        "Yes, but with minor edits": "Yes, but with minor edits (meaning unchanged)",
        "Yes, but with minor edits (does not significantly alter the substance or meaning of the content)": "Yes, but with minor edits (meaning unchanged)",
        "Only after major revisions": "No, it needs major edits",
    },
}
# Problems that can be ticked for a metric, and older names of them.
ERRORS = {
    "trustworthiness": ["Source Misinterpretation", "Hallucinating", "Contradiction", "Missing Key Information"],
    "clarity": ["Difficult vocabulary", "Too long", "Ambiguous", "Poor organization"],
    "usefulness": ["Not actionable", "Missing Explanation", "Generic Advice", "Low Relevance to Caregiver Needs"],
    "care_safety": ["Unsafe medical or health advice", "Physical safety risk", "Blaming or judgmental language", "Discourages professional care"],
}
ERROR_ALIASES = {
    "Unsafe Medical or Health Advice": "Unsafe medical or health advice",
    "Physical Safety Risk": "Physical safety risk",
    "Dismissive or Harmful Communication": "Blaming or judgmental language",
    "Discourages Professional Care": "Discourages professional care",
}
# Binary answers that count as a pass; for care safety the question asks for harm.
PASSES = {"trustworthiness": "Yes", "clarity": "Yes", "usefulness": "Yes", "care_safety": "No"}
NO_ISSUE = "No issue"
# Columns of older exports, by today's names, and columns that were never filled.
RENAMED = {
    "qa_alignment_attribute": "qna_trustworthiness_attribute", "qa_alignment_error": "qna_trustworthiness_issue", "qa_alignment_binary": "qna_trustworthiness_binary",
    "qa_accessibility_attribute": "qna_clarity_attribute", "qa_accessibility_error": "qna_clarity_issue", "qa_accessibility_binary": "qna_clarity_binary",
    "qa_edu_actionable_attribute": "qna_usefulness_attribute", "qa_edu_actionable_error": "qna_usefulness_issue", "qa_edu_actionable_binary": "qna_usefulness_binary",
    "qa_mental_health_error": "qna_care_safety_issue", "qa_mental_health_binary": "qna_care_safety_binary",
}
LEGACY = ["q_fluency", "a_fluency", "q_clarity", "a_clarity", "qa_alignment", "q_edu_value", "a_edu_value", "standalone"]
ORDINAL, BINARY = ["trustworthiness", "clarity", "usefulness"], ["trustworthiness", "clarity", "usefulness", "care_safety"]
