"""Operators on what an earlier version left out, against plain versions of the whole rule."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from marlstone.llm import line_dedup, registry, substring_dedup
from tests.compare import DATA, assert_same
from tests.llm.odd import segments


def whole(rows, sentences, most, words, size, run=(0, 0)):
    """Like odd.cut, for runs of 2 to ``most`` segments that have the words or bytes of ``run`` and single ones of so many words or bytes."""
    seen, out = {}, {}
    for key in dict.fromkeys(rows):
        x = segments(key[1], sentences)
        gone = set()
        for n in range(1, most + 1):
            for i in range(len(x) - n + 1):
                g = (n, *x[i : i + n])
                least = (words, size) if n == 1 else run
                if sum(len(re.split(r"[\t-\r ]+", s)) for s in g[1:]) < least[0] and sum(len(s.encode()) for s in g[1:]) < least[1]:
                    continue
                at, j = seen.setdefault(g, (key, i))
                if (at, j) != (key, i):
                    gone.update(range(max(i, j + n) if at == key else i, i + n))
        out[key] = len(x), len(gone), [s for i, s in enumerate(x) if i not in gone]
    return out


def assert_whole(spark, got, rows, sentences, words, size, names, most=4, run=(0, 0)):
    want = whole(rows, sentences, most, words, size, run)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for r in got(table.withColumn("t", table["text"])).select("doc_id", "t", "text", *names).collect():
        assert (r[names[0]], r[names[1]], segments(r["text"], sentences)) == want[r["doc_id"], r["t"]], r["doc_id"]


def table_rows(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("text is not null").collect())


def test_runs_of_sentences_go(spark):
    """Runs of eight words or more go whole, with what is short inside and at their ends; two short sentences that stand together again stay."""
    run = "A b c. D. E f g h i. J"
    rows = [(1, f"{run}."), (2, f"X. {run}. Y."), (3, "Q. D. E f g h i. R."), (4, "A b c. D."), (5, "D. E f g h i. J. S."), (6, "日" * 120 + "\nz"), (7, "w\n" + "日" * 120), (8, "日本語日本語日本\n日本語日本語日本"), (9, "v\n日本語日本語日本\n日本語日本語日本")]
    names = ("n_sentences", "n_removed_sentences")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), 2: "X. Y.", 7: "w", 9: "v"}
    r = random.Random(8)
    chance = [(100 + i, "".join(" ".join(r.choice("ab") for _ in range(r.choice([1, 1, 1, 2, 3, 9]))) + r.choice([". ", "\n", ".\n "]) for _ in range(r.randint(0, 25)))) for i in range(60)]
    for more in (rows, chance, [(i + 10, t) for i, t in table_rows(spark)]):
        assert_whole(spark, substring_dedup.dedup_substrings, more, True, *substring_dedup.LONE, names, 9, substring_dedup.RUN)


def test_short_runs_of_lines_and_long_lines_go(spark):
    passage = "one two three four five " * 10
    rows = [(1, f"a\nb\nc\n{passage}\nz"), (2, "x\na\nb\ny"), (3, f"{passage}\ny\nc"), (4, "日本語" * 40 + "\nq"), (5, "日本語" * 40 + "\nc\nw"), (6, "five words are not enough\nr"), (7, "five words are not enough\ns")]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, table, DATA).collect()}
    assert got == {1: rows[0][1], 2: "x\ny", 3: "y\nc", 4: rows[3][1], 5: "c\nw", 6: rows[5][1], 7: rows[6][1]}
    op = lambda docs: line_dedup.dedup_lines(docs, line_dedup.SHORT_RUN, line_dedup.LINE)
    assert_whole(spark, op, rows + [(i + 10, t) for i, t in table_rows(spark)], False, *line_dedup.LINE, ("n_lines", "n_removed_lines"))


def test_most_lines_go_through_fingerprints(spark):
    """Of what goes from the table, by far the most goes as a part of a run that a chosen line led to, not as a single line."""
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    alone, all_ = (line_dedup.dedup_lines(table, line_dedup.SHORT_RUN, x).agg({"n_removed_lines": "sum"}).first()[0] for x in (None, line_dedup.LINE))
    assert 0 < all_ and alone >= 0.9 * all_


def test_single_lines_of_five_words_or_40_bytes_go(spark, tmp_path):
    """The query and its SQL: such a line goes wherever it occurs again, alone between new lines too; a shorter one stays if no neighbour of it is repeated."""
    rows = [(1, "a b c d e\nq"), (2, "r\n  a b c d e \ns"), (3, "日" * 14 + "\nt"), (4, "日" * 14 + "\nu"), (5, "日" * 13 + "\nv\na b c d"), (6, "日" * 13 + "\nw\na b c d"), (7, "x" * 40), (8, "x" * 40), (9, "x" * 39), (10, "x" * 39), (11, "f g h i j\ny\nf g h i j"), (12, None), (13, "")]
    pq.write_table(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), tmp_path / "documents.parquet")
    table = registry.QUERIES["op10_line_dedup"](spark, str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in table.collect()}
    assert got == {**dict(rows), 2: "r\n  s", 4: "u", 8: "", 11: "f g h i j\ny"}
    assert assert_same(table, registry.ORACLE_SQL["op10_line_dedup"], str(tmp_path)) == len(rows)
    ours = {r["doc_id"]: (r["n_lines"], r["n_removed_lines"], segments(r["text"], False)) for r in registry.QUERIES["op10_line_dedup"](spark, DATA).filter("text is not null").collect()}
    assert ours == {i: v for (i, _), v in whole(table_rows(spark), False, 4, 5, 40).items()}
