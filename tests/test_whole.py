"""Queries on the rows that an earlier version left out, against plain versions."""

from __future__ import annotations

import re

from marlstone.operators import corpus
from marlstone.plans import registry
from tests.compare import DATA


def test_every_vector_can_be_found(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r["embedding"] is not None and r["label"] is not None]
    want = {}
    for q in rows:
        if q["vec_id"] % 50 == 0:
            near = sorted((round(sum((a - b) ** 2 for a, b in zip(q["embedding"], c["embedding"], strict=True)), 6), c["vec_id"]) for c in rows if c["label"] == q["label"])
            want |= {(q["vec_id"], k + 1): x for k, x in enumerate(near[:5])}
    got = {(r["q_id"], r["rank"]): (r["distance"], r["chunk_id"]) for r in registry.QUERIES["retrieve_top_k"](spark, DATA).collect()}
    assert got.keys() == want.keys() and any(i % 50 == 0 for _, i in got.values())
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


def test_every_turn_is_parsed(spark, tmp_path):
    """Numbers within items, items over several lines, blank ones, and all turns of the table."""
    turns = [(r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    turns += [(-1, 0, "Use 2. 5 cups"), (-1, 1, "First\nsecond line. 3. third"), (-1, 2, "a. \n7. b. . c"), (-1, 3, ""), (-1, 4, None), (-1, 5, "v1.2 is out\n")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for conv, turn, text in turns:
        if text is not None:
            listed = "\n".join(f"{i}. {x}" for i, x in enumerate(text.split(". "), 1))
            items = [m[1].strip() for x in listed.split("\n") if (m := re.match(r"\s*\d+\.\s*(.+)", x))]
            want[conv, turn] = sum(x != "" for x in items), sum(x.strip() != "" for x in re.split(r"\d+\.\s*", listed))
    got = {(r["conv_id"], r["turn"]): (r["lines"], r["parts"]) for r in registry.QUERIES["numbered_lists"](spark, str(tmp_path)).collect()}
    assert got == want and any(a != b for a, b in got.values())


def test_exact_copies_are_near_duplicates(spark):
    """Copies come with the least uid of theirs, with or without a near text; the share is over all rows."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [("a", "the same words here"), ("b", "the same words here"), ("c", "the same words here"), ("d", near), ("e", near + " x"), ("f", near), ("g", "alone it stands now"), ("h", None)]
    table = spark.createDataFrame(rows, "uid string, question string")
    got = {(r["uid_a"], r["uid_b"]): r["jaccard"] for r in corpus.near_duplicate_questions(table).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 1.0, ("d", "f"): 1.0, ("d", "e"): 0.923077}
    assert tuple(corpus.near_duplicate_rate(table).first()) == (7, 6, 0.857143)
    docs = [(str(r["doc_id"]), r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("text is not null").collect()]
    w = {u: t.lower().split() for u, t in docs}
    grams = {u: {tuple(x[i : i + 5]) for i in range(len(x) - 4)} or {tuple(x)} - {()} for u, x in w.items()}
    text = dict(docs)
    count = sum(any(v != u and (text[u] == text[v] or g and round(len(g & h) / len(g | h), 6) >= 0.75) for v, h in grams.items()) for u, g in grams.items())
    one = registry.QUERIES["near_duplicate_rate"](spark, DATA).first()
    assert (one["pairs"], one["near_duplicates"]) == (len(docs), count)


def test_near_duplicate_classes(spark, monkeypatch):
    """Chains of near questions, groups that no star links as a whole, and a large group of near copies that costs about its size."""
    import random

    r = random.Random(12)
    rows, n = [("x", None), ("y", " "), ("z", " ")], 0
    for _ in range(25):
        words = [r.choice("abcdefghij") + r.choice("klmnop") for _ in range(r.randint(4, 40))]
        for _ in range(r.randint(1, 9)):
            if words and r.random() < 0.7:
                words[r.randrange(len(words))] = r.choice("uvw")
            rows += [(f"q{n + k:03d}", " ".join(words)) for k in range(r.randint(1, 2))]
            n += 2
    known = {u: q for u, q in rows if q is not None}
    sets = {u: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()} for u, q in known.items() if (w := q.split()) or True}
    up = {u: u for u in known}

    def root(u):
        return u if up[u] == u else root(up[u])

    for a in known:
        for b in known:
            if a < b and (known[a] == known[b] or sets[a] and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) >= 0.75):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = {u: root(u) for u in known}
    got = corpus.near_duplicate_classes(spark.createDataFrame(rows, "uid string, question string")).collect()
    assert {x["uid"]: x["class"] for x in got} == want and len(got) == len(known)
    assert all(x["class_size"] == list(want.values()).count(x["class"]) and x["n_copies"] == list(known.values()).count(known[x["uid"]]) and x["kept"] == (x["uid"] == x["class"]) for x in got)
    assert corpus.near_duplicate_classes(spark.createDataFrame([], "uid string, question string")).count() == 0

    seen = []
    near = corpus._near
    monkeypatch.setattr(corpus, "_near", lambda candidates, *rest: seen.append(candidates.count()) or near(candidates, *rest))
    base = [f"w{i}" for i in range(60)]
    many = [(f"m{i:05d}", " ".join([*base[: i % 50], f"new{i}", *base[i % 50 + 1 :]])) for i in range(3000)]
    out = corpus.near_duplicate_classes(spark.createDataFrame(many, "uid string, question string"))
    assert out.groupBy("class").count().collect() == [("m00000", 3000)] and sum(seen) < 20 * 3000


def test_far_packs_are_not_visited(spark):
    """On clustered vectors most packs are left out, and the rows are those of comparing all; equal vectors and small blocks too."""
    import numpy as np
    from pyspark.sql import functions as F

    from marlstone.operators import select

    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 8)) * 20
    vectors = np.concatenate([(centres[r.integers(0, 8, 9000)] + r.normal(size=(9000, 8)) * 0.2), np.ones((1500, 8)), r.normal(size=(3, 8))])
    block = [0] * 9000 + [1] * 1500 + [2] * 3
    chunks = spark.createDataFrame([(b, i, v) for i, (b, v) in enumerate(zip(block, vectors.tolist()))] + [(0, 99999, None)], "block long, chunk_id long, embedding array<double>")
    questions = chunks.filter("chunk_id % 500 = 0 or chunk_id >= 10500").select("block", F.col("chunk_id").alias("q_id"), "embedding")
    got: dict = {}
    for x in select.retrieve_top_k(questions, chunks, "block").collect():
        got.setdefault(x["q_id"], []).append((x["rank"], x["distance"], x["chunk_id"]))
    for q in [x["q_id"] for x in questions.filter("embedding is not null").collect()]:
        same = [i for i in range(len(block)) if block[i] == block[q]]
        plain = sorted((round(float(((vectors[i] - vectors[q]) ** 2).sum()), 6), i) for i in same)[:5]
        assert [(d, i) for _, d, i in sorted(got[q])] == plain
    assert 99999 not in got
    packs, pivots = select._vector_packs(chunks.filter("embedding is not null").select("block", F.col("chunk_id").alias("id"), F.col("embedding").alias("v")), "block")
    asked = questions.filter("block = 0 and embedding is not null").select("block", "q_id", F.col("embedding").alias("v"))
    visits = select._packs_to_visit(asked, pivots, packs, "block", 5).count()
    assert packs.agg(F.max(F.size("c"))).first()[0] < 4 * select.PACK
    assert visits < 0.5 * asked.count() * packs.filter("block = 0").count()


def test_selection_from_one_very_large_video(spark):
    """A video with most questions, ties and empty scores: the rows of plain selection, and what is sorted is cut down before the shuffle."""
    import random

    from pyspark.sql import functions as F

    from marlstone.operators import select

    r = random.Random(3)
    rows = [(0 if r.random() < 0.8 else r.randint(1, 4), r.choice("abcd"), i, r.choice([None, 1.0, 2.0, 7.0, 7.5])) for i in range(4000)]
    rows += [(9, "a", 1, 5.0), (9, "b", 2, 5.0), (8, "a", 3, 5.0), (8, "a", 4, 5.0), (8, "a", 5, 1.0), (8, "b", 6, 9.0), (8, "b", 7, 9.0), (7, None, 1, 5.0)]
    pool = spark.createDataFrame(rows, "video int, segment string, id int, score double").repartition(6)
    for k in (1, 4, 20):
        quotas = {(q["video"], q["segment"]): q["quota"] for q in select.largest_remainder_quotas(select.segment_quality(pool, ["video"]), ["video"], F.lit(k)).collect()}
        want = set()
        for video in {v for v, *_ in rows} - {7}:
            order = sorted((x for x in rows if x[0] == video), key=lambda x: (x[3] is None, -(x[3] or 0), -x[2]))
            first = [x for s in "abcd" for x in [y for y in order if y[1] == s][: quotas.get((video, s), 0)]]
            want |= set(first) | set([x for x in order if x not in first][: k - len(first)])
        out = select.select_proportional(pool, ["video"], k)
        got = out.collect()
        assert out.columns == ["video", "segment", "id", "score", "selected"] and len(got) == len(rows)
        assert {tuple(x)[:4] for x in got if x["selected"]} == want
    plan = select.select_proportional(pool, ["video"], 20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_only_questions_that_can_be_near_are_kept(spark, monkeypatch):
    """Pairs of several thresholds as by brute force, among sets of all sizes with copies and a common phrase; shingles are stored for few others, and texts stay out of what is joined."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = [(f"far{i}", " ".join([*[word() for _ in range(30)], "one common phrase of six words", *[word() for _ in range(30)]])) for i in range(300)]
    for i in range(40):
        words = [word() for _ in range(r.choice([1, 3, 4, 5, 6, 9, 30, 80]))]
        for j in range(3):
            rows.append((f"near{i:02d}{j}", " ".join(words)))
            words[r.randrange(len(words))] = word() if r.random() < 0.8 else words[0]
    sets = {u: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for u, q in rows if (w := q.split())}
    text = dict(rows)
    least = {q: min(u for u, x in rows if x == q) for q in text.values()}
    table = spark.createDataFrame(rows, "uid string, question string").repartition(3)
    stored = {}
    put = corpus.materialize
    monkeypatch.setattr(corpus, "materialize", lambda df, name: stored.setdefault(name, put(df, name)) if name == "question_shingles" else put(df, name))
    for threshold in (0.3, 0.75, 1.0):
        stored.clear()
        want = {(least[q], u): 1.0 for u, q in rows if u != least[q]}
        want |= {(a, b): j for a in least.values() for b in least.values() if a < b and (j := round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) >= threshold}
        out = corpus.near_duplicate_questions(table, threshold)
        assert {(x["uid_a"], x["uid_b"]): x["jaccard"] for x in out.collect()} == want
        assert "question#" not in out._jdf.queryExecution().optimizedPlan().toString()
        if threshold == 0.75:
            assert len({x for pair in want for x in pair}) > 20 and not any(x["uid"].startswith("far") for x in stored["question_shingles"].collect())
