"""Operators over whole tables, the pipeline, and queries that SQL can express."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import embeddings, jaccard, registry, sharding
from marlstone.operators.components import connected_components
from tests.compare import assert_same
from tests.llm.odd import TEXTS, components, documents, shingles

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, DATA), registry.ORACLE_SQL[name], DATA)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    real = [(a, b) for a, b in edges if a != b]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(rows):
    ids = [i for i, _ in rows]
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = components(range(len(rows)), links)
    least: dict = {}
    for k, c in root.items():
        least[c] = min(x for x in (least.get(c), ids[k]) if x is not None) if ids[k] is not None or least.get(c) is not None else None
    return sorted(((i, len(s), least[root[k]]) for k, (i, s) in enumerate(zip(ids, sets, strict=True))), key=str)


def test_jaccard_odd(spark):
    got = jaccard.jaccard_classes(documents(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(TEXTS)
    assert jaccard.jaccard_classes(documents(spark).limit(0)).count() == 0


def test_jaccard_groups(spark):
    """Groups of copies with edits of all sizes, so that many pairs lie near the threshold, and a passage that many share."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = " ".join(word() for _ in range(12))
    rows, n = [], 0
    for g in range(12):
        base = [word() for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 14)):
            x = list(base)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = word()
            rows.append((n := n + 1, " ".join(x) + (" " + shared if g % 2 else "")))
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows)


def test_vectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((30, 6))
    rows = [(i, (base[i % 30] + r.standard_normal(6) * (0.02 if i % 2 else 0.3)).tolist(), i % 3) for i in range(240)]
    rows += [(500, rows[0][1], 0), (501, [2 * x for x in rows[0][1]], 0), (501, rows[0][1], 0), (502, None, 0), (503, [0.0] * 6, 0), (504, [float("nan")] + [1.0] * 5, 0), (505, rows[0][1], None), (506, [None] + [1.0] * 5, 0), (507, [1.0], 0), (None, rows[0][1], 0), (508, [], 0)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "vec_id long, embedding array<double>, label int, kept int")
    good = [k for k, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    links = [(a, b) for a in good for b in good if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    root = components(range(len(rows)), links)
    least: dict = {}
    for k, c in root.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    want = sorted(((rows[k][0], sum(a == k for a, _ in links), least.get(root[k])) for k in range(len(rows))), key=str)
    got = embeddings.near_duplicate_vectors(df, leaf=16).collect()
    assert sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in got), key=str) == want
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got if x["vec_id"] is not None)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_distant_intervals_are_skipped(spark):
    """Vectors with three strong directions: most pairs of leaves are skipped, and no link is lost."""
    r = np.random.default_rng(5)
    x = np.hstack([r.standard_normal((1500, 3)), 0.05 * r.standard_normal((1500, 29))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    eps = np.sqrt(2 - 2 * 0.98)
    placed = embeddings._sequence(embeddings._units(df), eps, 16)
    near = embeddings.near_leaves(placed, eps)
    leaves = placed.select("leaf").distinct().count()
    assert leaves == -(-1500 // 16) and near.count() < 0.5 * leaves * (leaves + 1) / 2
    links = (x @ x.T >= 0.98).sum(1) - 1
    got = {v["vec_id"]: v["n_links"] for v in embeddings.near_duplicate_vectors(df, 0.98, 16).collect()}
    assert [got[i] for i in range(1500)] == links.tolist()


def test_shards(spark):
    docs = documents(spark, TEXTS + [(100 + i, f"text {i % 7} " * (i % 50)) for i in range(400)] + [(None, "same")] * 3)
    rows = sharding.histogram_shards(docs).collect()
    assert len(rows) == len(TEXTS) + 403 and all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert sharding.histogram_shards(docs.limit(0)).count() == 0
    out = sharding.op3_histogram_shards(spark, "/root/testdata/sf0.01").toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= out["size"].max() and out.law.eq("bytes").all()
    text = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    assert all(zlib.crc32(text[i].encode()) == c for i, c in zip(out.doc_id, out.text_crc32, strict=True))


def test_shards_are_cuts_of_the_sorted_rows(spark):
    """Against a plain sort: shards and slots are places in it, and each cut lies as near to its share of the bytes as the tolerance says."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for shards in (3, 8):
        rows = sharding.histogram_shards(table, shards).withColumn("key", sharding._unsigned_key(table["text"], table["doc_id"])).collect()
        plain = sorted(rows, key=lambda r: (r["key"], r["doc_id"], r["size"]))
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))] == [r["doc_id"] for r in plain]
        total, below = sum(r["size"] for r in plain), 0
        for a, b in zip(plain, plain[1:]):
            below += a["size"]
            if a["shard"] != b["shard"]:
                assert b["slot"] == 0 and abs(below - total * b["shard"] / shards) <= sharding.TOLERANCE * total / shards + max(a["size"], b["size"]) / 2
        assert plain[0]["shard"] == 0 and plain[-1]["shard"] == shards - 1


def test_shards_are_cut_inside_repeated_rows(spark):
    """Rows that repeat doc_id and text, null ones too, hold most of the table: each shard has its share, to the tolerance and half a row."""
    r = random.Random(2)
    tables = [
        [(7, "r" * 99)] * 800 + [(i, "x" * r.randint(0, 150)) for i in range(1000, 1200)],
        [(None, None)] * 500 + [(None, "same")] * 500 + [(i, "same") for i in range(300)],
        [(1, "only")] * 1001,
        [(1, "a")] * 3,
    ]
    for rows in tables:
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).withColumn("extra", F.monotonically_increasing_id()).withColumn("shard", F.lit("x"))
        got = sharding.histogram_shards(table).collect()
        assert sorted(((x["doc_id"], x["text"]) for x in got), key=repr) == sorted(rows, key=repr) and len({x["extra"] for x in got}) == len(rows)
        total, below, by = sum(x["size"] for x in got), 0, {}
        for x in got:
            by.setdefault(x["shard"], []).append(x)
        for shard in range(8):
            own = by.get(shard, [])
            assert sorted(x["slot"] for x in own) == list(range(len(own)))
            below += sum(x["size"] for x in own)
            assert abs(below - total * (shard + 1) / 8) <= sharding.TOLERANCE * total / 8 + max(x["size"] for x in got) / 2
    # the plain order: shards and slots are places in the sort by key
    rows = tables[0]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.histogram_shards(table).withColumn("key", sharding._unsigned_key(table["text"], table["doc_id"])).collect()
    placed = [x["key"] for x in sorted(got, key=lambda x: (x["shard"], x["slot"]))]
    assert placed == sorted(placed)


def test_counts_at_the_driver_dont_grow(spark):
    """At first at most 16 cells for each piece, then 2**STEP for each open border, on a table in which one text is everywhere."""
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.col("id").alias("doc_id"))
    keyed = rows.select(sharding._unsigned_key(F.col("text"), F.col("doc_id")).alias("key"), F.lit(5).cast("long").alias("size"))
    seen = []
    probes = sharding._probes
    sharding._probes = lambda counts, below: seen.append((len(counts), len(below))) or probes(counts, below)
    try:
        cuts = sharding.find_cuts(keyed, 16, lambda i: 0.001 * 2 if i % 2 == 0 else 0.5)
    finally:
        sharding._probes = probes
    assert all(n <= (16 * 64 if at == 0 else open_ << sharding.STEP) for at, (n, open_) in enumerate(seen))
    assert all(abs(c.rows - 20000 * (i + 1) / 16) <= (3 if i % 2 else 0.5 * 20000 / 16) for i, c in enumerate(cuts))


def test_pipeline(spark):
    """run() against plain versions of its stages; the network's verdicts are taken as they are."""
    import hashlib
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    from marlstone.llm import decontaminate, langid, line_dedup
    from tests.llm.test_whole import whole

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.identify(table, langid.train(table)).collect()
    docs = sorted((r["doc_id"], r["text"]) for r in found if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE)
    lines = whole(docs, False, 2, *line_dedup.LINE)
    docs = [(i, t) for i, t in docs if not lines[i, t][1] or lines[i, t][2]]
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, table.filter(table["doc_id"].isin([i for i, _ in docs])), DATA).collect()}
    assert all(re.split(r"\s*\n\s*", kept[i].strip()) == lines[i, t][2] for i, t in docs)
    docs = [(i, kept[i]) for i, _ in docs]
    docs = [d for d, c in zip(docs, [dict((x[0], x[2]) for x in brute_classes(docs))[i] for i, _ in docs], strict=True) if c == d[0]]
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def leaks(text):
        w = re.findall(r"[^\W_]+", text.lower())
        for x in items:
            seeds = [(i, j) for i in range(len(w) - 4) for j in range(len(x) - 4) if w[i : i + 5] == x[j : j + 5]]
            d, t = (np.array([s[k] for s in seeds], np.int64) for k in (0, 1))
            if sum(n for _, _, n in decontaminate.tiles(d, t, 5)) >= decontaminate.COVERAGE * len(x):
                return True
        return False

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in docs:
        if not leaks(t):
            ids = tok.encode(t, add_special_tokens=False).ids
            want[i] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = documents(spark)
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, DATA)
        assert name == "bpe" or out.columns == docs.columns
        assert out.count() <= rows.count()


def test_stars_connect_what_links_connect():
    r = random.Random(4)
    for n, most in ((1, 0), (2, 3), (40, 12), (40, 40), (40, 200)):
        for _ in range(30):
            links = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, most))]
            least = list(range(n))
            for _ in range(n):
                for a, b in links:
                    least[a] = least[b] = min(least[a], least[b])
            i, j = np.array(links, np.int64).reshape(-1, 2).T
            members, centres = embeddings.stars(i, j, n)
            assert dict(zip(members.tolist(), centres.tolist(), strict=True)) == {x: c for x, c in enumerate(least) if x != c}
    path = np.arange(2000)
    assert embeddings.stars(path[:-1], path[1:], 2000)[1].tolist() == [0] * 1999
