"""The manifest against a plain recursion over lists."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from marlstone.llm import merkle, registry
from tests.llm.odd import documents

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan):
    """(root, proof of each node as a list of (before, after)) by the rule itself."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(proofs):
            i = at[k]
            run = nodes[i // fan * fan : i // fan * fan + fan]
            p.append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            at[k] = i // fan
        nodes = [sha(*nodes[a : a + fan]) for a in range(0, len(nodes), fan)]
    return nodes[0], proofs


def plain(rows, fan):
    """rows (doc_id, source, lang, n_chars, text) -> [(doc_id, leaf, subroot, root, proof)]"""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])], fan) for g in keys}
    root, above = climb([trees[g][0] for g in keys], fan)
    return [(i if there else None, h, trees[g][0], root, proof + above[k]) for k, g in enumerate(keys) for (there, i, h), proof in zip(sorted(groups[g]), trees[g][1], strict=True)]


def manifest(docs, fan, digits):
    leaves = docs.select("doc_id", "lang", "source", "n_chars", "text", merkle.leaf_digest(*map(F.col, COLUMNS)).alias("digest"))
    out = merkle.merkle_proofs(leaves, "lang", ["doc_id", "digest"], fan, digits)
    return [(r["doc_id"], r["digest"], r["subroot"], r["root"], [(p["before"], p["after"]) for p in r["proof"]]) for r in out.withColumn("ok", merkle.folded(F.col("digest"), F.col("proof")) == F.col("root")).collect() if r["ok"]]


def test_trees_of_every_shape(spark):
    """Groups from one row to several tiers, runs that end with one node, nulls, repeated rows and ids."""
    r = random.Random(3)
    sizes = {"a": 1, None: 2, "b": 8, "c": 9, "é": 17, "d": 65, "e": 4, "zz": 40}
    rows = [(r.randint(0, 60) if r.random() < 0.9 else None, "s", g, r.randint(0, 3), r.choice(["x", "Ä", None, ""])) for g, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for fan, digits in ((8, 3), (2, 2), (3, 1)):
        assert sorted(manifest(docs, fan, digits), key=repr) == sorted(plain(rows, fan), key=repr)
    one = docs.filter("lang = 'a'")
    assert [x[3:] for x in manifest(one, 8, 3)] == [(leaf(rows[0]), [])]
    assert manifest(docs.limit(0), 8, 3) == []


def test_tampering_shows(spark):
    docs = documents(spark)
    other = F.when(F.col("doc_id") == 8, F.upper("text")).otherwise(F.col("text"))
    out = merkle.merkle_manifest(docs, COLUMNS, other={"text": other})
    assert out.columns == ["doc_id", "lang", "leaf", "other_leaf", "subroot", "root", "proof"]
    got = out.withColumn("same", merkle.folded(F.col("other_leaf"), F.col("proof")) == F.col("root")).collect()
    assert len(got) == docs.count() and {r["doc_id"] for r in got if not r["same"]} == {8}


def test_query_finds_what_is_tampered(spark):
    data = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.QUERIES["op13_merkle_manifest"](spark, data).collect()
    assert len(got) == len(rows) and len({r["root"] for r in got}) == 1
    for r in got:
        t = rows[r["doc_id"]]["text"] or ""
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in t)
        assert r["verified"] != changed
    want = {x[0]: x for x in plain([tuple(r[c] for c in COLUMNS) for r in rows.values()], 8)}
    for r in got:
        i, h, subroot, root, proof = want[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (h, subroot, root, sha("".join(a + b for a, b in proof)))
