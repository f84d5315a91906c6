"""Spelling variants against all pairs of a small vocabulary, and the words themselves against a plain count."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from marlstone.llm import registry, spelling
from tests.compare import DATA
from tests.llm.odd import documents


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, least=3, factor=2):
    known = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in known if is_near(w, v)] for w in known}
    best = {w: min(vs, key=lambda v: (-known[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if known[v] >= factor * known[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), known[form[w]] if w in form else -1) for w, n in known.items())


def found(spark, counts, **k):
    rows = spelling.spelling_variants(spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string"), **k).collect()
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in rows)


def test_small_alphabets(spark):
    """Words with many runs of equal letters, ties of n, chains of forms, and letters of two bytes."""
    r = random.Random(5)
    counts = {"".join(r.choice("abé") for _ in range(r.randint(1, 7))): r.choice([1, 2, 3, 3, 4, 6, 7, 12, 25, 50, 100]) for _ in range(700)}
    assert found(spark, counts) == plain(counts)
    assert found(spark, counts, least=1, factor=3) == plain(counts, 1, 3)


def test_long_words(spark):
    """Lengths around the bound from which rotations are hashed, and a word of 200,000 letters."""
    r = random.Random(6)
    counts = {}
    for size in (62, 63, 64, 65, 66, 130):
        base = "".join(r.choice("ab") for _ in range(size))
        for _ in range(6):
            p = r.randrange(size)
            counts |= {base: 40, base[:p] + "c" + base[p + 1 :]: r.randint(3, 30), base[:p] + base[p + 1 :]: r.randint(3, 30), base[:p] + "b" + base[p:]: r.randint(3, 30)}
    assert found(spark, counts) == plain(counts)
    huge = "ab" * 100_000
    got = found(spark, {huge: 9, huge + "b": 3, "b" + huge[1:]: 4, "odd": 3})
    assert [(len(w), len(f), n, near) for w, f, _, n, near, _ in got] == [(200_000, 0, 9, 2), (200_001, 200_000, 3, 1), (200_000, 200_000, 4, 1), (3, 0, 3, 0)]


def test_batches_of_the_scan():
    """Groups that begin and end anywhere in the batches."""
    import pyarrow as pa

    r = random.Random(7)
    rows = sorted((f"k{r.randint(0, 60):02d}", rank, r.choice([0, 1, 2])) for rank in range(300))
    rows = [x for i, x in enumerate(rows) if x[2] or not any(y[0] == x[0] and y[2] == 0 for y in rows[:i])]  # one whole rotation a group at most
    table = pa.Table.from_pydict({"key": [k for k, _, _ in rows], "rank": [n for _, n, _ in rows], "kind": pa.array([x for _, _, x in rows], pa.int8())})
    want = sorted(t for b in spelling._scanned(iter(table.to_batches())) for t in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for size in (1, 2, 7, 50):
        assert sorted(t for b in spelling._scanned(iter(table.to_batches(max_chunksize=size))) for t in zip(*[c.to_pylist() for c in b.columns], strict=True)) == want
    group = {}
    for k, n, kind in rows:
        group.setdefault(k, []).append((n, kind))
    brute = []
    for members in group.values():
        for n, kind in members:
            others = [m for m, x in members if m != n and (kind and x or (kind == 2 and x == 0) or (kind == 0 and x == 2))]
            brute += [(n, len(others), min(others))] if others else []
    assert want == sorted(brute)


def plain_words(texts, damage):
    out: Counter = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if damage and i is not None and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return out


def test_words(spark, monkeypatch):
    texts = [(1, "Hello HELLO ÀÉÎõü÷× Ünder_score naïve naïve"), (2, None), (3, ""), (None, "Hello wörld wörld"), (1, "Hello HELLO"), (4, "abcde " * 1000 + "x" * 5000)]
    for damage in (None, 2):
        got = {r["word"]: r["n"] for r in spelling.count_words(documents(spark, texts), damage=damage).collect()}
        assert got == plain_words(texts, damage)
    assert spelling.spelling_variants(spelling.count_words(documents(spark, texts).limit(0))).count() == 0
    monkeypatch.setattr(spelling, "PIECE", 3)
    assert "".join(spelling._pieces(texts[0][1])) == texts[0][1]


def test_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = registry.QUERIES["op11_spelling_variants"](spark, DATA).collect()
    assert {r["word"]: r["n"] for r in got} == {w: n for w, n in plain_words(texts, 97).items() if n >= 3}
