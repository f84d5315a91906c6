"""Operators that rewrite or describe single texts, on odd rows, empty tables and against plain versions."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from marlstone.llm import bpe, chat, decontaminate, langid, line_dedup, pii, substring_dedup
from tests.llm.odd import PASSAGE, TEXTS, cut, documents, segments

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def test_bpe_is_the_librarys(spark, docs):
    t = Tokenizer.from_file(PATH)
    r = random.Random(5)
    letters = "etaoin shrdlu  \n\t'sdm.,!<|>Éüßñ日本語हिन्दी0123456789 　\x1c\x85🙂"
    texts = [x for _, x in TEXTS if x] + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(500)] + ["ab" * 4000, "x" * 9000, "<|endoftext|>a<|endoftext|>"]
    e = bpe.Encoder(bpe.load(PATH))
    for text, ids in zip(texts, e.encode(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and e.bpe.decode(want) == t.decode(want, skip_special_tokens=False) == text
    rows = bpe.bpe_round_trip(docs, PATH).collect()
    assert len(rows) == len(TEXTS) and all(x["decoded"] == (x["text"] or "") for x in rows)
    assert bpe.bpe_round_trip(docs.limit(0), PATH).count() == 0
    one = bpe.encoded_digests(docs.filter("doc_id = 4"), PATH).first()
    assert (one["n_tokens"], one["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())


def test_pair_check_agrees_with_merging():
    b = bpe.load(PATH)
    ids = np.random.default_rng(1).choice(b.token_at[b.token_at >= 0], (3000, 2))
    ok = b.compatible(ids[:, 0], ids[:, 1])
    assert [b.exact(b.bytes_of(x) + b.bytes_of(y)) == [x, y] for x, y in ids.tolist()] == ok.tolist()


@pytest.mark.parametrize(("op", "sentences", "spans", "names"), [(line_dedup.dedup_lines, False, {3: 0}, ("n_lines", "n_removed_lines")), (lambda docs: substring_dedup.dedup_substrings(docs, (0, 0), (50, 300)), True, {2: 0, 1: 50}, ("n_sentences", "n_removed_sentences"))])
def test_runs_and_spans(spark, docs, op, sentences, spans, names):
    order = sorted(TEXTS, key=lambda x: (x[0] is None, x[0]))
    want = cut(order, sentences, spans)
    got = op(docs.withColumn("t", docs["text"])).select("doc_id", "t", "text", *names).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        total, gone, kept = want[r["doc_id"], r["t"]]
        assert (r[names[0]], r[names[1]], segments(r["text"], sentences)) == (total, gone, kept), r["doc_id"]
        assert r["text"] == r["t"] if not gone else True
    assert op(docs.limit(0)).count() == 0


def test_winnowing_chooses_a_line_of_every_window():
    r = np.random.default_rng(2)
    h, row = r.integers(0, 9, 400).astype(np.uint64), np.sort(r.integers(0, 30, 400))
    chosen = set(line_dedup.winnow(h, row, 4).tolist())
    assert all(chosen & set(range(i, i + 4)) for i in range(397) if row[i] == row[i + 3])


def test_tiling(spark, docs):
    bm = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short"), (4, " ".join(f"w{i}" for i in range(30))), (None, PASSAGE)], "item_id long, text string")
    words = PASSAGE.split()
    moved = " ".join(words[20:] + ["zzz"] + words[:20])
    half = " ".join(words[:12]) + " but then something else"
    rows = documents(spark, [*TEXTS, (30, moved), (31, half), (32, PASSAGE.upper())])
    got = {r["doc_id"]: sorted(str(x["item_id"]) for x in r["leaks"]) for r in decontaminate.find_leaks(rows, bm).collect()}
    assert {k for k, v in got.items() if v} == {14, 15, 30, 32} and got[30] == ["1", "None"]  # item 3 of two words stands nowhere
    blocks = {r["doc_id"]: sorted(str(x["item_id"]) for x in r["leaks"]) for r in decontaminate.find_leaks(rows, bm, block=20).collect()}
    assert blocks == got
    assert decontaminate.find_leaks(rows.limit(0), bm).count() == 0
    assert decontaminate.find_leaks(rows, bm.limit(0)).filter("size(leaks) > 0").count() == 0


def test_tiling_in_any_script(spark):
    """Case of any letters, quotation marks of any kind, scripts without spaces, and items of few words."""
    bm = [(1, "École était fermée à Noël par décision du préfet"), (2, "今天天气很好我们一起去公园散步然后回家吃饭"), (3, "Short item here"), (4, "Привет как дела сегодня утром в Москве"), (5, "。。"), (6, "ภาษาไทยไม่มีช่องว่างระหว่างคำ")]
    docs = [
        (1, "xx “ÉCOLE ÉTAIT FERMÉE À NOËL PAR DÉCISION DU PRÉFET” yy"), (2, "前面的话" + bm[1][1] + "后面的话"), (3, "a short ITEM, here!"), (4, "«ПРИВЕТ, КАК ДЕЛА СЕГОДНЯ УТРОМ В МОСКВЕ?»"), (5, "short items here 。。 今天"),
        (6, "我们一起去公园散步。今天天气很好。"), (7, None), (8, ""), (9, "x" + bm[5][1]), (10, "école 今天 привет"),
    ]
    docs, bm = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bm, "item_id long, text string")
    for block in (1000, 10):
        got = {r["doc_id"]: sorted(x["item_id"] for x in r["leaks"]) for r in decontaminate.find_leaks(docs, bm, block=block).collect()}
        assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [], 6: [2], 7: [], 8: [], 9: [6], 10: []}


def test_tiles_are_greedy():
    """Against marking the longest common unmarked run again and again, over words themselves."""
    r = random.Random(4)
    for _ in range(60):
        doc, item = [r.randint(0, 3) for _ in range(40)], [r.randint(0, 3) for _ in range(15)]
        k, used_d, used_i, want = 3, set(), set(), []
        while True:
            best = None
            for j in range(len(item)):
                for i in range(len(doc)):
                    n = 0
                    while j + n < len(item) and i + n < len(doc) and item[j + n] == doc[i + n] and j + n not in used_i and i + n not in used_d:
                        n += 1
                    if n >= k and (best is None or (-n, j, i) < best):
                        best = (-n, j, i)
            if best is None:
                break
            n, j, i = -best[0], best[1], best[2]
            want.append((j, i, n))
            used_d.update(range(i, i + n))
            used_i.update(range(j, j + n))
        seeds = [(i, j) for i in range(len(doc) - k + 1) for j in range(len(item) - k + 1) if doc[i : i + k] == item[j : j + k]]
        d, t = (np.array([s[x] for s in seeds], np.int64) for x in (0, 1))
        assert decontaminate.tiles(d, t, k) == want


def plain_leaks(text, items, tile=5, coverage=0.6):
    """Words by a plain search, all seeds, tiles over them: {item_id: (covered, words)}."""

    def split(t):
        t = "".join(x if len(x := c.lower()) == 1 else c for c in t or "")
        word = r"[\p{L}\p{M}\p{N}]"
        return regex.findall(rf"(?V1)[{decontaminate.DENSE}&&{word}]|[{word}--{decontaminate.DENSE}]+", t)

    doc, out = split(text), {}
    for i, t in items:
        item = split(t)
        k = min(tile, len(item))
        seeds = [(a, b) for a in range(len(doc) - k + 1) for b in range(len(item) - k + 1) if k and doc[a : a + k] == item[b : b + k]]
        covered = sum(n for _, _, n in decontaminate.tiles(*(np.array([s[x] for s in seeds], np.int64) for x in (0, 1)), k)) if seeds else 0
        if item and covered >= coverage * len(item):
            out[i] = covered, len(item)
    return out


def test_leaks_are_the_plain_ones(spark, monkeypatch):
    """Seeds, coverage and blocks against a search of all windows, with repetitive texts, few words, several scripts and chunks of every size."""
    r = random.Random(9)
    for held, block in ((1 << 20, 10**6), (3, 10**6), (50, 30)):
        monkeypatch.setattr(decontaminate, "HELD", held)
        pick = lambda n: " ".join(r.choice(["a", "b", "É", "ж", "日", "x1"]) for _ in range(n))
        items = [(i, pick(r.randint(0, 25))) for i in range(25)] + [(90, "a " * 12), (91, None), (92, "日本語")]
        texts = [(i, pick(r.randint(0, 20)) + ". " + " ".join((items[r.randrange(25)][1] or "").split()[2:]).upper() + "," + pick(r.randint(0, 9))) for i in range(40)] + [(50, "a, " * 60), (51, None), (52, "（日本語）")]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        bm = spark.createDataFrame(items, "item_id long, text string")
        got = {x["doc_id"]: {y["item_id"]: (y["covered"], y["words"]) for y in x["leaks"]} for x in decontaminate.find_leaks(docs, bm, block=block).collect()}
        assert got == {i: plain_leaks(t, items) for i, t in texts}
        assert sum(map(len, got.values())) > 20


def test_repetitive_texts_are_cheap():
    """A megabyte of one word, and of two in turn, against items that repeat them: matches are as many as the lengths' sum, not its product."""
    rows = [{"item_id": 1, "text": "ab " * 300}, {"item_id": 2, "text": "ab cd " * 300}]
    block = decontaminate._Block(rows, 5)
    for text, want in (("ab " * 350_000, {1: 300}), ("ab cd " * 170_000, {2: 600})):
        h, _, row = decontaminate.words(*decontaminate.buffers(decontaminate.pa.array([text])), decontaminate.PUNCTUATION)
        began = time.perf_counter()
        assert {x["item_id"]: x["covered"] for _, x in block.leaks(h, row, 0.6)} == want
        assert time.perf_counter() - began < 60 and len(block.matches(h, row, 5)[0]) < 2 * len(h)


KEY = "a test's key"
CALL = 'Call +1 (743) 555-3824 or 743-555-3824, mail Ann.68@mail2.example.com, IP 227.5.221.1, card 4111 1111 1111 1111 and 4111111111111111, token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", 123-45-6789'


def test_surrogates(spark, docs):
    assert pii.replace_pii(docs, KEY).count() == len(TEXTS)
    assert pii.replace_pii(docs.limit(0), KEY).count() == 0
    rows = spark.createDataFrame([(1, CALL), (2, CALL + " Mrs. Anna Smith and Mr Smith; Г-н Иванов."), (3, "ann.68@MAIL2.example.com 9.9.9.9 v2.0.1"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(rows, KEY).collect()}
    a, b = got[1]["text"], got[2]["text"]
    assert b.startswith(a) and got[4]["text"] is None and got[4]["n_entities"] == 0
    for original in ("743", "Ann.68", "227.5.221.1", "1111 1111", "2321bac4", "123-45-6789", "Smith", "Иванов"):
        assert original not in b
    import re

    x = re.match(r'Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \1-\2-\3, mail [A-Z][a-z]{2}\.\d{2}@[a-z]{4}\d\.[a-z]{7}\.com, IP [\d.]+, card (4\d{3}) (\d{4}) (\d{4}) (\d{4}) and \4\5\6\7, token = "[0-9a-f]{40}", \d{3}-\d{2}-\d{4}', a)
    assert x and sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed("".join(x.groups()[3:])))) % 10 == 0
    names = re.search(r"Mrs\. (\w+ina) (\w+) and Mr \2; Г-н ([а-я]+)\.", b, re.I)
    assert names and got[3]["text"].split()[0].lower() in b.lower() and got[3]["text"].endswith(" v2.0.1")


def test_chat(spark):
    texts = [("system", "be <|im_end|> good\\"), ("user", None), ("assistant", "a" * 9000), ("user", "é" * 50), ("assistant", "<|im_start|>user\nhi"), ("assistant", ""), ("tool\nx", "t"), ("assistant", "日本" * 2000)]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(texts)] + [(2, None, None, "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (None, 0, "user", "z"), *((3, i, "user" if i % 2 else "assistant", "word " * 300) for i in range(40))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(df)).collect()}
    for conv in (1, 2, None, 3):
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = chat.format_windows(df).filter("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 1 and all(w["formatted"].startswith("<|im_start|>system") for w in windows)
    assert chat.format_windows(df.limit(0)).count() == 0


def test_network_gradients():
    net, r = langid.BiGru(3, 4), np.random.default_rng(0)
    b, y, m = r.integers(0, 256, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones((5, 7), bool)
    m[0, 5:] = False

    def loss():
        p = net.positions(b)
        return -sum(np.log(p[y[n], t, n]) for n in range(5) for t in range(7) if m[n, t]) / m.sum()

    for k, g in net.gradients(b, y, m).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was = net.p[k][at]
        net.p[k][at] = was + 1e-2
        up = loss()
        net.p[k][at] = was - 1e-2
        assert abs((up - loss()) / 2e-2 - g[at]) < 2e-3
        net.p[k][at] = was


def test_language(spark, docs):
    odd = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert odd[3]["lang_pred"] == odd[4]["lang_pred"] == odd[18]["lang_pred"] == "und" and odd[1]["lang_pred"] == "en" and odd[18]["score"] == 0
    assert langid.identify(docs.limit(0), (["en"], langid.BiGru(1))).count() == 0
    assert langid.train(docs.limit(0)) == ([], None) and langid.identify(docs, ([], None)).filter("lang_pred <> 'und'").count() == 0
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op6_language_id(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_scores_are_the_plain_network(spark):
    """identify() against the network written out for one byte at a time."""
    texts = ["the cat sat on the mat and " * 9, "der Hund und die Katze sind da", "chat é noir", "12 34", "", None, "a"]
    net = langid.BiGru(3, seed=4)
    langs = ["de", "en", "fr"]
    squash = lambda v: v / (1 + abs(v))

    def one_way(b, d):
        s, out = np.zeros(net.h), []
        for c in b:
            x = net.p["x"][d][c].astype(float)
            gates = 0.5 + 0.5 * squash(s @ net.p["zr"][d] + x[: 2 * net.h])
            z, r = gates[: net.h], gates[net.h :]
            new = squash(r * (s @ net.p["n"][d]) + x[2 * net.h :])
            s = z * s + (1 - z) * new
            out.append(s)
        return out

    def score(text):
        raw, total, n = text.encode(), np.zeros(3), 0
        for a in range(0, len(raw), langid.SEGMENT):
            own = raw[a : a + langid.SEGMENT]
            b = own + bytes(langid.SEGMENT - len(own))
            there, back = one_way(b, 0), one_way(b[::-1], 1)[::-1]
            for k in range(len(own)):
                e = np.exp(np.concatenate([there[k], back[k]]) @ net.p["o"] + net.p["c"])
                total, n = total + e / e.sum(), n + 1
        return total / n

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(rows, (langs, net)).collect():
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            want = score(r["text"])
            assert r["lang_pred"] == langs[int(want.argmax())] and abs(r["score"] - want.max()) < 1e-4
