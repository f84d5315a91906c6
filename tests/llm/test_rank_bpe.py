"""BPE by a rank file, against the library over whole texts and a plain merge of the pattern's matches."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken

from marlstone.llm import rank_bpe, registry
from tests.compare import DATA
from tests.llm.odd import TEXTS, documents

RANKS = P.path("byte_bpe_50k.tiktoken")


def library(spark):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_bpe.read_ranks(spark, RANKS), special_tokens={})


def test_query_is_the_librarys(spark):
    known = library(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = registry.QUERIES["op12_rank_bpe"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = known.encode_ordinary(texts[r["doc_id"]])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(known.decode_bytes(ids)).hexdigest())


def test_odd_rows(spark):
    known = library(spark)
    out = rank_bpe.rank_round_trip(documents(spark), RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "lang_pred", "n_lines", "leaks", "component_id", "n_entities", "ids", "decoded"]
    got = sorted(((r["doc_id"], r["text"], r["ids"], bytes(r["decoded"])) for r in out.collect()), key=repr)
    assert got == sorted(((i, t, known.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS), key=repr)
    assert rank_bpe.rank_round_trip(documents(spark).limit(0), RANKS, P.PATTERN, packed=True).count() == 0
    assert rank_bpe.read_ranks(spark, f"file://{RANKS}") == rank_bpe.read_ranks(spark, RANKS)


def test_parts_of_long_texts(spark, monkeypatch):
    """Cut at every safe place, a text of any characters has the tokens of the whole."""
    known, r = library(spark), random.Random(4)
    coder = rank_bpe.RankCoder(rank_bpe.read_ranks(spark, RANKS), P.PATTERN)
    monkeypatch.setattr(rank_bpe, "BLANK", 3)
    monkeypatch.setattr(rank_bpe, "BLANKS", regex.compile(r"\p{White_Space}{3,}"))
    letters = "aZ1é٣日。、'’sr.-=  \n\t\r 　́՘\U0001f642\U00020000"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 60)))
        parts = list(coder.parts(text, r.randint(1, 9)))
        assert "".join(p for p, _ in parts) == text
        ids = [i for p, one in parts for i in (coder.whole if one else coder.words).encode_ordinary(p)]
        assert ids == known.encode_ordinary(text), text
    every = "".join(chr(c) + r.choice(" .a1'") for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    assert coder.encode(every).tolist() == known.encode_ordinary(every)


def test_very_long_words(spark):
    """White space on which the library's pattern gives up, and words without any place to cut."""
    coder = rank_bpe.RankCoder(rank_bpe.read_ranks(spark, RANKS), P.PATTERN)
    blank, word = "\n" * 1_000_000, "ab" * 500_000
    for text, pieces in ((blank + "x", [blank[:-1], "\n", "x"]), ("x" + blank, ["x", blank]), ("x y" + blank + " y", ["x", " y", blank, " y"]), (word, [word])):
        ids = coder.encode(text)
        assert coder.decode(ids) == text.encode()
        assert ids.tolist() == [i for p in pieces for i in coder.whole.encode_ordinary(p)]
