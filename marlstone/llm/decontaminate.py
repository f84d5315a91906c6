"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, marks and digits of any script in lower case; a character of a script that is written without spaces is a word.
Running Karp-Rabin hashes of all windows of TILE words give the seeds that a document and a benchmark item share; seeds on one diagonal
are a match. The longest match of unmarked words is marked again and again (ties: first in the item, then in the document) until
none of TILE words is left. The marked share of an item's words is its coverage, whatever the order of the tiles in the document.
An item of fewer words is one window.

The benchmark is broadcast in blocks of at most about BLOCK words (an item is never parted), so what is broadcast never grows with it. Of
several blocks each is a pass over the documents that writes the few that leak. Documents are never shuffled if there is one block.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.shared import documents, materialize, tidy
from marlstone.llm.shingles import PUNCTUATION, buffers, runs, slices, words

TILE, COVERAGE, BLOCK = 5, 0.6, 1_000_000
#: Bytes that count as a word where blocks are measured, and pairs of windows that are held at once.
WORD_BYTES, HELD = 6, 1 << 20
_BITS = 20
#: Scripts that are written without spaces.
DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("covered", T.IntegerType()), T.StructField("words", T.IntegerType())]))


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, and 0 if it parts words, 1 if it belongs to one, 2 if it is one."""
    every = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    every[0xD800:0xE000] = 0
    text = every.tobytes().decode("utf-32-le")
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in text], np.uint32)
    kind = np.zeros(len(every), np.uint8)
    of = lambda pattern: np.frombuffer("".join(regex.findall(pattern, text)).encode("utf-32-le"), np.uint32)
    kind[of(r"[\p{L}\p{M}\p{N}]")] = 1
    kind[of(DENSE)] *= 2
    kind[0xD800:0xE000] = 0
    return lower, kind


def folded(text: bytes) -> bytes:
    """A text in lower case with its words parted by spaces. ASCII texts are left to the hashing of words, which does the same."""
    if text.isascii():
        return text
    lower, kind = _characters()
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    k = kind[c]
    c = np.where(k > 0, lower[c], 32).astype(np.uint32)
    # a character that is a word has a space on either side
    size = np.where(k == 2, 3, 1)
    out = np.full(int(size.sum()), 32, np.uint32)
    out[np.cumsum(size) - size + (k == 2)] = c
    return out.tobytes().decode("utf-32-le").encode()


def folded_rows(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the rows between offsets."""
    if not len(data) or data.max() < 128:
        return at, data
    rows = [folded(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.frombuffer(b"".join(rows), np.uint8)


def tile_runs(d: np.ndarray, t: np.ndarray, n: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """(item place, document place, length) of greedy tiles, from the matches' places in the document and the item and their lengths in words."""
    out = []
    while True:
        long = n >= tile
        d, t, n = d[long], t[long], n[long]
        if not len(d):
            return out
        best = np.flatnonzero(n == n.max())
        best = best[t[best] == t[best].min()]
        best = best[np.argmin(d[best])]
        a, b, m = int(t[best]), int(d[best]), int(n[best])
        out.append((a, b, m))
        for item in (True, False):  # what a match has on either side of the words that are marked now
            at, mark = (t, a) if item else (d, b)
            left, right = np.clip(mark - at, 0, n), np.clip(at + n - mark - m, 0, n)
            d, t, n = np.concatenate([d, d + n - right]), np.concatenate([t, t + n - right]), np.concatenate([left, right])
            d, t, n = d[n >= tile], t[n >= tile], n[n >= tile]


def tiles(doc_at: np.ndarray, item_at: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """The same from seeds, the places of windows of ``tile`` words that agree."""
    order = np.lexsort((item_at, doc_at - item_at))
    d, t = doc_at[order], item_at[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] - t[1:] != d[:-1] - t[:-1]) | (t[1:] != t[:-1] + 1)
    first = np.flatnonzero(new)
    return tile_runs(d[first], t[first], np.diff(np.append(first, len(d))) + tile - 1, tile)


class _Windows:
    """The windows of k words of many texts: the hash at each word's place, its text, and whether there is a window. One place more stands for none."""

    def __init__(self, h: np.ndarray, row: np.ndarray, k: int, own: np.ndarray | None = None):
        seed, i = runs(h, row, k)
        if own is not None:
            seed, i = seed[own[row[i]]], i[own[row[i]]]
        self.at, self.row = i, np.append(row, -1)
        self.seed, self.there = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, bool)
        self.seed[i], self.there[i] = seed, True

    def beside(self, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the same text has a window a step further, and its hash."""
        to = at + step
        return self.there[to] & (self.row[to] == self.row[at]), self.seed[to]


class _Block:
    """A part of the benchmark: for each length of windows its seeds in order, with their places, and a table of bits that most windows fail."""

    def __init__(self, rows: list, tile: int):
        self.ids = [r["item_id"] for r in rows]
        h, _, row = words(*folded_rows(*buffers(pa.array([r["text"] for r in rows], pa.string()))), PUNCTUATION)
        self.sizes = np.bincount(row, minlength=len(rows))
        self.seeds = {}
        for k in sorted({min(tile, n) for n in self.sizes.tolist() if n}):
            own = _Windows(h, row, k, self.sizes == k if k < tile else self.sizes >= k)
            seed = own.seed[own.at]
            order = np.argsort(seed, kind="stable")
            maybe = np.zeros(1 << _BITS, bool)
            maybe[seed >> np.uint64(64 - _BITS)] = True
            self.seeds[k] = seed[order], own.at[order], own, maybe

    def matches(self, h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(row, item, place in the words, place in the items' words, length) of all matches of k words or more, in order of row and item.

        Two windows that agree are followed from where their diagonal begins to agree to where it ends; pairs of windows are met HELD at a time and only
        those two are kept, so a text and an item that repeat one word need what their lengths' sum is, not its product.
        """
        seeds, places, items, maybe = self.seeds[k]
        texts = _Windows(h, row, k)
        seed = texts.seed[texts.at]
        hit = texts.at[maybe[seed >> np.uint64(64 - _BITS)]]
        low, high = np.searchsorted(seeds, texts.seed[hit]), np.searchsorted(seeds, texts.seed[hit], "right")
        hit, low, count = hit[high > low], low[high > low], (high - low)[high > low]
        upto = np.cumsum(count)
        ends: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        first = 0
        while first < len(hit):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] - count[first] + HELD, "right")))
            n = count[first:last]
            w = np.repeat(hit[first:last], n)
            f = places[np.repeat(low[first:last], n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)]
            for kept, step in zip(ends, (-1, 1), strict=True):
                (a, x), (b, y) = texts.beside(w, step), items.beside(f, step)
                stop = ~(a & b & (x == y))
                kept.append((w[stop], f[stop]))
            first = last
        if not len(hit):
            return (np.zeros(0, np.int64),) * 5
        (w, f), (v, g) = ([np.concatenate([p[c] for p in kept]) for c in (0, 1)] for kept in ends)
        order, other = np.lexsort((w, w - f, items.row[f], texts.row[w])), np.lexsort((v, v - g, items.row[g], texts.row[v]))
        w, f, v = w[order], f[order], v[other]
        return texts.row[w], items.row[f], w, f, v - w + k

    def leaks(self, h: np.ndarray, row: np.ndarray, coverage: float) -> Iterator[tuple[int, dict]]:
        """(row, leak) of the texts whose words have such hashes."""
        for k in self.seeds:
            r, item, w, f, n = self.matches(h, row, k)
            if not len(r):
                continue
            start = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (item[1:] != item[:-1])]))
            stop = np.append(start[1:], len(r))
            enough = np.add.reduceat(n, start) >= coverage * self.sizes[item[start]]  # as much as matches can cover
            for a, b in zip(start[enough].tolist(), stop[enough].tolist(), strict=True):
                covered, size = sum(x for _, _, x in tile_runs(w[a:b], f[a:b], n[a:b], k)), int(self.sizes[item[a]])
                if covered >= coverage * size:
                    yield int(r[a]), {"item_id": self.ids[int(item[a])], "covered": covered, "words": size}


def _with_leaks(docs: DataFrame, items: DataFrame, tile: int, coverage: float) -> DataFrame:
    """docs(..., _read) with leaks in place of _read, the text, for the items of one block."""
    rows = sorted(items.collect(), key=lambda r: (r["item_id"] is not None, r["item_id"], r["text"]))
    shared = docs.sparkSession.sparkContext.broadcast(_Block(rows, tile))
    where = docs.columns.index("_read")
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "_read"), T.StructField("leaks", LEAKS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int32()), ("words", pa.int32())]))
        for b in batches:
            for first, last, at, data in slices(b.column(where)):
                h, _, row = words(*folded_rows(at, data), PUNCTUATION)
                leaks: list[list] = [[] for _ in range(last - first)]
                for r, leak in shared.value.leaks(h, row, coverage):
                    leaks[r].append(leak)
                part = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != where), pa.array(leaks, kind)], names=schema.names)

    return docs.mapInArrow(tidy(work), schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """docs with ``leaks``: array<struct(item_id, covered, words)> of the benchmark items whose covered words are at least ``coverage`` of theirs.

    All rows and columns stay; a column named leaks is replaced, columns named _read, _leak_id or _leak_h are lost. Null and empty texts have no
    leaks; null items and items without words leak nowhere; an item of fewer than ``tile`` words leaks where it stands whole. Items with equal
    texts or ids are listed one by one. Letters are compared as they are encoded, without Unicode normalization. Repeated rows are
    alike; an empty benchmark gives empty arrays, no documents no rows. Texts of any length are read whole.
    """
    docs = docs.drop("leaks", "_read", "_leak_id", "_leak_h")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    n_blocks = 1 + int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (block * WORD_BYTES)
    wide = docs.withColumn("_read", F.col("text"))
    if n_blocks == 1:
        return _with_leaks(wide, items, tile, coverage)
    h = F.xxhash64("text")
    narrow = docs.select(F.col("doc_id").alias("_leak_id"), h.alias("_leak_h"), F.col("text").alias("_read"))
    found = None
    for k in range(n_blocks):
        own = _with_leaks(narrow, items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k), tile, coverage)
        own = materialize(own.filter(F.size("leaks") > 0).dropDuplicates(["_leak_id", "_leak_h"]), "leaks")
        found = own if found is None else found.unionByName(own)
    found = found.groupBy("_leak_id", "_leak_h").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_leak_id")) & (h == F.col("_leak_h")), "left")
    return joined.withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS))).drop("_leak_id", "_leak_h")


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), F.array_sort(F.col("leaks.item_id")).alias("item_ids"), F.array_max(F.transform("leaks", lambda x: x["covered"] / x["words"])).alias("coverage"))
