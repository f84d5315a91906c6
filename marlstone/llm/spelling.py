"""Grouping of spelling variants by permuterm rotations.

Words are counted over all texts and numbered from the most frequent on (ties: in code-point order), so that of two neighbours the better one has
the smaller number. A word marked with an end sign has a rotation for each place. In the sorted rotations, words that differ by one replaced
letter stand together under the prefix that remains when the letter, turned to the end, is skipped; a word with a letter more stands under the
whole rotation of the word without it. So each rotation makes a row for itself and one for its prefix; all rows are sorted by these, and one scan over the
sorted groups tells each word of a group how many neighbours it has there and which is best. A group has at most a word for each letter
of the alphabet and one more, and no pair is written out. Of a run of equal letters only the first is skipped for a word with a letter less, so a
pair meets once.

Rotations of more than LONG letters are known by a polynomial hash modulo a prime of 127 bits, so that a word of any length costs its length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import documents, materialize, tidy
from marlstone.operators.components import flatten_trees

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is so many times as frequent as the word that it is the form of.
FACTOR = 2
LONG, END = 64, "$"
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"permuterm").digest(), "big") % PRIME
#: Letters of a text that are cut into words at a time, and words and letters that a worker counts before it passes them on.
PIECE, KEPT_WORDS, KEPT_LETTERS = 1 << 20, 200_000, 1 << 25
#: What a row of a word's rotations is: the whole rotation, or its prefix without a letter that follows an equal one, or without another.
WHOLE, AGAIN, FIRST = 0, 1, 2
NONE = (1 << 63) - 1


def _pieces(text: str) -> Iterator[str]:
    """A text in parts that end behind something that is no letter."""
    at, ends = 0, re.compile("[^A-Za-zÀ-ÿ]")
    while len(text) - at > PIECE and (cut := ends.search(text, at + PIECE)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def count_words(docs: DataFrame, length: int = LEAST_LENGTH, damage: int | None = None) -> DataFrame:
    """(word, n) of the maximal runs of Latin letters of docs(doc_id, text), A-Z in lower case, of at least ``length`` letters.

    damage: for tests with planted errors, one in so many runs loses a letter; which, tells the CRC-32 of ``doc_id:run``. A null doc_id damages nothing.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{length},}}")

    def found(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
        counted: Counter = Counter()
        for piece in _pieces(text):
            counted.update(runs.findall(piece.encode().lower().decode()))
        if damage is None or doc_id is None:
            yield from counted.items()
            return
        start = zlib.crc32(f"{doc_id}:".encode())
        for run, n in counted.items():
            h = zlib.crc32(run.encode(), start)
            if h % damage:
                yield run, n
            elif len(run) > length:
                p = h % len(run)
                yield run[:p] + run[p + 1 :], n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        letters = 0
        for b in batches:
            for doc_id, text in zip(*b.columns, strict=True):
                for word, n in found(doc_id.as_py(), text.as_py() or ""):
                    if word not in words:
                        letters += len(word)
                    words[word] = words.get(word, 0) + n
                if len(words) > KEPT_WORDS or letters > KEPT_LETTERS:
                    yield pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())})
                    words, letters = {}, 0
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(tidy(work), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _rows(word: str) -> Iterator[tuple[str, int]]:
    """(key, kind) of the rotations of a word and of their prefixes."""
    size = len(word)
    kinds = [AGAIN if i and word[i] == word[i - 1] else FIRST for i in range(size)]
    if size < LONG:
        yield from ((word[i:] + END + word[:i], WHOLE) for i in range(size + 1))
        yield from ((word[i + 1 :] + END + word[:i], kinds[i]) for i in range(size))
        return
    power, upto = [1], [0]
    for c in word:
        power.append(power[-1] * BASE % PRIME)
        upto.append((upto[-1] * BASE + ord(c)) % PRIME)

    def key(a: int, b: int) -> str:
        """Of word[a:], the end sign and word[:b]."""
        tail = upto[size] - upto[a] * power[size - a]
        count = size - a + 1 + b
        if count <= LONG:
            return word[a:] + END + word[:b]
        return f"{END}{count}:{((tail * BASE + ord(END)) * power[b] + upto[b]) % PRIME:x}"

    yield from ((key(i, i), WHOLE) for i in range(size + 1))
    yield from ((key(i + 1, i), kinds[i]) for i in range(size))


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ranks, pa.int64()), pa.array(kinds, pa.int8())], names=["key", "rank", "kind"])

    keys, ranks, kinds = [], [], []
    for b in batches:
        for rank, word in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for key, kind in _rows(word.as_py()):
                keys.append(key)
                ranks.append(rank)
                kinds.append(kind)
                if len(keys) == 1 << 16:
                    yield flushed()
                    keys, ranks, kinds = [], [], []
    yield flushed()


def _neighbours(new: np.ndarray, rank: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, neighbours, best of them) of the rows of whole groups that have any; new: where a group begins."""
    start = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    prefix, first = kind != WHOLE, kind == FIRST
    least = lambda rows: np.minimum.reduceat(np.where(rows, rank, NONE), start)[of]
    count = lambda rows: np.add.reduceat(rows.astype(np.int64), start)[of]
    best = least(prefix)
    best = np.where(rank == best, least(prefix & (rank != best)), best)
    best = np.where(first, np.minimum(best, least(~prefix)), best)
    near = count(prefix) - 1 + np.where(first, count(~prefix), 0)
    best, near = np.where(prefix, best, least(first)), np.where(prefix, near, count(first))
    some = near > 0
    return rank[some], near[some], best[some]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; the last group of a batch waits for the next one."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        keys = held.column("key").combine_chunks()
        new = np.concatenate([[True], np.asarray(pc.not_equal(keys[1:], keys[:-1]))])
        last = int(np.flatnonzero(new)[-1])
        if last:
            done = held.slice(0, last)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _neighbours(new[:last], done.column("rank").to_numpy(), done.column("kind").to_numpy()))), names=["rank", "n_near", "best"])
        held = held.slice(last)
    if held is not None:
        new = np.arange(held.num_rows) == 0
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _neighbours(new, held.column("rank").to_numpy(), held.column("kind").to_numpy()))), names=["rank", "n_near", "best"])


def spelling_variants(counts: DataFrame, least: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """counts(word, n), one row for each word -> (word, form, root, n, n_near, form_n) of the words with n of at least ``least``.

    Two words are near if one inserted, deleted or replaced code point parts them. form: the near word of largest n (ties: the smallest in
    code-point order) if that n is ``factor`` times the word's own or more, else null; ``factor`` must be over 1, so forms never go in a circle.
    root: where forms lead to, from form to form; the word itself if it has none. Words must not hold the end sign; null and empty words are left out; words of any length cost
    their length. Other columns are ignored; no rows give no rows.
    """
    order = [F.desc("n"), F.asc("word")]
    words = counts.filter(F.col("n") >= least).filter("word <> ''").select("word", "n")
    # numbers ascend through the sorted partitions; they needn't be gapless
    words = materialize(words.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "words")
    rows = words.select("rank", "word").mapInArrow(_rotated, "key string, rank long, kind tinyint")
    scanned = rows.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(tidy(_scanned), "rank long, n_near long, best long")
    near = scanned.groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    other = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    is_form = F.col("form_n") >= factor * F.col("n")
    known = words.join(near, "rank", "left").join(other, "best", "left")
    known = known.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")])
    known = materialize(known, "forms")
    roots = flatten_trees(known.filter("best is not null").select(F.col("rank").alias("node"), F.col("best").alias("parent")))
    ends = roots.join(words.select(F.col("rank").alias("parent"), F.col("word").alias("root")), "parent").select(F.col("node").alias("rank"), "root")
    return known.join(ends, "rank", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(count_words(documents(spark, sf_dir), damage=97), "counts")
    return spelling_variants(counts)
