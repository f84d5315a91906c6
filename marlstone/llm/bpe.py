"""Byte-level BPE by speculation and verification.

A sequence of tokens is the encoding of a word just if each token encodes its own bytes and each adjacent pair
encodes its joint bytes. So greedy longest match proposes tokens for all new words at once, a vectorised check
walks down the merges of all adjacent pairs, and only words with an incompatible pair are merged exactly.

Nothing is shuffled: each task works on its own rows, half a megabyte of text at a time. The tables of the vocabulary are flat arrays
(a few MB, as large as the tokenizer file) and are broadcast once; a worker keeps the tokens of about twice CACHED words and lets go of them
at the end of a task.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.shared import documents, tidy
from marlstone.llm.shingles import slices

CACHED = 100_000
#: Longer words are merged over a heap.
LONG = 64
#: A cut before the second of these characters never parts a word.
SAFE = regex.compile(r"\p{L}(?= \p{L})")
#: The fixed pattern of byte-level BPE; ``\s`` is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_names() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Table:
    """Numbers by keys that aren't negative, for many keys at once: open addressing in flat arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one slot, one gets it
            own = free & (self.keys[at] == keys)
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; -1 for those that aren't there."""
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        again = np.flatnonzero((there != keys) & (there >= 0))
        while len(again):
            at[again] = (at[again] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[again]]
            hit = there == keys[again]
            out[again[hit]] = self.values[at[again[hit]]]
            again = again[~hit & (there >= 0)]
        return out


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of parts one after the other."""
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=at[1:])
    return np.frombuffer(b"".join(parts), np.uint8), at


class Bpe:
    """Tables of one tokenizer file; ``encode_words`` and ``decode`` work on many words at once."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or whole words only aren't supported")
        byte, ids = _byte_names(), model["vocab"]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        raw = [b""] * self.size
        for name, i in ids.items():
            raw[i] = bytes(byte[c] for c in name)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            raw[i] = text.encode()
        #: the bytes of all tokens one after the other, and where each begins
        self.raw, self.at = _flat(raw)
        self.base = np.array([ids.get(c, -1) for c, _ in sorted(byte.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        #: rank at which a token comes to be: bytes come first; first and last part of the merge that makes it
        self.rank, self.head, self.tail = (np.full(self.size, x, np.int64) for x in (-1, -1, -1))
        order = np.arange(len(merges))[::-1]
        self.rank[self.made[order]], self.head[self.made[order]], self.tail[self.made[order]] = order, left[order], right[order]
        last = dict(zip((left * self.size + right).tolist(), range(len(merges))))
        self.pairs = _Table(np.fromiter(last, np.int64, len(last)), np.fromiter(last.values(), np.int64, len(last)))
        own = [(t, i) for i, t in enumerate(raw) if t and i not in set(self.added.values()) and min(self.base[b] for b in t) >= 0]
        found, of = self._exact([t for t, _ in own])
        count = np.bincount(of, minlength=len(own))
        first = dict(zip(of[::-1].tolist(), found[::-1].tolist()))
        self._trie({t: i for k, (t, i) in enumerate(own) if count[k] == 1 and first[k] == i})

    def _trie(self, tokens: dict[bytes, int]) -> None:
        """Nodes for all prefixes of the tokens that encode themselves: node * 256 + byte -> node, and the token that a node is, or -1."""
        edges: dict[int, int] = {}
        token_at = [-1]
        for t, i in tokens.items():
            node = 0
            for b in t:
                key = node * 256 + b
                if (node := edges.get(key, 0)) == 0:
                    node = edges[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = i
        self.edges, self.token_at = _Table(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))), np.array(token_at, np.int64)

    def _exact(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, word of each): the merges of all words in order of rank, of equal ranks the leftmost first; one merge of each word a round."""
        data, at = _flat(words)
        ids, of = self.base[data], np.repeat(np.arange(len(words)), np.diff(at))
        never = len(self.made)
        rank = np.full(len(ids), never)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least = np.minimum.reduceat(rank, start)
            live = least < never
            count = np.diff(np.append(start, len(ids)))
            alive = np.repeat(live, count)
            if not live.all():
                done.append((ids[~alive], of[~alive]))
                ids, of, rank, least, count = ids[alive], of[alive], rank[alive], least[live], count[live]
            if not len(ids):
                break
            p = np.flatnonzero(rank == np.repeat(least, count))
            p = p[np.concatenate([[True], of[p[1:]] != of[p[:-1]]])]
            ids[p] = self.made[least]
            rank[p] = never
            after = p[(p + 2 < len(ids)) & (of[np.minimum(p + 2, len(ids) - 1)] == of[p])]
            rank[after] = self._ranks(ids[after], ids[after + 2])
            before = p[(p > 0) & (of[p - 1] == of[p])]
            rank[before - 1] = self._ranks(ids[before - 1], ids[before])
            keep = np.ones(len(ids), bool)
            keep[p + 1] = False
            ids, of, rank = ids[keep], of[keep], rank[keep]
        ids, of = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]

    def exact(self, word: bytes) -> list[int]:
        return self._exact([word])[0].tolist()

    def bytes_of(self, token: int) -> bytes:
        return self.raw[self.at[token] : self.at[token + 1]].tobytes()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.pairs.get(a * self.size + b).astype(np.int64)
        return np.where(found < 0, len(self.made), found)

    def _exact_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length, over a linked list and a heap."""
        if not hasattr(self, "_merges"):
            there = self.pairs.keys >= 0
            self._merges = dict(zip(self.pairs.keys[there].tolist(), self.pairs.values[there].tolist()))
        ids, size, merges, made = self.base[np.frombuffer(word, np.uint8)].tolist(), self.size, self._merges, self.made.tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := merges.get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (r := merges.get(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := merges.get(ids[h] * size + ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return np.array([i for i in ids if i >= 0], np.int64)

    def _greedy(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, word of each) by longest match, all words a byte further at each step."""
        data = np.append(data, np.uint8(0))
        word, at = np.arange(len(at)), at.copy()
        node, best, end = np.zeros(len(at), np.int64), np.full(len(at), -1), at.copy()
        tokens, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(word):
            step = np.where(at < stop, self.edges.get(node * 256 + data[at]), -1)
            on = step >= 0
            node = np.where(on, step, 0)
            at += on
            token = self.token_at[node]
            best, end = np.where(token >= 0, token, best), np.where(token >= 0, at, end)
            off = np.flatnonzero(~on)
            if not len(off):
                continue
            if best[off].min() < 0:
                raise ValueError("the vocabulary lacks a byte")
            tokens.append(best[off])
            owners.append(word[off])
            at[off], best[off] = end[off], -1
            more = np.ones(len(word), bool)
            more[off] = at[off] < stop[off]
            word, at, stop, node, best, end = (x[more] for x in (word, at, stop, node, best, end))
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return tokens[order], owners[order]

    def _greedy_long(self, word: bytes, piece: int = 1 << 16) -> np.ndarray:
        """The same for one word of any length: the longest match at every place, then the way from match to match."""
        data, out, i = np.frombuffer(word, np.uint8), [], 0
        longest = int(np.diff(self.at).max())
        while i < len(data):
            part = np.append(data[i : i + piece + longest], np.uint8(0))
            at = np.arange(min(piece, len(part) - 1))
            place, node, best, size = at, np.zeros(len(at), np.int64), np.full(len(at), -1), np.zeros(len(at), np.int64)
            for k in range(longest):
                step = np.where(place + k < len(part) - 1, self.edges.get(node * 256 + part[np.minimum(place + k, len(part) - 1)]), -1)
                place, node = place[step >= 0], step[step >= 0]
                token = self.token_at[node]
                best[place[token >= 0]], size[place[token >= 0]] = token[token >= 0], k + 1
                if not len(place):
                    break
            if best.min() < 0:
                raise ValueError("the vocabulary lacks a byte")
            best, size, j = best.tolist(), size.tolist(), 0
            while j < len(at):
                out.append(best[j])
                j += size[j]
            i += j
        return np.array(out, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether no merge of lower rank than theirs reaches over the border of a and b.

        The later made of the two parts is opened at the border again and again; a merge of the two parts facing each
        other that comes before both of their own next merges would have joined them.
        """
        ok = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            rank = self.pairs.get(a * self.size + b)
            bad = (rank >= 0) & (rank < limit)
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            # of equal ranks, the left one's merge comes first, so the right one's is undone first and a tie at the border is lost to the left
            left = ra > rb
            limit = np.where(left, ra, rb + 1)
            a, b = np.where(left, self.tail[a], a), np.where(left, b, self.head[b])
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word as the bytes of 32-bit numbers, which are joined without a step for each token."""
        data, at = _flat(words)
        size = np.diff(at)
        short, long = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
        tokens, of = self._greedy(data, at[short], at[short + 1])
        of = short[of]
        if len(long):
            own = [self._greedy_long(words[w]) for w in long.tolist()]
            tokens, of = self._together([(tokens, of), (np.concatenate(own), np.repeat(long, [len(x) for x in own]))])
        inner = np.flatnonzero(of[1:] == of[:-1])
        wrong = np.zeros(len(words), bool)
        wrong[of[inner[~self.compatible(tokens[inner], tokens[inner + 1])]]] = True
        if wrong.any():
            again = short[wrong[short]]
            exact, which = self._exact([words[w] for w in again.tolist()])
            parts = [(tokens[~wrong[of]], of[~wrong[of]]), (exact, again[which])]
            parts += [(x := self._exact_long(words[w]), np.full(len(x), w)) for w in long[wrong[long]].tolist()]
            tokens, of = self._together(parts)
        ends = np.cumsum(4 * np.bincount(of, minlength=len(words))).tolist()
        raw = tokens.astype(np.int32).tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        tokens, of = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        return tokens[order], of[order]

    def decode(self, ids: list[int]) -> str:
        """The text of one list of ids."""
        return self.decode_rows(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()

    def decode_rows(self, ids: np.ndarray, at: np.ndarray, piece: int = 1 << 18) -> pa.Array:
        """Texts of the ids between offsets: bytes of the tokens, added ones included, as UTF-8; what isn't UTF-8 becomes U+FFFD."""
        size = np.diff(self.at)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(ends[-1]), np.uint8)
        for a in range(0, len(ids), piece):
            b = min(a + piece, len(ids))
            shift = np.repeat(self.at[ids[a:b]] - ends[a:b], size[a:b])
            out[ends[a] : ends[b]] = self.raw[shift + np.arange(ends[a], ends[b])]
        texts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(ends[at].astype(np.int32)), pa.py_buffer(out))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            cuts = ends[at].tolist()
            return pa.array([out[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], pa.string())
        return texts


class Encoder:
    def __init__(self, bpe: Bpe):
        self.bpe, self.words = bpe, regex.compile(PATTERN)
        self.known: dict = {}
        self.older: dict = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(bpe.added, key=len, reverse=True))) + ")") if bpe.added else None

    def _pieces(self, text: str) -> list:
        """Words of a text; for added tokens their ids."""
        if self.cut is None or not any(t in text for t in self.bpe.added):
            return self.words.findall(text)
        out: list = []
        for k, part in enumerate(self.cut.split(text)):
            out += [self.bpe.added[part]] if k % 2 else self.words.findall(part)
        return out

    def _parts(self, text: str, most: int = 1 << 19) -> Iterator[str]:
        """A long text in parts that no word and no added token crosses: cut before a space between two letters."""
        while len(text) > most and (m := SAFE.search(text, most)):
            yield text[: m.start() + 1]
            text = text[m.start() + 1 :]
        yield text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [list(self._parts(t or "")) for t in texts]
        return [np.concatenate([self._encode([p])[0] for p in own]) for own in parts] if any(len(p) > 1 for p in parts) else self._encode([p for own in parts for p in own])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        pieces = [self._pieces(t) for t in texts]
        unseen = set().union(*pieces).difference(self.known)
        again = unseen & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new = [w for w in unseen - again if isinstance(w, str)]
        self.known.update(zip(new, self.bpe.encode_words([w.encode() for w in new]), strict=True))
        self.known.update((w, np.int32(w).tobytes()) for w in unseen if not isinstance(w, str))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.int32) for p in pieces]


def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f))


def bpe_round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with ``ids`` array<int> of the whole text and ``decoded``, the text of these ids again.

    tokenizer: path of a byte-level BPE file on the driver. The strings of added tokens in a text become these tokens. A null text
    counts as empty: no ids, empty decoded text. Rows are kept one by one, repeated ones too, with all other columns;
    columns that are named as the new ones are replaced. Texts may have any length; no rows give no rows.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load(tokenizer))
    kept = [c for c in df.columns if c not in (ids, decoded)]
    df = df.select(*kept)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    where, names = kept.index(text), schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            for first, last, _, _ in slices(b.column(where)):
                part = b.slice(first, last - first)
                found = encoder.encode(part.column(where).to_pylist())
                at = np.zeros(len(found) + 1, np.int64)
                np.cumsum([len(x) for x in found], out=at[1:])
                flat = np.concatenate(found)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, encoder.bpe.decode_rows(flat, at)], names=names)

    return df.mapInArrow(tidy(work), schema)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def encoded_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs(doc_id, text, ...)."""
    out = bpe_round_trip(docs.select("doc_id", "text"), tokenizer)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(documents(spark, sf_dir), default_tokenizer())
