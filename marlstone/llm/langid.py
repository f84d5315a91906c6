"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads segments of SEGMENT bytes in both directions, gives every byte's position a distribution over the languages, and a
document the mean of these over all positions of its whole text. It is trained in numpy by backpropagation through time, with
a loss at every position, on a bounded sample: at most SAMPLE documents a language, and about ROWS in all (one of each language at
least), with WINDOWS segments each, spread over the whole text. Everything else covers all rows, in one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import documents, tidy
from marlstone.llm.shingles import slices

SEGMENT, HIDDEN, SAMPLE, WINDOWS, ROWS = 48, 8, 256, 8, 51_200
EPOCHS, BATCH, RATE, SEED = 10, 512, 0.02, 7
UNKNOWN = "und"


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place; numpy has it several times as fast as tanh. Its slope is (1 - |result|) ** 2."""
    np.abs(x, out=room)
    room += 1
    x /= room


class BiGru:
    """Weights by direction: ``x`` (2, 256, 3H) for bytes, ``zr`` (2, H, 2H) and ``n`` (2, H, H) for the state; ``o`` and ``c`` for the output."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.h = hidden
        shapes = {"x": (2, 256, 3 * hidden), "zr": (2, hidden, 2 * hidden), "n": (2, hidden, hidden), "o": (2 * hidden, classes), "c": (classes,)}
        self.p = {k: (r.standard_normal(s) * (0.3 if k != "c" else 0)).astype(np.float32) for k, s in shapes.items()}

    def states(self, b: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (L, 2, N, H) of both directions after each of their steps; with ``keep`` what the way back needs."""
        n, length, h = len(b), b.shape[1], self.h
        s = np.zeros((2, n, h), np.float32)
        out, kept = np.empty((length, 2, n, h), np.float32), []
        x = np.empty((2, n, 3 * h), np.float32)
        steps = np.ascontiguousarray(b.T)
        room = np.empty((2, n, 2 * h), np.float32), np.empty((2, n, h), np.float32)
        for t in range(length):
            np.take(self.p["x"][0], steps[t], axis=0, out=x[0], mode="clip")
            np.take(self.p["x"][1], steps[length - 1 - t], axis=0, out=x[1], mode="clip")
            gates = np.matmul(s, self.p["zr"])
            gates += x[:, :, : 2 * h]
            _squash(gates, room[0])
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :, :h], gates[:, :, h:]
            own = np.matmul(s, self.p["n"])
            new = np.multiply(r, own)
            new += x[:, :, 2 * h :]
            _squash(new, room[1])
            if keep:
                kept.append((s, z, r, own, new))
            s = s - new
            s *= z
            s += new
            out[t] = s
        return out, kept

    def joint(self, states: np.ndarray) -> np.ndarray:
        """(L * N, 2H): for each position the state of either direction that has read up to it."""
        length, _, n, h = states.shape
        both = np.empty((length, n, 2 * h), np.float32)
        both[:, :, :h], both[:, :, h:] = states[:, 0], states[::-1, 1]
        return both.reshape(length * n, 2 * h)

    def positions(self, b: np.ndarray) -> np.ndarray:
        """(classes, L, N): the distribution at every position."""
        logits = self.p["o"].T @ self.joint(self.states(b)[0]).T
        logits += self.p["c"][:, None]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits.reshape(-1, b.shape[1], len(b))

    def gradients(self, b: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        length, n, h = b.shape[1], len(b), self.h
        states, kept = self.states(b, keep=True)
        both = self.joint(states)
        logits = both @ self.p["o"] + self.p["c"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        w = mask.T.reshape(-1, 1).astype(np.float32)
        prob[np.arange(length * n), np.tile(y, length)] -= 1
        prob *= w / max(1.0, float(w.sum()))
        g = {"o": both.T @ prob, "c": prob.sum(0)}
        back = (prob @ self.p["o"].T).reshape(length, n, 2 * h)
        into = np.empty((length, 2, n, h), np.float32)
        into[:, 0], into[::-1, 1] = back[:, :, :h], back[:, :, h:]
        g["zr"], g["n"] = np.zeros_like(self.p["zr"]), np.zeros_like(self.p["n"])
        dx = np.empty((2, length, n, 3 * h), np.float32)
        ds = np.zeros((2, n, h), np.float32)
        for t in range(length - 1, -1, -1):
            s, z, r, own, new = kept[t]
            ds = ds + into[t]
            dn = ds * (1 - z) * (1 - np.abs(new)) ** 2
            dzr = np.concatenate([ds * (s - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2, dn * own * 0.5 * (1 - np.abs(2 * r - 1)) ** 2], 2)
            down = dn * r
            g["zr"] += np.matmul(s.transpose(0, 2, 1), dzr)
            g["n"] += np.matmul(s.transpose(0, 2, 1), down)
            dx[0, t], dx[1, length - 1 - t] = np.concatenate([dzr[0], dn[0]], 1), np.concatenate([dzr[1], dn[1]], 1)
            ds = ds * z + np.matmul(dzr, self.p["zr"].transpose(0, 2, 1)) + np.matmul(down, self.p["n"].transpose(0, 2, 1))
        flat = b.T.reshape(-1)
        order = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        g["x"] = np.zeros_like(self.p["x"])
        for k in (0, 1):
            g["x"][k, used] = np.add.reduceat(dx[k].reshape(length * n, -1)[order], first, axis=0)
        return g

    def fit(self, b: np.ndarray, y: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> BiGru:
        """Adam over shuffled batches, the rate falling to nothing."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        total, step = epochs * -(-len(b) // BATCH), 0
        for _ in range(epochs):
            order = r.permutation(len(b))
            for a in range(0, len(b), BATCH):
                i = order[a : a + BATCH]
                step += 1
                for k, g in self.gradients(b[i], y[i], mask[i]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    rate = RATE * (1 - (step - 1) / total)
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def segments_of(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes (N, SEGMENT), mask, row) of the segments of all texts; what is behind a text's end is masked."""
    size = np.diff(at)
    count = -(-size // SEGMENT)
    row = np.repeat(np.arange(len(size)), count)
    start = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
    place = start[:, None] + np.arange(SEGMENT)
    mask = place < at[row + 1][:, None]
    b = data[np.minimum(place, max(len(data) - 1, 0))] if len(row) else np.zeros((0, SEGMENT), np.uint8)
    b[~mask] = 0
    return b, mask, row


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> tuple[list[str], BiGru | None]:
    """The languages and the network, learnt from text and lang of documents that aren't held out; no network without labelled text."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not langs:
        return [], None
    most = max(1, min(SAMPLE, ROWS // len(langs)))
    room = F.greatest(F.length("text") - SEGMENT, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substring(F.col("text"), F.floor(room * i / (WINDOWS - 1)).cast("int") + 1, F.lit(SEGMENT)))
    h = F.xxhash64("doc_id", "text")
    one = F.min(F.struct(h.alias("h"), F.array_join(F.array_distinct(windows), "\x00").alias("w"))).alias("one")
    sample = known.groupBy("lang", F.pmod(h, F.lit(most)).alias("k")).agg(one).select("lang", "k", "one.w").collect()
    rows = [(r["lang"], w) for r in sorted(sample, key=lambda r: (r["lang"], r["k"])) for w in r["w"].split("\x00") if w]
    raw = [w.encode()[:SEGMENT] for _, w in rows]
    b, mask, _ = segments_of(np.concatenate([[0], np.cumsum([len(x) for x in raw])]), np.frombuffer(b"".join(raw), np.uint8))
    number = {x: k for k, x in enumerate(langs)}
    return langs, BiGru(len(langs)).fit(b, np.array([number[x] for x, _ in rows]), mask)


def identify(docs: DataFrame, model: tuple[list[str], BiGru | None], at_once: int = 1024) -> DataFrame:
    """docs(text, ...) with lang_pred and score, the pooled probability of that language, for the whole text.

    A null or empty text or one without a letter is ``und`` with score 0, and so is every text if there was nothing to learn from. Ties go to
    the first language by name. All rows and columns stay, repeated ones are alike; columns named lang_pred and score are replaced; no rows
    give no rows. Texts of any length are read whole, in segments. A column named _letters is lost.
    """
    langs, net = model
    docs = docs.drop("lang_pred", "score", "_letters")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.withColumns({"_letters": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), "lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    at_text, at_letters = rows.columns.index("text"), rows.columns.index("_letters")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled = np.zeros((len(batch), len(langs)))
            for first, last, at, data in slices(batch.column(at_text)):
                b, mask, row = segments_of(at, data)
                for a in range(0, len(b), at_once):
                    p = shared.value.positions(b[a : a + at_once])
                    p *= mask[a : a + at_once].T
                    for c in range(len(langs)):
                        pooled[first:last, c] += np.bincount(row[a : a + at_once], p[c].sum(0), last - first)
            pooled /= np.maximum(pooled.sum(1, keepdims=True), 1e-30)
            known = np.asarray(batch.column(at_letters).to_numpy(zero_copy_only=False), bool)
            best = pooled.argmax(1)
            names = pa.array([langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], pa.string())
            score = pa.array(np.where(known, pooled[np.arange(len(best)), best], 0.0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], names, score], schema=batch.schema)

    return rows.mapInArrow(tidy(work), rows.schema).drop("_letters")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
