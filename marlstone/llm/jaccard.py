"""N-gram Jaccard join with adaptive multi-match prefixes.

If two sets have a Jaccard similarity of at least j, they share at least ceil(j * larger) tokens. In any order
of all tokens, the first ``n - ceil(j * n) + m`` tokens of each (its m-prefix) then hold m common ones, so a pair whose
prefixes are for m_x and m_y must share min(m_x, m_y) prefix tokens before it is verified.

1. ``_signatures``: every text's shingle set, its size and its identity; equal sets are one class from here on. In the order of
   hashes, a longer prefix (m = a tenth of the set) tells which sets can have any partner at all (``_able``); only these go on, as the
   condition is necessary. Tokens are dealt in buckets, whose number comes from the counted size of the texts; a worker holds one at a
   time. A token that two sets of one piece of the input share is answered there, so a frequent one reaches its bucket once for each piece.
2. ``_index``: over the sets left the exact frequency of each token; tokens of one set only come first in the order and
   are never shuffled again; then rarer ones first. Each set picks its own m by the estimated candidate cost.
3. ``_components``: the join of the prefixes. A token's sets are first joined to hubs, not to each other, so that a group of near copies
   gives a star and not all its pairs; stars that are linked contract to one component. What is left of a token are
   sets of different components, which are joined with each other. Hub or not, a pair is verified only if its prefixes share min(m)
   tokens, and no link between different components is skipped.

What is known of frequent tokens is broadcast (``shared.join_hot``); the sets of a token are joined with each other in groups of about GROUP.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import discard, documents, join_hot, materialize, tidy
from marlstone.llm.shingles import shingle_sets, slices
from marlstone.operators.components import connected_components

K, NUM, DEN = 5, 75, 100
#: The first pass asks a tenth of a set as matches; m of the second pass is 1 to MOST_M; a verification costs as much as so many postings for each token.
EXTRA, MOST_M, VERIFY = 0.1, 16, 0.05
#: Rounds in which sets are joined to hubs, and how many of its hubs a set is verified against in each.
ROUNDS, HUBS = 2, 3
#: Words of 64 bits in a set's parity signature, which tells pairs apart that differ in more tokens than a link allows.
SIGN = 8
#: Bytes of text for a bucket, prefix tokens of a piece, partitions at most, sets of a token that meet in one group.
BUCKET, PIECE, PARTITIONS, GROUP = 1 << 24, 1 << 19, 20_000, 512
_LOW = np.uint64((1 << 48) - 1)


def _need(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of n tokens shares at least with any partner that is not smaller: ceil(j * n)."""
    return -(-n * NUM // DEN)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal values of a sorted array."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return starts, np.append(starts[1:], len(x))


_ROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("set", pa.int64()), ("bucket", pa.int32()), ("six", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary())])
_ROW_DDL = "doc_id long, n int, set long, bucket int, six binary, ids binary, sizes binary, counts binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _answers(ids: np.ndarray, sizes: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows (-1 - part of the set, sets, sizes, how often each is there): how many shared prefix tokens they were found to have."""
    ids, first, counts = np.unique(ids, return_index=True, return_counts=True)
    sizes, to = sizes[first], (ids.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ids, sizes, counts, to = ids[order], sizes[order], counts[order], to[order]
    for a, b in zip(*_runs(to), strict=True):
        yield None, None, None, -1 - int(to[a]), b"", ids[a:b].tobytes(), sizes[a:b].astype(np.int32).tobytes(), counts[a:b].astype(np.int32).tobytes()


def _piece(t: np.ndarray, ids: np.ndarray, sizes: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows for the prefix tokens of a piece of the input: answers for tokens that several of its sets share, and postings
    by bucket, each token with its low 48 bits. A token that is answered is posted once, with size 0, for others to meet."""
    order = np.lexsort((ids, t))
    t, ids, sizes = t[order], ids[order], sizes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (ids[1:] != ids[:-1])
    t, ids, sizes = t[new], ids[new], sizes[new].copy()
    starts, ends = _runs(t)
    shared = np.repeat(ends - starts > 1, ends - starts)
    yield from _answers(ids[shared], sizes[shared], buckets)
    sizes[shared] = 0
    post = ~shared
    post[starts] = True
    t, ids, sizes = t[post], ids[post], sizes[post]
    bucket = ((t >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((sizes, ids, bucket))
    t, ids, sizes, bucket = t[order], ids[order], sizes[order], bucket[order]
    for a, b in zip(*_runs(bucket), strict=True):
        six = (t[a:b] & _LOW).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        new = np.ones(b - a, bool)  # a set can be there with its size and with 0
        new[1:] = (ids[a + 1 : b] != ids[a : b - 1]) | (sizes[a + 1 : b] != sizes[a : b - 1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, b - a))
        yield None, None, None, int(bucket[a]), six, ids[a:b][first].tobytes(), sizes[a:b][first].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()


def _signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of documents (doc_id, n, set) and, in the same pass, answers and postings of prefix tokens in the order of hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t, ids, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            if rows := list(_piece(t, ids, sizes, buckets)):
                yield _batch(rows)

        for b in batches:
            for first, last, at, data in slices(b.column(1)):
                s, sizes, ids = shingle_sets(at, data, K)
                ids = ids.view(np.int64)
                m = (EXTRA * sizes).astype(np.int64) + 1
                length = np.minimum(sizes, sizes - _need(sizes) + m)
                starts = np.cumsum(sizes) - sizes
                keep = np.arange(len(s)) - np.repeat(starts, sizes) < np.repeat(length, sizes)
                of = np.repeat(np.arange(len(sizes)), sizes)[keep]
                none = pa.nulls(last - first, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), pa.array(sizes, pa.int32()), pa.array(ids, mask=sizes == 0), pa.nulls(last - first, pa.int32()), none, none, none, none],
                    schema=_ROW,
                )
                held.append((s[keep], ids[of], sizes[of].astype(np.int64)))
                if sum(len(h[0]) for h in held) >= PIECE:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(work), _ROW_DDL)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bytes, bytes, bytes, bytes]]]]:
    """Rows that are sorted by bucket, one bucket at a time."""
    at, rows = None, []
    for b in batches:
        for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "six", "ids", "sizes", "counts")), strict=True):
            if bucket != at and rows:
                yield at, rows
                rows = []
            at = bucket
            rows.append(tuple(row))
    if rows:
        yield at, rows


def _shared_in_prefix(rows: DataFrame, buckets: int) -> DataFrame:
    """Answers from the postings: how many of a set's prefix tokens are in another set's prefix too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_bucket(batches):
            t = np.zeros((sum(len(six) for six, *_ in own) // 6, 8), np.uint8)
            t[:, :6] = np.frombuffer(b"".join(six for six, *_ in own), np.uint8).reshape(-1, 6)
            t = t.reshape(-1).view(np.uint64)
            counts = np.frombuffer(b"".join(c for *_, c in own), np.int32)
            ids = np.repeat(np.frombuffer(b"".join(i for _, i, _, _ in own), np.int64), counts)
            sizes = np.repeat(np.frombuffer(b"".join(n for _, _, n, _ in own), np.int32), counts)
            order = np.lexsort((-sizes, ids, t))  # of a set that is there twice the size counts, not the 0
            t, ids, sizes = t[order], ids[order], sizes[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (ids[1:] != ids[:-1])
            t, ids, sizes = t[new], ids[new], sizes[new]
            starts, ends = _runs(t)
            asked = np.repeat(ends - starts > 1, ends - starts) & (sizes > 0)
            if found := list(_answers(ids[asked], sizes[asked], buckets)):
                yield _batch(found)

    return rows.mapInArrow(tidy(work), _ROW_DDL)


def _able(answers: DataFrame) -> DataFrame:
    """(set): those with as many shared prefix tokens as a partner asks for, be it as small as can be."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_bucket(batches):
            ids, sizes, counts = (np.frombuffer(b"".join(r[k] for r in own), t) for k, t in ((1, np.int64), (2, np.int32), (3, np.int32)))
            sets, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
            hits = np.bincount(inverse, counts, len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(sets[hits >= np.floor(EXTRA * _need(sizes[first])) + 1])], names=["set"])

    return answers.mapInArrow(tidy(work), "set long")


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket")


def _sets(texts: DataFrame) -> DataFrame:
    """(set, n, tokens, sign): the shingle set of each text that has one, and the parity of its tokens in each of 64 * SIGN bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, at, data in slices(b.column(0)):
                s, sizes, ids = shingle_sets(at, data, K)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(s.view(np.int64)))
                sign = np.zeros(len(sizes) * SIGN, np.uint64)
                np.bitwise_xor.at(sign, np.repeat(np.arange(len(sizes)), sizes) * SIGN + (s % np.uint64(SIGN)).astype(np.int64), np.uint64(1) << (s >> np.uint64(8)) % np.uint64(64))
                signs = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * SIGN, pa.int32()), pa.array(sign.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(sizes, pa.int32()), lists, signs], names=["set", "n", "tokens", "sign"]).filter(pa.array(sizes > 0))

    return texts.select("text").mapInArrow(tidy(work), "set long, n int, tokens array<long>, sign array<long>")


def _index(sets: DataFrame) -> DataFrame:
    """(set, n, m, alone, prefix, sign), one row for each set with a shared token in its prefix: its m, how many of its tokens no other set has, and the
    tokens of the m-prefix behind these, rare ones first."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, sizes, out = b.column(0).to_numpy(), b.column(1).to_numpy(), []
            at, inner = b.column(2).offsets.to_numpy(), b.column(2).values
            freq, token = (np.asarray(inner.field(k)) for k in (0, 1))
            for r in range(len(b)):
                f, t, size = freq[at[r] : at[r + 1]], token[at[r] : at[r + 1]], int(sizes[r])
                order = np.lexsort((t, f))
                f, t, k = f[order], t[order], len(t)
                need = int(_need(size))
                m = np.arange(1, max(1, min(MOST_M, need)) + 1)
                length = np.clip(size - need + m - (size - k), 0, k)
                scan = np.concatenate([[0], np.cumsum(f - 1)])[length]
                # an m whose prefix has fewer than m shared tokens still counts, as the partner's m may be less
                best = int(np.argmin(scan * (1 + VERIFY * size / m))) if length[0] else 0
                if length[best]:
                    out.append((int(sets[r]), size, int(m[best]), size - k, t[: length[best]]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["set", "n", "m", "alone", "prefix"])

    postings = sets.select("set", "n", F.explode("tokens").alias("token"))
    freq = materialize(postings.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "frequencies")
    total = int(freq.agg(F.sum("f")).first()[0] or 0)
    shared = join_hot(postings, freq, ["token"], "f", total).groupBy("set", "n").agg(F.collect_set(F.struct(F.col("f").cast("long").alias("f"), "token")).alias("found"))
    chosen = shared.mapInArrow(tidy(choose), "set long, n int, m int, alone int, prefix array<long>")
    out = materialize(chosen.join(sets.select("set", "sign").dropDuplicates(["set"]), "set"), "index")
    discard(freq)
    return out


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets have a Jaccard similarity of at least NUM / DEN."""
    left, right = (sets.select(F.col("set").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").filter(DEN * both >= NUM * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _side(index: DataFrame, x: str, *columns: str) -> DataFrame:
    """Columns of the index, named for one side of a pair."""
    return index.select(F.col("set").alias(x), *(F.col(c).alias(c + x) for c in columns))


def _differ() -> Column:
    """Bits of parity in which the sets a and b differ; they differ in as many tokens at least."""
    bits = [F.bit_count(F.col("signa")[k].bitwiseXOR(F.col("signb")[k])) for k in range(SIGN)]
    return sum(bits[1:], bits[0])


def _common() -> Column:
    """Tokens that a and b share if they link."""
    return F.ceil((F.col("na") + F.col("nb")) * NUM / (DEN + NUM))


def _may_link(differ: Column) -> Column:
    return (F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM) & (differ <= F.col("na") + F.col("nb") - 2 * _common())


def _share_enough() -> Column:
    """The multi-match condition: prefixes share as many tokens as the smaller m."""
    return F.size(F.array_intersect("prefixa", "prefixb")) >= F.least("ma", "mb")


def _stars(live: DataFrame, postings: DataFrame, tokens: DataFrame, total: int) -> DataFrame:
    """Candidates (a, b): each set with the hubs of its prefix tokens, if their prefixes share enough; of these the HUBS with the nearest signatures."""
    ends = tokens.select("token", "f", F.array("x", "y").alias("hubs"))
    tried = join_hot(postings.select("set", "component", "token"), ends, ["token"], "f", total).select("set", "component", F.explode("hubs").alias("hub")).distinct()
    sides = ("n", "m", "prefix", "sign", "component")
    pairs = tried.filter(F.col("set") != F.col("hub")).select(F.col("set").alias("a"), F.col("hub").alias("b")).join(_side(live, "a", *sides), "a").join(_side(live, "b", *sides), "b")
    near = pairs.filter((F.col("componenta") != F.col("componentb")) & _may_link(_differ()) & _share_enough()).select("a", "b", _differ().alias("differ"))
    best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("differ", "b"))), 1, HUBS).alias("best"))
    return best.select("a", F.explode("best.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest(_: DataFrame, postings: DataFrame, tokens: DataFrame, total: int) -> DataFrame:
    """Candidates (a, b): sets of different components that share enough prefix tokens, in the places that both sizes leave for common ones.

    The sets of a token are dealt into groups of about GROUP on one side, and the other side goes to each of them.
    """
    groups = tokens.select("token", "f", F.ceil(F.col("f") / GROUP).cast("int").alias("groups"))
    rows = join_hot(postings.select("set", "component", "n", "m", "pos", "sign", "token"), groups, ["token"], "f", total).drop("f")
    sides = ("component", "n", "m", "pos", "sign")
    a = rows.withColumn("group", F.pmod(F.xxhash64("set"), F.col("groups"))).select("token", F.col("group").cast("int").alias("group"), F.col("set").alias("a"), *(F.col(c).alias(c + "a") for c in sides))
    b = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("token", "group", F.col("set").alias("b"), *(F.col(c).alias(c + "b") for c in sides))
    # of this pair's common tokens, min(m) lie in prefixes that are as short as both sizes allow
    m = F.least("ma", "mb")
    near = _may_link(_differ()) & (F.col("posa") < F.col("na") - _common() + m) & (F.col("posb") < F.col("nb") - _common() + m) & (F.col("componenta") < F.col("componentb"))
    return a.join(b, ["token", "group"]).filter(near).groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.min(m).alias("m")).filter("hits >= m").select("a", "b")


def _components(index: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of the sets that verified links connect, component the least of them."""
    live, links, components = index.withColumn("component", F.col("set")), None, None
    for k in range(ROUNDS + 1):
        postings = live.select("set", "component", "n", "m", (F.col("alone") / F.col("n")).alias("own"), "alone", "sign", F.posexplode("prefix").alias("i", "token")).withColumn("pos", F.col("alone") + F.col("i"))
        # hubs of a token: by turns of its sets in an order of its own, and at first a set with few tokens of its own, the middle of a group of copies
        turn = lambda j: F.xxhash64("token", F.lit(j))
        mix = F.min(F.col("set").bitwiseXOR(turn(2 * k)))
        middle = F.min(F.struct("own", "set"))["set"] if k == 0 else F.min(F.col("set").bitwiseXOR(turn(2 * k + 1)))
        tokens = postings.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"), mix.alias("x"), middle.alias("y"))
        # a token whose sets are all in one component can tell of no link that matters
        tokens = tokens.filter("lo < hi").withColumn("x", F.col("x").bitwiseXOR(turn(2 * k))).withColumn("y", F.col("y") if k == 0 else F.col("y").bitwiseXOR(turn(2 * k + 1)))
        tokens = materialize(tokens.select("token", "f", "x", "y"), "tokens")
        total = int(tokens.agg(F.sum("f")).first()[0] or 0)
        if not total:
            discard(tokens)
            break
        found = materialize(_verified((_stars if k < ROUNDS else _rest)(live, postings, tokens, total), sets), "links")
        discard(tokens)
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        components = connected_components(links)
        if k < ROUNDS:
            named = index.join(components.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
            live = materialize(named, "named")
    return sets.select(F.col("set").alias("node"), F.col("set").alias("component")).limit(0) if components is None else components


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id), one row for each row of docs.

    Sets are the distinct runs of five words (A-Z in lower case) of the whole text; a text of one to four words is one shingle.
    component_id is the least doc_id that links reach. Null or empty texts and texts without words have an empty set
    and stay alone; a null doc_id counts for no minimum; repeated rows stay; other columns are ignored; no rows give no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = min(1 << 23, max(8, -(-size // BUCKET)))
    seen = materialize(_signatures(docs, buckets), "signatures")
    rows = materialize(seen.filter("bucket is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set"), "rows")
    per = materialize(rows.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id")), "classes")
    answers = seen.filter("bucket < 0").unionByName(_shared_in_prefix(_dealt(seen.filter("bucket >= 0"), buckets), buckets))
    able = materialize(per.join(_able(_dealt(answers, buckets)), "set").select("doc_id").distinct(), "able")
    discard(seen)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(able.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = materialize(_sets(texts), "sets")
    index = _index(sets)
    components = _components(index, sets).withColumnRenamed("node", "set")
    firsts = per.select("set", F.col("doc_id").alias("first")).join(components, "set", "left").withColumn("component", F.coalesce("component", "set"))
    names = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(firsts.join(names, "component").select("set", "component_id"), "names")
    discard(able, sets, index, per)
    return rows.join(named, "set", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))
