"""Choosing questions: quotas by quality, least overlap in time, samples and orders that can be repeated."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.order import numbered
from marlstone.sources.scratch import materialize

#: Chunks of a retrieval pack; one chunk in so many is a pivot.
PACK = 512


def segment_quality(pool: DataFrame, keys: list[str], segment: str = "segment") -> DataFrame:
    """Mean score less its sample deviation, not below 0."""
    q = F.avg("score") - F.coalesce(F.stddev_samp("score"), F.lit(0.0))
    return pool.groupBy(*keys, segment).agg(F.greatest(F.round(q, 9), F.lit(0.0)).alias("quality"))


def largest_remainder_quotas(quality: DataFrame, keys: list[str], k: Column, segment: str = "segment") -> DataFrame:
    """quality with quota: shares of k by quality (equal ones if all are 0), floors, then a seat each by largest remainder, then segment."""
    w = Window.partitionBy(*keys)
    total, n = F.sum("quality").over(w), F.count(F.lit(1)).over(w)
    raw = F.round(F.when(total > 0, F.col("quality") / total).otherwise(F.lit(1.0) / n) * k, 9)
    out = quality.withColumn("raw", raw).withColumn("base", F.floor("raw").cast("int"))
    left = k - F.sum("base").over(w)
    seat = F.row_number().over(w.orderBy(F.round(F.col("raw") - F.col("base"), 9).desc(), segment))
    return out.withColumn("quota", (F.col("base") + (seat <= left).cast("int")).cast("int")).drop("raw", "base")


def select_proportional(pool: DataFrame, keys: list[str], k: int, segment: str = "segment") -> DataFrame:
    """pool(keys, segment, id, score) with selected: each segment's quota of its best, then the best of what is left up to k. An id stands once in a segment; best is the higher score (null last), then the higher id. Rows with a null key or segment aren't selected.

    No segment gives more than k, so only its best k are ranked, which Spark cuts down before it shuffles (for k up to spark.sql.optimizer.windowGroupLimitThreshold).
    What a segment gives is its best so many, so its least selected row tells all of them: the pool itself is joined with a row a segment and never sorted, however large a video is.
    """
    quotas = largest_remainder_quotas(segment_quality(pool, keys, segment), keys, F.lit(k), segment).select(*keys, segment, "quota")
    best = [F.col("score").desc(), F.col("id").desc()]
    leading = pool.select(*keys, segment, "id", "score").withColumn("_at", F.row_number().over(Window.partitionBy(*keys, segment).orderBy(*best))).filter(F.col("_at") <= k)
    ranked = leading.join(quotas, [*keys, segment]).withColumn("first", F.col("_at") <= F.col("quota"))
    taken = F.sum(F.col("first").cast("int")).over(Window.partitionBy(*keys))
    rest = F.row_number().over(Window.partitionBy(*keys, "first").orderBy(*best))
    chosen = ranked.withColumns({"_taken": taken, "_rest": rest}).filter(F.col("first") | (F.col("_rest") <= F.lit(k) - F.col("_taken")))
    least = chosen.groupBy(*keys, segment).agg(F.min(F.struct("score", "id")).alias("_least"))
    met = pool.join(least, [*keys, segment], "left").withColumn("selected", F.coalesce(F.struct("score", "id") >= F.col("_least"), F.lit(False)))
    return met.select(*pool.columns, "selected")


def calls_per_agent(questions: DataFrame, keys: list[str], segment: str = "segment") -> DataFrame:
    """questions(keys, segment, selected) -> (agent, calls, per_video): a call for each video, segment, candidate question and selected question. No questions: 0 calls, null for each video."""
    parts = questions.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("q"), F.count_if("selected").alias("s"))
    videos = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.sum("q").alias("q"), F.sum("s").alias("s"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = videos.agg(F.count(F.lit(1)).alias("v"), total("parts").alias("parts"), total("q").alias("q"), total("s").alias("s"))
    agents = zip(("Architect", "Inquisitor", "Scorer", "Synthesizer"), ("v", "parts", "q", "s"), strict=True)
    one = sums.select("v", F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.col(c).alias("calls")) for a, c in agents])).alias("c"))
    return one.select("c.agent", "c.calls", F.round(F.try_divide("c.calls", "v"), 6).alias("per_video"))


def selection_status(questions: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    flag = chosen.select(*on).distinct().withColumn("_in", F.lit(True))
    return questions.join(flag, on, "left").withColumn("status", F.when(F.col("_in"), "Selected").otherwise("Rejected")).drop("_in")


def question_context(selected: DataFrame, segments: DataFrame, on: list[str]) -> DataFrame:
    """Selected questions with content and times of their segment; those without content go."""
    return selected.join(segments.filter("content <> ''").select(*on, "content", "time_start_sec", "time_end_sec"), on)


def skip_topics(pool: DataFrame, topics: list[str], column: str = "topic") -> DataFrame:
    return pool.filter(~F.lower(column).isin([t.lower() for t in topics]) | F.col(column).isNull()) if topics else pool


def stratified_sample(pairs: DataFrame, strata: list[str], n: int, seed: str) -> DataFrame:
    """At most n pairs of each stratum, by a hash of uid and seed."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.col("uid"), F.lit(seed)).cast("binary")), "uid"))
    return pairs.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def seeded_shuffle(items: DataFrame, keys: list[str], column: str, seed: str) -> DataFrame:
    """items with question_number: a permutation within keys that seed repeats."""
    order = F.md5(F.concat(F.col(column).cast("string"), F.lit("|"), F.lit(seed)).cast("binary"))
    return items.withColumn("question_number", F.row_number().over(Window.partitionBy(*keys).orderBy(order, column)))


def seeded_order(items: DataFrame, columns: list[str], seed: str) -> DataFrame:
    """items with question_number: one permutation of the whole set from 1 on that seed repeats; columns must tell its rows apart."""
    shuffled = items.withColumn("_seeded", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(seed)).cast("binary")))
    return numbered(shuffled, ["_seeded", *columns], "question_number", 1).drop("_seeded")


def shared_ordered_set(pairs: DataFrame, most: int = 0) -> DataFrame:
    """One order for all raters: by question number, video, dataset, approach, uid; the first ``most`` (0: all)."""
    out = pairs.orderBy("qa_number", "video", "dataset", "approach", "uid")
    return out.limit(most) if most else out


def pick_min_overlap(items: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """items(keys, idx, start, end, topic, id) -> those kept: all of a video with at most k, else k by greedy least overlap in time.

    Each step depends on the steps before, so a video is one group; its candidates are what a model made for one transcript.
    The overlap with what is chosen is a running vector, so a video of n items costs k * n.
    """

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx", kind="stable").reset_index(drop=True)
        if len(p) <= k:
            return p
        start = p["start"].astype(float).where(p["start"].notna(), p["idx"].astype(float)).to_numpy()
        end = p["end"].astype(float).to_numpy()
        end = np.where(np.isnan(end), start + 1, end)
        start, end = np.minimum(start, end), np.maximum(start, end)
        length, topic = end - start, pd.factorize(p["topic"], use_na_sentinel=False)[0]
        ids = p["id"].where(p["id"].notna(), p["idx"]).to_numpy()
        over, seen, free = np.zeros(len(p)), np.zeros(topic.max() + 1, int), np.ones(len(p), bool)
        for _ in range(k):
            at = np.flatnonzero(free)
            best = at[np.lexsort((ids[at], -length[at], seen[topic[at]], over[at] - length[at], over[at]))[0]]
            free[best] = False
            seen[topic[best]] += 1
            over += np.maximum(0, np.minimum(end, end[best]) - np.maximum(start, start[best]))
        return p[~free]

    return items.groupBy(*keys).applyInPandas(pick, items.schema)


def _joined(cuts: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Pieces of parts between neighbouring cuts, joined up to ``size`` characters; each begins with the last parts of the one before, up to ``overlap`` of them."""
    begin, last = 0, len(cuts) - 1
    while True:
        end = max(begin + 1, bisect_right(cuts, cuts[begin] + size) - 1)
        yield cuts[begin], cuts[end]
        if end == last:
            return
        begin = min(end, bisect_left(cuts, max(cuts[end] - overlap, cuts[end + 1] - size)))


def chunk_borders(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", ""), base: int = 0) -> Iterator[tuple[int, int]]:
    """Borders of the chunks of a text: it is cut at the first separator that it has, which goes with the part behind it. Short parts are joined by the places of their cuts; a long one ends that, and is cut at the next separator."""
    sep, at = next((s, k) for k, s in enumerate(separators) if s in text)
    finer, cuts, long = separators[at + 1 :], range(len(text) + 1), []
    if sep:
        cuts = [n - len(sep) for n in accumulate((n + len(sep) for n in map(len, text.split(sep))), initial=0)]
        cuts[0] = 0
        if cuts[1] == 0:
            del cuts[0]
    if finer:
        long = [k for k, (x, y) in enumerate(pairwise(cuts)) if y - x >= size]
    begin, last = 0, len(cuts) - 1
    for k in [*long, last]:
        if begin < k:
            yield from ((base + x, base + y) for x, y in _joined(cuts[begin : k + 1], size, overlap))
        if k < last:
            yield from chunk_borders(text[cuts[k] : cuts[k + 1]], size, overlap, finer, base + cuts[k])
        begin = k + 1


def _chunks(text: str, size: int, overlap: int) -> list[str]:
    return [x for a, b in chunk_borders(text, size, overlap) if (x := text[a:b].strip())]


def recursive_chunks(texts: DataFrame, keys: list[str], text: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """(keys, chunk_no, chunk): pieces of at most ``size`` characters that overlap, cut at blank lines, else lines, else spaces, else anywhere; trimmed, none is empty."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p.assign(chunk=[_chunks(t, size, overlap) if isinstance(t, str) else [] for t in p[text]])
            p["chunk_no"] = [list(range(len(c))) for c in p["chunk"]]
            yield p[[*keys, "chunk_no", "chunk"]].explode(["chunk_no", "chunk"]).dropna(subset=["chunk"])

    schema = ", ".join([*(f"`{k}` {t}" for k, t in texts.select(*keys).dtypes), "chunk_no int", "chunk string"])
    return texts.select(*keys, text).mapInPandas(work, schema)


def _square(a: Column, b: Column) -> Column:
    """Squared distance of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _nearest_pivot(rows: DataFrame, pivots: DataFrame, block: str, key: str) -> DataFrame:
    """rows(block, key, v) with pivot and d, the nearest pivot of the block (ties: the smaller id) and its distance."""
    one = F.array_min(F.transform("pivots", lambda p: F.struct(F.sqrt(_square(p["v"], F.col("v"))).alias("d"), p["id"].alias("pivot"))))
    each = rows.join(pivots, block).select(block, key, "v", one.alias("near"))
    return each.groupBy(block, key).agg(F.min("near").alias("near"), F.first("v").alias("v")).select(block, key, "v", "near.*")


def _vector_packs(chunks: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
    """(packs(block, pivot, sub, c), pivots(block, group, pivots)) of chunks(block, id, v).

    About one chunk in PACK, by a hash of its id, and one for each block at least is a pivot; a chunk belongs to its nearest one, whose radius reaches the
    farthest. What a pivot has beyond PACK chunks, as of equal vectors, goes to further packs of it; pivots are held PACK at a time.
    """
    hashed = chunks.withColumn("h", F.xxhash64("id"))
    least = hashed.groupBy(block).agg(F.min("h").alias("least"))
    chosen = hashed.join(least, block).filter((F.col("h") == F.col("least")) | (F.pmod("h", F.lit(PACK)) == 0)).select(block, F.col("id").alias("pivot"), "v")
    groups = lambda rows, item: rows.groupBy(block, F.pmod(F.shiftright(F.xxhash64("pivot"), 20), F.col("n_groups")).alias("group")).agg(F.collect_list(item).alias("pivots"))
    n_groups = chosen.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / PACK).cast("long").alias("n_groups"))
    pivots = chosen.join(n_groups, block)
    member = materialize(_nearest_pivot(chunks, groups(pivots, F.struct(F.col("pivot").alias("id"), "v")), block, "id"), "members")
    sizes = member.groupBy(block, "pivot").agg(F.max("d").alias("radius"), F.ceil(F.count(F.lit(1)) / PACK).cast("int").alias("subs"))
    packs = member.join(sizes.select(block, "pivot", "subs"), [block, "pivot"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
    packs = packs.groupBy(block, "pivot", "sub").agg(F.collect_list(F.struct("id", "v")).alias("c"))
    reach = pivots.join(sizes, [block, "pivot"])
    return materialize(packs, "packs"), materialize(groups(reach, F.struct(F.col("pivot").alias("id"), "v", "radius", "subs")), "pivots")


def _packs_to_visit(asked: DataFrame, pivots: DataFrame, packs: DataFrame, block: str, k: int) -> DataFrame:
    """(block, q_id, v, pivot, sub): the packs that can hold one of a question's k nearest.

    The nearest pivot's packs give k chunks and so a bound of the k-th distance, if they have as many. By the triangle inequality a pack holds nothing
    within the bound if its pivot is farther from the question than the bound and its radius together.
    """
    first = _nearest_pivot(asked, pivots, block, "q_id").join(packs, [block, "pivot"])
    distances = first.select("q_id", F.explode(F.slice(F.array_sort(F.transform("c", lambda c: _square(c["v"], F.col("v")))), 1, k)).alias("d"))
    kept = distances.groupBy("q_id").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("d"))
    bound = kept.select("q_id", F.when(F.size("d") == k, F.sqrt(F.element_at("d", -1))).alias("bound"))
    reached = asked.join(bound, "q_id").join(pivots, block)
    # distances are compared to six places in the end
    within = lambda p: F.col("bound").isNull() | (F.sqrt(_square(p["v"], F.col("v"))) <= F.col("bound") + p["radius"] + 1e-4)
    near = reached.select(block, "q_id", "v", F.explode(F.filter("pivots", within)).alias("p"))
    return near.select(block, "q_id", "v", F.col("p.id").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("p.subs") - 1)).alias("sub"))


def retrieve_top_k(questions: DataFrame, chunks: DataFrame, block: str, k: int = 5) -> DataFrame:
    """questions(block, q_id, embedding), chunks(block, chunk_id, embedding) -> (q_id, chunk_id, distance, rank): the k nearest of the same block, squared L2.

    A block's chunks lie in packs around pivots, and a question goes only to those packs that can hold one of its k nearest, so the result is exact; a task
    holds single packs of about PACK chunks, whatever the block's size. Each pack gives its own best k, so at most k rows of each reach the last ranking. Distances are
    compared to six places; ties: the smaller chunk_id. Rows with a null vector are left out.
    """
    asked = questions.filter("embedding is not null").select(block, "q_id", F.col("embedding").alias("v"))
    packs, pivots = _vector_packs(chunks.filter("embedding is not null").select(block, F.col("chunk_id").alias("id"), F.col("embedding").alias("v")), block)
    pairs = _packs_to_visit(asked, pivots, packs, block, k).join(packs, [block, "pivot", "sub"])
    near = F.slice(F.array_sort(F.transform("c", lambda c: F.struct(F.round(_square(c["v"], F.col("v")), 6).alias("distance"), c["id"].alias("chunk_id")))), 1, k)
    best = pairs.select("q_id", F.explode(near).alias("n")).select("q_id", "n.*")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "chunk_id"))).filter(F.col("rank") <= k)
