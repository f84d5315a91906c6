"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors of cosine >= c are at most eps = sqrt(2 - 2c) apart, and no projection makes them farther. All vectors are
projected on leading principal dimensions (from sums over the whole table), laid on a grid of cells as wide as eps and sorted by label and
all cells: the grid order. One range exchange and counted offsets give every vector its place in the sequence, which is cut into
intervals of LEAF vectors; these form a tree. Pairs of intervals are joined recursively, level by level: a pair whose bounding
boxes are farther apart than eps is skipped, any other is opened into its children. Boxes span BOXED principal dimensions and the
norm of what is left of a vector behind these, as two vectors differ in the rest by at least the difference of its norms.
Pairs of leaves that are left are compared by matrix products in double precision; those between the same two groups of FAN leaves go
together, so that a group's vectors are shipped once for all of them.

Equal vectors are one row with a count, so copies are never expanded, and a pair of groups gives a row for each vector and a spanning forest of its links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import discard, materialize, tidy
from marlstone.operators.components import connected_components

COSINE, LEAF, FAN = 0.93, 512, 4
#: Principal dimensions of the grid, and of the boxes.
GRID, BOXED = 8, 16
#: Components whose sums are taken for principal directions, and how many lengths of vectors (the most frequent ones) have their own;
#: others take their first components. Neither changes results.
AXES, LENGTHS = 256, 32


def _usable(v: pd.Series) -> list[np.ndarray | None]:
    out = []
    for x in v:
        a = None if x is None else np.array([np.nan if y is None else y for y in x] if x.dtype == object else x, np.float64)
        if a is None or not len(a) or not np.isfinite(a).all():
            out.append(None)
            continue
        top = np.abs(a).max()
        out.append(a if top > 0 else None)
    return out


def _directions(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For the most frequent lengths of vectors the mean and the leading principal directions of the first AXES components.

    Sums are added up over all tasks before they come to the driver, AXES**2 + AXES numbers at a time.
    """
    out = {}
    lengths = vectors.groupBy(F.size("unit").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()
    for d in (r["d"] for r in lengths):
        k = min(d, AXES)

        def sums(parts: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            n, s, q = 0, np.zeros(k), np.zeros((k, k))
            for p in parts:
                if len(p):
                    x = np.stack(p["unit"].to_numpy())[:, :k]
                    n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
            yield pd.DataFrame({"s": [np.concatenate([[n], s, q.ravel()])]})

        own = vectors.filter(F.size("unit") == d).select("unit").mapInPandas(sums, "s array<double>")
        rows = own.select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(1 + k + k * k)
        for r in rows:
            v[r["k"]] = r["v"]
        n, mean, second = v[0], v[1 : 1 + k] / v[0], v[1 + k :].reshape(k, k) / v[0]
        _, directions = np.linalg.eigh(second - np.outer(mean, mean))
        out[d] = (mean, directions[:, ::-1][:, :BOXED])
    return out


def _units(table: DataFrame) -> DataFrame:
    """(vec_id, label, unit, hash) of all rows; unit and hash are null for vectors that link with nothing."""

    @F.pandas_udf("unit array<double>, hash string")
    def unit(v: pd.Series) -> pd.DataFrame:
        import hashlib

        out = []
        for a in _usable(v):
            if a is None:
                out.append((None, None))
                continue
            a = a / np.abs(a).max()
            out.append((a / np.sqrt((a * a).sum()), hashlib.md5((a + 0.0).tobytes()).hexdigest()))
        return pd.DataFrame(out, columns=["unit", "hash"])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(F.col("label").isNotNull(), F.col("embedding")).alias("embedding"))
    return materialize(rows.withColumn("u", unit("embedding")).select("vec_id", "label", "u.unit", "u.hash"), "units")


def _sequence(good: DataFrame, eps: float, leaf: int) -> DataFrame:
    """(grp, leaf, hash, copies, first, label, box, unit, id): a row for each distinct vector, with its interval of the grid order."""
    # the scale of a vector doesn't matter: equal directions are one class, known by its hash
    classes = good.groupBy("label", "hash").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.first("unit").alias("unit"))
    known = good.sparkSession.sparkContext.broadcast(_directions(good))

    def project(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            boxes = []
            for u in p["unit"]:
                mean, directions = known.value.get(len(u)) or (np.zeros(min(len(u), AXES)), np.eye(min(len(u), AXES))[:, :BOXED])
                x = u[:AXES] - mean
                along = x @ directions
                rest = np.sqrt(max(0.0, x @ x - along @ along + u[AXES:] @ u[AXES:]))
                boxes.append(np.append(np.pad(along, (0, BOXED - len(along))), rest))
            cells = [np.floor(x[:GRID] / eps).astype(np.int64) for x in boxes]
            yield p.assign(box=boxes, cells=cells, grp=[f"{label}|{len(u)}" for label, u in zip(p["label"], p["unit"], strict=True)])

    schema = "label string, hash string, copies long, first long, unit array<double>, box array<double>, cells array<long>, grp string"
    order = ["grp", *(f"c{k}" for k in range(GRID)), "hash"]
    placed = classes.mapInPandas(project, schema).select("*", *(F.col("cells")[k].alias(f"c{k}") for k in range(GRID))).drop("cells")
    # the ranges are cut by a sample of the keys; written, so that a row keeps its range
    ranged = materialize(placed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("grp", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("grp", "range", (F.sum("n").over(Window.partitionBy("grp").orderBy("range")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("grp", "range").orderBy(*order))
    placed = ranged.withColumn("rank", rank).join(before, ["grp", "range"])
    placed = placed.withColumn("leaf", F.floor((F.col("base") + F.col("rank") - 1) / leaf).cast("long")).withColumn("id", F.xxhash64("grp", "hash"))
    out = materialize(placed.select("grp", "leaf", "hash", "copies", "first", "label", "box", "unit", "id"), "leaves")
    discard(ranged)
    return out


def _bounds(rows: DataFrame, node: str, low, high) -> DataFrame:
    found = rows.groupBy("grp", F.col(node).alias("node") if node == "leaf" else F.floor(F.col(node) / FAN).alias("node"))
    lows, highs = ([f(k).alias(f"{e}{k}") for k in range(BOXED + 1)] for e, f in (("l", low), ("h", high)))
    return materialize(found.agg(*lows, *highs), "boxes")


def near_leaves(placed: DataFrame, eps: float) -> DataFrame:
    """Pairs (grp, a, b), a <= b, of leaves that are not provably distant: pairs of nodes of a level, FAN of the level below each, from the top down."""
    levels = [_bounds(placed, "leaf", lambda k: F.min(F.col("box")[k]), lambda k: F.max(F.col("box")[k]))]
    while levels[-1].filter("node > 0").limit(1).count():
        levels.append(_bounds(levels[-1], "node", lambda k: F.min(f"l{k}"), lambda k: F.max(f"h{k}")))
    pairs = levels[-1].select("grp", F.col("node").alias("a"), F.col("node").alias("b"))
    for boxes in reversed(levels[:-1]):
        kids = lambda x: F.explode(F.sequence(F.col(x) * FAN, F.col(x) * FAN + FAN - 1)).alias(x)
        opened = pairs.select("grp", kids("a"), "b").select("grp", "a", kids("b")).filter("a <= b")
        sides = [boxes.select("grp", F.col("node").alias(x), F.array(*(F.col(f"l{k}") for k in range(BOXED + 1))).alias(f"low{x}"), F.array(*(F.col(f"h{k}") for k in range(BOXED + 1))).alias(f"high{x}")) for x in "ab"]
        gap = lambda k: F.greatest(F.col("lowa")[k] - F.col("highb")[k], F.col("lowb")[k] - F.col("higha")[k], F.lit(0.0))
        apart = F.aggregate(F.sequence(F.lit(0), F.lit(BOXED)), F.lit(0.0), lambda acc, k: acc + gap(k) * gap(k))
        pairs = materialize(opened.join(sides[0], ["grp", "a"]).join(sides[1], ["grp", "b"]).filter(apart <= eps * eps).select("grp", "a", "b"), "pairs")
    if len(levels) > 1:  # else the pairs are still to be made from the boxes
        discard(*levels)
    return pairs


def stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, centres) of stars that connect what the links (i, j) among n connect: each but the first of a component with its first."""
    first = np.arange(n)
    while len(i):
        x, y = first[i], first[j]
        low = np.minimum(x, y)
        np.minimum.at(first, x, low)
        np.minimum.at(first, y, low)
        while not np.array_equal(first, first[first]):
            first = first[first]
        apart = first[i] != first[j]
        i, j = i[apart], j[apart]
    members = np.flatnonzero(first != np.arange(n))
    return members, first[members]


def _compared(placed: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """(a, null, n): n rows link with vector a; and (a, b, null): pairs that connect what all links connect."""
    group = lambda c: F.floor(F.col(c) / FAN).cast("long")
    groups = placed.groupBy("grp", group("leaf").alias("g")).agg(F.collect_list(F.struct("leaf", "id", "copies", "unit")).alias("rows"))
    groups = materialize(groups.select("grp", "g", F.col("rows.leaf").alias("leaves"), F.col("rows.id").alias("ids"), F.col("rows.copies").alias("counts"), F.flatten("rows.unit").alias("units")), "groups")
    a, b = (groups.select("grp", F.col("g").alias(f"g{x}"), *[F.col(c).alias(c + x) for c in ("leaves", "ids", "counts", "units")]) for x in "ab")
    wanted = pairs.groupBy("grp", group("a").alias("ga"), group("b").alias("gb")).agg(F.collect_list("a").alias("pa"), F.collect_list("b").alias("pb"))
    joined = wanted.join(a, ["grp", "ga"]).join(b, ["grp", "gb"]).select((F.col("ga") == F.col("gb")).alias("same"), "pa", "pb", *[c + x for x in "ab" for c in ("leaves", "ids", "counts", "units")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                same, pairs_a, pairs_b, la, ia, ca, ua, lb, ib, cb, ub = (c[k].as_py() if j == 0 else c[k].values.to_numpy(zero_copy_only=False) for j, c in enumerate(batch.columns))
                ua, ub = ua.reshape(len(ia), -1), ub.reshape(len(ib), -1)
                na, nb, links_i, links_j = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64), [], []
                for x, y in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
                    i, j = np.flatnonzero(la == x), np.flatnonzero(lb == y)
                    hit = ua[i] @ ub[j].T >= cosine
                    if x == y:
                        np.fill_diagonal(hit, False)
                    if hit.any():
                        na[i] += hit @ cb[j]
                        if x != y:
                            nb[j] += hit.T @ ca[i]
                        p, q = np.nonzero(hit)
                        links_i.append(i[p])
                        links_j.append(j[q] + (0 if same else len(ia)))
                if not links_i:
                    continue
                ids = ia if same else np.concatenate([ia, ib])
                members, centres = stars(np.concatenate(links_i), np.concatenate(links_j), len(ids))
                # within one group both sides are the same vectors
                for x, n in [(ia, na + nb)] if same else [(ia, na), (ib, nb)]:
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(n[some])], names=["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[members]), pa.array(ids[centres]), pa.nulls(len(members), pa.int64())], names=["a", "b", "n"])

    out = materialize(joined.mapInArrow(tidy(compare), "a long, b long, n long"), "found")
    discard(groups)
    return out


def near_duplicate_vectors(table: DataFrame, cosine: float = COSINE, leaf: int = LEAF) -> DataFrame:
    """table(vec_id, embedding, label, ...) -> (vec_id, n_links, component_id, kept), a row for each row of the table.

    Two rows link if their labels are equal and not null and the cosine is at least ``cosine``; rows with equal vectors link with each other.
    Null or zero vectors, vectors that hold null or non-finite components, and vectors of different lengths link with
    nothing. n_links: rows linked directly; component_id: least vec_id reachable, its own included; kept: vec_id is that. Null
    vec_ids count for no least. Repeated rows stay; other columns are ignored; no rows give no rows.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    rows = _units(table)
    placed = _sequence(rows.filter("unit is not null"), eps, leaf)
    pairs = near_leaves(placed, eps)
    found = _compared(placed, pairs, cosine)
    links = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    components = connected_components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("id"), "component")
    named = placed.select("id", "copies", "first", "label", "hash")
    named = named.join(links, "id", "left").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(named.join(least, "component").select("label", "hash", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "names")
    discard(placed, pairs, found)
    out = rows.join(named, ["label", "hash"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op7_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
