"""A Merkle manifest of a table by a rollup of nested structs.

A row's leaf is the digest of its columns. Leaves get their rank within a group (a language) from one range exchange and counted
offsets. A rank's digits to the base FAN say where the leaf hangs: within a block of FAN ** DIGITS leaves, the digits are grouped away one
after the other, least first, and each grouping nests the structs of its children in their parent's. All these groupings are of one block, so the
rows move once. The digests of the blocks are the leaves of the next tier, until a group is one node; the groups' nodes are leaves of a last tree.

Proofs come from the nested structs alone: from the root down, each child is transformed into itself and its siblings' digests
and exploded; a block gets the way above it by being grouped with it. No row is joined with its proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import discard, documents, materialize

FAN, DIGITS = 8, 3
#: Rows of a table of offsets that is broadcast at most.
OFFSETS = 100_000
#: A proof: of each level, the digests left and right of the node on the way.
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def written(c: Column) -> Column:
    """A value as its UTF-8 bytes behind their count, null as ``-``, so that no two rows are written alike."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*map(written, values))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda at, level: digest(level["before"], at, level["after"]))


def siblings(proof: Column) -> Column:
    """The digests of a proof as one text, from the leaf to the root, in each level from left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")


def numbered(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves with _rank, gapless from 0 in its group, and _n, how many rows the group has.

    leaves is sorted over all partitions at once; a partition's rows of a group have consecutive places, so a row for each partition and group is
    all that is counted.
    """
    ascending = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = materialize(leaves.repartitionByRange(*ascending).sortWithinPartitions(*ascending).withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(F.col(group).alias("_of"), part).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_here"))
    same = Window.partitionBy("_of")
    before = F.coalesce(F.sum("_here").over(same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.select("_of", "_part", (before - F.col("_low")).alias("_shift"), F.sum("_here").over(same).alias("_n")), "offsets")
    few = F.broadcast(offsets) if offsets.count() <= OFFSETS else offsets
    met = placed.withColumn("_in", F.shiftright("_at", 33)).join(few, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_in") == F.col("_part")))
    return met.withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_in", "_of", "_part", "_shift")


def _rolled(nodes: DataFrame, base: int, fan: int, digits: int) -> DataFrame:
    """nodes(g, rank, levels, node struct(digest, ...)) -> (g, block, levels, node): one row for each block, its children nested in it.

    levels: how many a group's tree has in all; base: how many of them lie below. A level that a group doesn't have passes its one node on.
    """
    places = [f"d{k}" for k in range(digits)]
    rows = nodes.select("g", "levels", F.expr(f"rank div {fan**digits}").alias("block"), *[F.expr(f"rank div {fan**k} % {fan}").alias(d) for k, d in enumerate(places)], "node")
    rows = rows.repartition("g", "block")
    for k, place in enumerate(places):
        keys = ["g", "levels", "block", *places[k + 1 :]]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "node"))).alias("kids"))
        kids = F.transform("kids", lambda x: x["node"])
        own = F.when(F.col("levels") > base + k, digest(F.array_join(kids["digest"], ""))).otherwise(kids[0]["digest"])
        rows = rows.select(*keys, F.struct(own.alias("digest"), kids.alias("kids")).alias("node"))
    return rows.select("g", "block", "levels", "node")


def _grown(leaves: DataFrame, group: str, order: list[str], fan: int, digits: int) -> list[DataFrame]:
    """The tiers of the trees over leaves(group, digest, ...), from the leaves' blocks up; the last has one block a group."""
    ranked = numbered(leaves, group, order)
    levels = F.size(F.filter(F.array(*[F.lit(fan**k).cast("long") for k in range(63) if fan**k < 1 << 62]), lambda most: most < F.col("_n")))
    nodes = ranked.select(F.col(group).alias("g"), F.col("_rank").alias("rank"), levels.alias("levels"), F.struct("digest", *[c for c in leaves.columns if c != "digest"]).alias("node"))
    tiers: list[DataFrame] = []
    while True:
        tiers.append(materialize(_rolled(nodes, len(tiers) * digits, fan, digits), "tier"))
        if tiers[-1].filter("block > 0").isEmpty():
            return tiers
        nodes = tiers[-1].select("g", F.col("block").alias("rank"), "levels", F.struct("node.digest").alias("node"))


def _proved(tiers: list[DataFrame], tops: DataFrame, fan: int, digits: int) -> DataFrame:
    """(leaf struct, proof, above): the leaves of the trees whose roots tops(g, block 0, proof, above) tells the way from."""
    for t in range(len(tiers) - 1, -1, -1):
        blocks = tiers[t].select("g", "block", F.struct("levels", "node").alias("own")).unionByName(tops, allowMissingColumns=True)
        rows = blocks.groupBy("g", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("own", "proof", "above")])
        rows = rows.select("g", "own.levels", "own.node", F.col("block").alias("rank"), "proof", "above")
        for k in range(digits - 1, -1, -1):
            names = F.col("node.kids.digest")
            level = F.when(F.col("levels") > t * digits + k, 1).otherwise(0)
            child = F.transform("node.kids", lambda kid, i: F.struct(
                kid.alias("kid"), i.alias("i"),
                F.struct(F.array_join(F.slice(names, F.lit(1), i), "").alias("before"), F.array_join(F.slice(names, i + 2, F.size(names)), "").alias("after")).alias("level"),
            ))
            rows = rows.select("g", "levels", "rank", "proof", "above", level.alias("real"), F.explode(child).alias("x"))
            proof = F.when(F.col("real") == 1, F.concat(F.array("x.level"), "proof")).otherwise(F.col("proof"))
            rows = rows.select("g", "levels", (F.col("rank") * fan + F.col("x.i")).alias("rank"), proof.alias("proof"), "above", F.col("x.kid").alias("node"))
        tops = rows.select("g", F.col("rank").alias("block"), "proof", "above")
    return rows.select(F.col("node").alias("leaf"), "proof", "above")


def merkle_proofs(leaves: DataFrame, group: str, order: list[str], fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """leaves(digest string, ...) with subroot, root and proof, all rows and columns kept.

    Leaves of a group ascend by ``order``, nulls first; every ``fan`` consecutive nodes become the digest of theirs joined, until one is left: subroot, for a
    lone leaf the leaf itself. The subroots, ordered by group (null first, bytewise), give root in the same way. proof: array<struct(before,
    after)>, for each level from the leaf to the root the digests of the run's other nodes left and right of the one on the way; folded(digest, proof) is root.
    Rows that are equal in ``order`` must be told apart by it or be alike. Columns named subroot, root, proof or
    with a leading underscore are lost. No rows give no rows. One task holds a block of ``fan ** digits`` leaves at a time.
    """
    leaves = leaves.drop("subroot", "root", "proof", *[c for c in leaves.columns if c.startswith("_")])
    tiers = _grown(leaves, group, order, fan, digits)
    roots = tiers[-1].select(F.col("g").alias("key"), F.col("node.digest").alias("digest"), F.lit(0).alias("all"))
    upper = _grown(roots, "all", ["key"], fan, digits)
    start = upper[-1].select("g", "block", F.array().cast(PATH).alias("proof"), F.struct(F.col("node.digest").alias("root")).alias("above"))
    groups = _proved(upper, start, fan, digits)
    start = groups.select(F.col("leaf.key").alias("g"), F.lit(0).cast("long").alias("block"), "proof", F.struct(F.col("leaf.digest").alias("subroot"), "above.root").alias("above"))
    start = materialize(start, "groups")
    discard(*upper)
    found = _proved(tiers, start, fan, digits)
    return found.select(*[F.col("leaf")[c].alias(c) for c in leaves.columns], "above.subroot", "above.root", "proof")


def merkle_manifest(docs: DataFrame, columns: list[str], group: str = "lang", order: str = "doc_id", other: dict[str, Column] | None = None) -> DataFrame:
    """(order, group, leaf, subroot, root, proof) of the rows of docs, and other_leaf if ``other`` is given.

    leaf: digest of ``columns``, in that order, each ``-`` if null, else its byte count, a colon and its value. other: what some columns would be, such as
    tampered ones; other_leaf is the leaf of the row with them. Ties of ``order`` are ordered by leaf, so repeated rows have leaves of their own; a null
    order comes first, a null group is a group. All other columns are ignored, texts are read whole, and no rows give no rows.
    """
    as_is = {c: F.col(c) for c in columns}
    second = [leaf_digest(*(as_is | other).values()).alias("other_leaf")] if other else []
    leaves = docs.select(order, group, leaf_digest(*as_is.values()).alias("digest"), *second)
    leaves = materialize(leaves, "digests")
    out = merkle_proofs(leaves, group, [order, "digest", *(["other_leaf"] if other else [])])
    return out.withColumnRenamed("digest", "leaf")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    docs = documents(spark, sf_dir)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    tampered = F.when(hit, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    out = merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], other={"text": tampered})
    found = folded(F.col("other_leaf"), F.col("proof"))
    out = out.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
