"""The corpus of question/answer pairs: ids, filters, joins to the manifest, summaries, and the books of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import TRACKS, build_uid, is_refusal, word_count
from marlstone.operators.components import connected_components
from marlstone.sources.scratch import discard, materialize


def corpus_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(dataset, video, approach, n, question, answer, time_start_sec, time_end_sec) with uid and whole seconds t, te; blank ones go, numbers stay."""
    out = pairs.withColumns({"question": F.trim("question"), "answer": F.trim("answer")}).filter("question <> '' and answer <> ''")
    return out.withColumns({"uid": build_uid(F.col("dataset"), F.col("video"), F.col("approach"), F.col("n")), "t": F.col("time_start_sec").cast("int"), "te": F.col("time_end_sec").cast("int")})


def exclude_approaches(pairs: DataFrame, names: list[str]) -> DataFrame:
    return pairs.filter(~F.col("approach").isin(names)) if names else pairs


def select_videos(manifest: DataFrame, only: list[int] | None = None, start: int | None = None) -> DataFrame:
    out = manifest.filter(F.col("index").isin(only)) if only else manifest
    return out.filter(F.col("index") >= start) if start is not None else out


def select_approaches(pairs: DataFrame, app: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """Pairs of the approaches asked for (None: all) without those to be skipped."""
    return exclude_approaches(pairs.filter(F.col("approach").isin(app)) if app else pairs, skip or [])


def drop_refusals(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~is_refusal(F.col("answer")))


def cap_answers(pairs: DataFrame, keys: list[str], cap: int = 20) -> DataFrame:
    """The first ``cap`` answered questions of each group in order, after refusals are gone."""
    kept = drop_refusals(pairs).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("n")))
    return kept.filter(F.col("_n") <= cap).drop("_n")


def pairs_with_video(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    return pairs.join(manifest.filter("url is not null").select("dataset", "video", "url", "language"), ["dataset", "video"], "left")


def missing_video_links(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    return pairs.select("dataset", "video").distinct().join(manifest.filter("url is not null"), ["dataset", "video"], "left_anti")


def pending(requested: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return requested.join(done, on, "left_anti")


def corpus_summary(pairs: DataFrame) -> DataFrame:
    """(dataset, approach, videos, pairs, timed): a row for each, and one TOTAL."""
    out = pairs.groupingSets([["dataset", "approach"], []], "dataset", "approach").agg(F.countDistinct("dataset", "video").alias("videos"), F.count(F.lit(1)).alias("pairs"), F.count("t").alias("timed"))
    return out.select(F.coalesce("dataset", F.lit("TOTAL")).alias("dataset"), F.coalesce("approach", F.lit("TOTAL")).alias("approach"), "videos", "pairs", "timed")


def pick_caption_track(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """tracks(keys, lang, name): the first track in the language's order of preference, else the first by name."""
    ranks = tracks.sparkSession.createDataFrame([(lang, n, k) for lang, names in TRACKS.items() for k, n in enumerate(names)], "lang string, name string, rank int")
    ranked = tracks.join(F.broadcast(ranks), ["lang", "name"], "left")
    return ranked.groupBy(*keys, "lang").agg(F.min(F.struct(F.coalesce("rank", F.lit(99)), "name")).alias("best")).select(*keys, "lang", F.col("best.name").alias("name"))


def pick_transcript(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.filter(F.col("name").rlike(r"^transcript.*\.json$")).groupBy(*keys).agg(F.min("name").alias("name"))


def length_profile(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Words and sentences of answers: mean, median, 90th percentile, greatest, share within 60 to 80 words, share with times, mean of questions."""
    words, sentences = word_count(F.col("answer")), F.greatest(F.size(F.regexp_extract_all("answer", F.lit(r"[.!?](?:\s|$)"), F.lit(0))), F.lit(1))
    one = pairs.withColumns({"w": words, "s": sentences, "qw": word_count(F.col("question"))})
    return one.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg("w"), 6).alias("words_mean"), F.percentile("w", F.lit(0.5)).alias("words_median"), F.round(F.percentile("w", F.lit(0.9)), 6).alias("words_p90"), F.max("w").alias("words_max"),
        F.round(F.avg("s"), 6).alias("sentences_mean"), F.max("s").alias("sentences_max"), F.round(F.avg(F.col("w").between(60, 80).cast("int")), 6).alias("within_60_80"),
        F.round(F.avg(F.col("t").isNotNull().cast("int")), 6).alias("grounded"), F.round(F.avg("qw"), 6).alias("question_words_mean"),
    )


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pairs_a, pairs_b, same_count, same_questions, common): two generations side by side."""
    q = F.md5(F.col("question").cast("binary"))
    one = lambda df, x: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"pairs_{x}"), F.sort_array(F.collect_set(q)).alias(f"q_{x}"))
    both = one(a, "a").join(one(b, "b"), keys, "full_outer")
    return both.select(*keys, F.coalesce("pairs_a", F.lit(0)).alias("pairs_a"), F.coalesce("pairs_b", F.lit(0)).alias("pairs_b"), F.coalesce(F.col("pairs_a") == F.col("pairs_b"), F.lit(False)).alias("same_count"), F.coalesce(F.col("q_a") == F.col("q_b"), F.lit(False)).alias("same_questions"), F.coalesce(F.size(F.array_intersect("q_a", "q_b")), F.lit(0)).alias("common"))


#: The share of a question's shingles that the first pass asks for as matches, and questions whose numbers are broadcast at most (16 MB).
EXTRA, FEW = 0.1, 1_000_000


def _shingles(questions: DataFrame, k: int, *keys: str) -> DataFrame:
    """questions(keys, question) -> (keys, g): the 64-bit hashes of each question's shingles; those without words have none and go."""
    words = F.filter(F.split(F.lower("question"), r"\s+"), lambda x: x != "")
    runs = F.transform(F.slice("h", 1, F.size("h") - k + 1), lambda x, i: F.xxhash64(x, *[F.get("h", i + j) for j in range(1, k)]))
    grams = F.when(F.size("h") < k, F.array(F.xxhash64("h"))).otherwise(F.array_distinct(runs))
    # no filter on h or g: it would be pushed below and work the words out again for each place
    return questions.filter(F.col("question").rlike(r"\S")).select(*keys, F.transform(words, lambda x: F.xxhash64(x)).alias("h")).select(*keys, grams.alias("g"))


def _able(questions: DataFrame, threshold: float, k: int) -> DataFrame:
    """(q): of questions(q, question) those that can be near another one.

    Near sets of n shingles share need(n) at least. In the order of hashes the first n - need(n) + m(n) of each then hold m of the smaller one in common, so a set goes on only if so many of its
    first shingles are among the first ones of other sets. A shingle is shuffled once with its question's number, and those behind the first, nearly two in three, never.
    """
    need = lambda n: F.ceil(n * (threshold - 1e-6))
    m = lambda n: F.least(F.floor(n * EXTRA) + 1, need(n))
    n = F.col("n")
    sized = _shingles(questions, k, "q").select("q", "g", F.size("g").alias("n"))
    tokens = sized.select("q", "n", F.explode(F.slice(F.array_sort("g"), 1, (n - need(n) + m(n)).cast("int"))).alias("t"))
    own = Window.partitionBy("t")
    shared = tokens.withColumns({"low": F.min("q").over(own), "high": F.max("q").over(own)}).filter("low <> high")
    # copies of a question say the same
    return shared.groupBy("q", "n").agg(F.count_distinct("t").alias("met")).filter(F.col("met") >= m(need(n))).select("q").distinct()


def _question_shingles(pairs: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows(uid, d), least(d, uid), sets(uid, g, n)): the rows with a question, which a digest stands for, so that texts aren't shuffled; the least uid of each different question;
    and the shingles of those different questions that can be near another one."""
    questions = pairs.filter("question is not null").select("uid", "question")
    d, q = F.unhex(F.sha2("question", 256)).alias("d"), F.xxhash64("question").alias("q")
    rows = materialize(questions.select("uid", d), "questions")
    least = rows.groupBy("d").agg(F.min("uid").alias("uid"))
    able = materialize(_able(questions.select(q, "question"), threshold, k), "able")
    kept = questions.select("*", q).join(F.broadcast(able) if able.count() <= FEW else able, "q", "left_semi").select("uid", d, "question")
    firsts = kept.join(least, ["d", "uid"], "left_semi").groupBy("d", "uid").agg(F.first("question").alias("question"))
    sets = materialize(_shingles(firsts, k, "uid"), "question_shingles").withColumn("n", F.size("g"))
    discard(able)
    return rows, least, sets


def _question_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(t, uid, n): the rarest shingles of each set, of which two sets that are near share one. Those of one question only take the first places of its
    order and go no further than their count."""
    tokens = sets.select("uid", "n", F.explode("g").alias("t"))
    df = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    own = Window.partitionBy("uid")
    shared = tokens.join(df, "t").withColumns({"p": F.row_number().over(own.orderBy("f", "t")), "m": F.count(F.lit(1)).over(own)})
    return shared.filter(F.col("n") - F.col("m") + F.col("p") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("t", "uid", "n")


def _near(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """candidates(uid_a, uid_b) that are near, with jaccard."""
    side = lambda x: sets.select(F.col("uid").alias(f"uid_{x}"), F.col("g").alias(f"g{x}"))
    both = candidates.join(side("a"), "uid_a").join(side("b"), "uid_b").withColumn("common", F.size(F.array_intersect("ga", "gb")))
    j = F.col("common") / (F.size("ga") + F.size("gb") - F.col("common"))
    return both.select("uid_a", "uid_b", F.round(j, 6).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def near_duplicate_questions(pairs: DataFrame, threshold: float = 0.75, k: int = 5) -> DataFrame:
    """(uid_a, uid_b, jaccard) of pairs whose questions share that much of their word shingles, by an equi-join on rare shingles.

    Equal questions are one first, known by the least uid; each other uid of them comes as (least uid, uid, 1.0), so every uid that has an equal or
    near one is in some row. Pairs of different questions are pairs of least uids. A question's prefix in order of frequency must meet a partner's, so common shingles are
    joined only where a question has no rarer ones. All pairs are the result: for large groups of near copies near_duplicate_classes has a row for each question.
    """
    rows, least, sets = _question_shingles(pairs, threshold, k)
    equal = rows.join(least.withColumnRenamed("uid", "uid_a"), "d").filter("uid <> uid_a").select("uid_a", F.col("uid").alias("uid_b"), F.lit(1.0).alias("jaccard")).distinct()
    prefix = _question_prefixes(sets, threshold)
    one = lambda x: prefix.select("t", F.col("uid").alias(f"uid_{x}"), F.col("n").alias(f"n{x}"))
    met = one("a").join(one("b"), "t").filter((F.col("uid_a") < F.col("uid_b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * (threshold - 1e-6)))
    return _near(met.select("uid_a", "uid_b").distinct(), sets, threshold).unionByName(equal)


def near_duplicate_classes(pairs: DataFrame, threshold: float = 0.75, k: int = 5) -> DataFrame:
    """(uid, class, class_size, n_copies, kept): one row for each row of pairs(uid, question) with a question, without a list of pairs.

    class: the least uid that equal and near questions lead to, itself included; class_size: rows of the class; n_copies: rows with the same
    question; kept: uid is the class's least. A question without words is near its equals only. Rows without a question are left out; uids are taken to be
    unique and not null; other columns are ignored, and no rows give no rows.

    Different questions are compared with stars first: those that share a rare shingle, each with the least and then the greatest of them. What a star
    links is one class, and only questions that share a rare shingle and are in different classes after that are compared with each other. So a group of
    near copies costs about its size, and no link between classes is missed.
    """
    rows, least, sets = _question_shingles(pairs, threshold, k)
    prefix = materialize(_question_prefixes(sets, threshold), "prefixes")
    sizes = sets.select("uid", "n")
    links: list[DataFrame] = []
    labels = None

    def found(candidates: DataFrame) -> None:
        nonlocal labels
        close = candidates.filter(F.least("na", "nb") >= F.greatest("na", "nb") * (threshold - 1e-6)).select("uid_a", "uid_b").distinct()
        new = materialize(_near(close, sets, threshold).select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b")), "links")
        links.append(new)
        before, labels = labels, connected_components(reduce(DataFrame.unionByName, links))
        if before is not None:
            discard(before)

    def labelled() -> DataFrame:
        known = labels.select(F.col("node").alias("uid"), "component")
        return prefix.join(known, "uid", "left").withColumn("component", F.coalesce("component", "uid"))

    for hub in (F.min, F.max):
        stars = prefix.groupBy("t").agg(hub("uid").alias("uid_a")).join(sizes.select(F.col("uid").alias("uid_a"), F.col("n").alias("na")), "uid_a")
        rays = prefix if labels is None else labelled()
        met = rays.select("t", F.col("uid").alias("uid_b"), F.col("n").alias("nb"), *([] if labels is None else ["component"])).join(stars, "t").filter("uid_a <> uid_b")
        if labels is not None:
            own = labels.select(F.col("node").alias("uid_a"), F.col("component").alias("of_hub"))
            met = met.join(own, "uid_a", "left").filter(F.coalesce("of_hub", "uid_a") != F.col("component"))
        found(met)
    # shingles whose questions are in one class have nothing left to link
    places = materialize(labelled(), "labelled")
    open_ = places.groupBy("t").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("t")
    rest = places.join(open_, "t", "left_semi")
    one = lambda x: rest.select("t", F.col("uid").alias(f"uid_{x}"), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"))
    found(one("a").join(one("b"), "t").filter("ca < cb"))
    known = least.join(labels.select(F.col("node").alias("uid"), "component"), "uid", "left").select("d", F.coalesce("component", "uid").alias("class"))
    each = rows.join(known, "d")
    copies = each.groupBy("d", "class").agg(F.count(F.lit(1)).alias("n_copies"))
    classes = copies.groupBy("class").agg(F.sum("n_copies").alias("class_size"))
    # the least uid of a class is that of a question's least one, since copies are known by theirs
    out = each.join(copies.select("d", "n_copies"), "d").join(classes, "class")
    out = materialize(out.select("uid", "class", "class_size", "n_copies", (F.col("uid") == F.col("class")).alias("kept")), "classes")
    discard(prefix, places, labels, *links, sets, rows)
    return out


def near_duplicate_rate(pairs: DataFrame, threshold: float = 0.75, k: int = 5) -> DataFrame:
    """(pairs, near_duplicates, share): one row, of all pairs with a question those that have an equal or near one among the others."""
    out = near_duplicate_classes(pairs, threshold, k).agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("class_size") > 1, 1)).alias("near_duplicates"))
    return out.withColumn("share", F.round(F.col("near_duplicates") / F.greatest("pairs", F.lit(1)), 6))


def auto_index(manifest: DataFrame, order: str) -> DataFrame:
    """manifest with index filled: rows without one are numbered from 1 among themselves, in input order; collides tells of equal indices.

    The running number is a sum over ranges of the input order, so the window has a partition for each range, not one for all.
    """
    missing = F.col("index").isNull().cast("int")
    ranged = manifest.withColumn("_range", F.floor(F.col(order) / 10_000))
    before = ranged.groupBy("_range").agg(F.sum(missing).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    here = F.sum(missing).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.join(before.select("_range", "_before"), "_range").withColumn("index", F.coalesce("index", (here + F.coalesce("_before", F.lit(0))).cast("long")))
    return out.withColumn("collides", F.count(F.lit(1)).over(Window.partitionBy("index")) > 1).drop("_range", "_before")


def upsert_run_times(manifest: DataFrame, updates: DataFrame, approaches: list[int]) -> DataFrame:
    """manifest(index, url, language, approachN...) with updates(index, approach, seconds) put in: new columns, changed rows, appended indices."""
    new = updates.groupBy("index").pivot("approach", approaches).agg(F.max("seconds")).select("index", *[F.round(F.col(str(a)), 3).alias(f"_new{a}") for a in approaches])
    old = manifest.withColumns({f"approach{a}": F.lit(None).cast("double") for a in approaches if f"approach{a}" not in manifest.columns})
    out = old.join(new, "index", "full_outer")
    return out.withColumns({f"approach{a}": F.coalesce(f"_new{a}", f"approach{a}") for a in approaches}).drop(*[f"_new{a}" for a in approaches])


def agent_time_rollup(manifest: DataFrame, approaches: list[int]) -> DataFrame:
    """(approach, runs, failed, mean, min, max, total): a time of 0 is a failed run and counts for nothing else."""
    cells = F.array(*[F.struct(F.lit(a).alias("approach"), F.col(f"approach{a}").alias("s")) for a in approaches])
    long = manifest.select(F.explode(cells).alias("c")).select("c.*").filter("s is not null")
    ok = F.when(F.col("s") > 0, F.col("s"))
    return long.groupBy("approach").agg(F.count("s").alias("runs"), F.count_if(F.col("s") == 0).alias("failed"), F.round(F.avg(ok), 6).alias("mean_s"), F.min(ok).alias("min_s"), F.max(ok).alias("max_s"), F.round(F.sum(ok), 3).alias("total_s"))
