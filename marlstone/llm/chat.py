"""Chat formatting in budgeted windows, by DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``; in roles and texts each backslash is doubled and ``<|`` becomes ``<\\|``, in roles
a line end becomes a backslash and a line end, so no control string comes from a text and all can be read back.

Prefix sums of turn tokens choose the spans. A window opens at a turn with the system turn (first turn, role system) and as many of
the HISTORY turns before it as fit; what these cost and the prefix sum at the opening give the prefix sum up to which turns are new in
this window, so that all of it stays within the budget. Only a turn that doesn't fit by itself makes a longer window, in which it is the only
new one, without history. Only new assistant turns are under the loss mask, so each counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 2048, 2
#: The registered query's budget: most conversations of the tables are several times as long.
QUERY_BUDGET = 640
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def approximate_tokens(c: Column) -> Column:
    """A token for each four bytes begun, and four for the control strings of a turn."""
    return F.ceil(F.octet_length(c) / 4).cast("long") + 4


def _opened(budget: int, history: int) -> Column:
    """array<struct(start, history, stop)>: the windows of ``t``, turns with places from 0 and prefix sums ``upto``; stop is behind the last new turn."""
    upto = lambda i: F.when(i > 0, F.element_at("upto", F.greatest(i, F.lit(1)))).otherwise(F.lit(0).cast("long"))
    system = F.when(F.col("t")[0]["role"] == "system", F.col("t")[0]["tokens"]).otherwise(F.lit(0).cast("long"))
    leads = F.when(F.col("t")[0]["role"] == "system", 1).otherwise(0)

    def step(acc: Column, i: Column) -> Column:
        head = F.when(i > 0, system).otherwise(F.lit(0).cast("long"))
        fits = F.filter(F.sequence(F.lit(0), F.least(F.lit(history), F.greatest(i - leads, F.lit(0)))), lambda h: head + upto(i + 1) - upto(i - h) <= budget)
        before = F.coalesce(F.array_max(fits), F.lit(0)).cast("int")
        limit = lambda h: F.greatest(upto(i + 1), budget - head + upto(i - h))
        opens = F.transform(F.array(before), lambda h: F.struct(limit(h).cast("long").alias("limit"), F.array_append(acc["opens"], F.struct(i.alias("start"), h.alias("history"))).alias("opens")))[0]
        return F.when(upto(i + 1) <= acc["limit"], acc).otherwise(opens)

    none = F.struct(F.lit(-1).cast("long").alias("limit"), F.array().cast("array<struct<start:int,history:int>>").alias("opens"))
    opens = F.aggregate(F.sequence(F.lit(0), F.size("t") - 1), none, step, lambda acc: acc["opens"])
    return F.transform(F.array(opens), lambda o: F.transform(o, lambda w, k: F.struct(w["start"].alias("start"), w["history"].alias("history"), F.coalesce(F.try_element_at(o, k + 2)["start"], F.size("t")).alias("stop"))))[0]


def format_windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """rows(conv_id, turn, role, text, ...) -> (conv_id, window, tokens, formatted, turns): one row for each window.

    tokens: column of rows with the tokens of each written turn; None: about a token for four bytes. In the result, the window's sum.
    turns: array of (kind, start, length, loss), start and length in code points of ``formatted``: kind ``system`` or ``history`` for repeated
    turns, ``new`` for those that are here for the first time; loss is true for new assistant turns only, and start and length then hold the escaped text alone.
    Rows are taken by turn, ties and null turns (first) by role and text; repeated rows are turns of their own. Null texts and roles count as empty,
    a null conv_id is a conversation. Empty texts make empty turns. Other columns are ignored; no rows give no windows.
    A conversation is one row while its windows are chosen.
    """
    given = F.col(tokens).cast("long") if tokens else F.lit(None).cast("long")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), given.alias("given"))
    rows = rows.withColumn("lead", F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n")))
    rows = rows.withColumn("line", F.concat("lead", escaped(F.col("text")), F.lit(END)))
    rows = rows.withColumn("tokens", F.coalesce("given", approximate_tokens(F.col("line"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.struct("turn", "role", "text", "tokens", "upto", F.length("lead").alias("lead"), "line")
    whole = rows.withColumn("upto", F.sum("tokens").over(order)).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    whole = whole.withColumn("upto", F.col("t.upto"))
    windows = whole.withColumn("opened", _opened(budget, history)).select("conv_id", "t", F.posexplode("opened").alias("window", "w"))

    def shown(kind: str, first: Column, count: Column) -> Column:
        return F.transform(F.slice("t", first + 1, count), lambda x: F.struct(F.lit(kind).alias("kind"), x["tokens"].alias("tokens"), x["line"].alias("line"), x["lead"].alias("lead"), (F.lit(kind == "new") & (x["role"] == "assistant")).alias("loss")))

    head = F.when((F.col("w.start") > 0) & (F.col("t")[0]["role"] == "system"), 1).otherwise(0)
    parts = F.concat(shown("system", F.lit(0), head), shown("history", F.col("w.start") - F.col("w.history"), F.col("w.history")), shown("new", F.col("w.start"), F.col("w.stop") - F.col("w.start")))
    windows = windows.select("conv_id", F.col("window").cast("long").alias("window"), parts.alias("t"))
    # starts of turns by a running sum of lengths, kept as a fold over the turns of a window
    starts = F.aggregate("t", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x["line"])))
    turns = F.zip_with("t", F.slice(starts, 1, F.size("t")), lambda x, at: F.struct(
        x["kind"].alias("kind"), (at + F.when(x["loss"], x["lead"]).otherwise(0)).alias("start"),
        (F.length(x["line"]) - F.when(x["loss"], x["lead"] + len(END)).otherwise(0)).alias("length"), x["loss"].alias("loss"),
    ))
    return windows.select("conv_id", "window", F.aggregate("t.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"), F.array_join(F.col("t.line"), "").alias("formatted"), turns.alias("turns"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, largest_window) from formatted windows alone."""
    cut = F.slice(F.split(F.col("formatted"), r"<\|im_end\|>\n"), 1, F.size("turns"))
    fresh = F.filter(F.arrays_zip(cut.alias("block"), F.col("turns.kind").alias("kind")), lambda x: x["kind"] == "new")["block"]
    # possessive, so that a role of any length takes no stack
    role_end = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"
    read = F.transform(fresh, lambda x: F.concat(unescaped(F.regexp_extract(x, role_end, 1)), F.lit("\n"), unescaped(F.regexp_extract(x, role_end, 2)), F.lit("\n")))
    loss = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: unescaped(F.substring(F.col("formatted"), x["start"] + 1, x["length"])))
    each = windows.select("conv_id", F.struct("window", F.size(read).alias("n"), F.array_join(read, "").alias("read"), F.array_join(loss, "").alias("loss")).alias("w"), F.length("formatted").cast("long").alias("chars"), "tokens")
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.max("tokens").alias("largest_window"))
    text, masked = F.array_join(F.col("w.read"), ""), F.array_join(F.col("w.loss"), "")
    return whole.select(
        "conv_id", F.aggregate("w.n", F.lit(0), lambda a, x: a + x).cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows", "largest_window",
    )


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.sql("select -1L as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role), '<|im_end|><|im_start|>assistant ok' as text")
    return read_back(format_windows(rows.unionByName(probe), QUERY_BUDGET))
