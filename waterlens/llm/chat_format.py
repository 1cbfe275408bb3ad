"""Chat formatting from reply trees: self-joins enumerate root-to-leaf paths, branches are ranked, paths are formatted.

Only ids travel through the self-joins; ancestors are found by doubling (each round joins the table of ancestors to
itself), so a thread of n messages takes log2(n) rounds. Texts join once, for the chosen paths. No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

# The marks of a turn, and the control strings that are escaped inside roles and texts.
START, END = "<|im_start|>", "<|im_end|>\n"
_TAILS = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS\]|<SYS>>|</SYS>>)"
_CONTROL = r"(<|\[)(\\*)" + _TAILS
_ESCAPED = r"(<|\[)\\(\\*)" + _TAILS


def escape(text: Column) -> Column:
    """Control strings get a backslash after their first character, one more if they have some: `unescape` undoes it."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def threads(conversations: DataFrame) -> DataFrame:
    """Messages (conv_id, msg_id, parent_id, role, text, score) of linear conversations: each turn replies to the one
    before. Turns go by turn, then role and text; null turns come first; null roles and texts are empty."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("msg_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", F.xxhash64("text"), "text")).cast("long"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return rows.select("conv_id", "msg_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, height, score): every message on the path from each leaf up to its root; height counts from
    the leaf. A message whose parent is missing is a root. Messages on or below a cycle of parents have no root and
    belong to no path."""
    ids = cut(messages.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"), "msg_id", "parent_id", "score"))
    deepest = ids.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    node = ids.select("conv", F.col("msg_id").alias("node"), "parent_id", "score")
    known = ids.select("conv", F.col("msg_id").alias("parent_id"))
    up = node.join(known, ["conv", "parent_id"], "left_semi").select("conv", "node", F.col("parent_id").alias("above"))
    leaves = node.join(up.select("conv", F.col("above").alias("node")), ["conv", "node"], "left_anti")
    walk = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    roots = node.join(up, ["conv", "node"], "left_anti").select("conv", "node", F.lit(True).alias("is_root"))
    step = 1
    while step < deepest:
        higher = walk.join(up, ["conv", "node"]).select("conv", "leaf", F.col("above").alias("node"), (F.col("height") + step).alias("height"))
        walk = cut(walk.union(higher))
        step *= 2
        if step < deepest:
            on = up.select("conv", F.col("node").alias("above"), F.col("above").alias("top"))
            up = cut(up.join(on, ["conv", "above"]).select("conv", "node", F.col("top").alias("above")))
    whole = walk.join(roots, ["conv", "node"]).select("conv", "leaf").distinct()
    scores = ids.select("conv", F.col("msg_id").alias("node"), "score")
    return walk.join(whole, ["conv", "leaf"], "left_semi").join(scores, ["conv", "node"])


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The `paths` of each conversation's `branches` best leaves, with their rank: by the mean score of a path's
    messages (null scores count as 0), ties to the smaller leaf."""
    found = paths(messages)
    score = found.groupBy("conv", "leaf").agg((F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*")).alias("path_score"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("path_score"), "leaf"))
    chosen = score.withColumn("branch", rank).where(F.col("branch") <= branches).select("conv", "leaf", "branch", "path_score")
    return found.drop("score").join(chosen, ["conv", "leaf"])


def format_messages(messages: DataFrame, branches: int = 1, learned_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path: conv_id, branch, formatted, loss_spans (start and end of the texts to learn, in code
    points of `formatted`). An empty table gives none; messages with a null msg_id belong to no path."""
    messages = messages.where("msg_id IS NOT NULL")
    chosen = best_paths(messages, branches)
    body = messages.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"), F.col("msg_id").alias("node"), "conv_id",
        F.concat(F.lit(START), _escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role").isin(*learned_roles), F.lit(False)).alias("learned"),
    )
    turns = chosen.join(body, ["conv", "node"])
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(
        Window.partitionBy("conv", "leaf").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, -1)
    ), F.lit(0))
    turns = turns.withColumn("at", before + F.length("head"))
    span = F.when(F.col("learned"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    grouped = turns.groupBy("conv", "leaf").agg(
        F.first("conv_id").alias("conv_id"), F.first("branch").alias("branch"),
        F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )
    return grouped.select("conv_id", "branch", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        _unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
    ))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: two turns whose text holds control strings of common templates."""
    return spark.sql("SELECT -1L conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Rows with a null conv_id form one conversation; repeated rows are turns of their own."""
    found = format_messages(threads(conversations))
    turns = parse(F.col("formatted"))
    return found.withColumn("turns", turns).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
