"""Chat formatting of reply trees, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, whole

#: The template's control strings, and what stands for their first characters inside texts and roles.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
ESCAPES = (("&", "&amp;"), ("#", "&num;"), ("<", "&lt;"), (":", "&col;"))
LEARNT_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    """No control string can arise in the result; roles lose their colons too."""
    for plain, code in ESCAPES[: None if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: nodes(conv_id, node_id, parent_id, score) -> (conv_id, branch, node_id, depth).

    For each conversation its `branches` paths of the highest total score are chosen, ties to the smaller leaf; branch counts from 1
    and depth from 0 at the root. Ancestors are found by self-joins that double the distance each time, so that a chain of n turns
    takes log2(n) joins; totals double along with them. Only the chosen leaves' paths are then written out, again by doubling.
    A parent that doesn't exist makes its child a root; null scores count 0; nodes on a cycle have no root, and no path.
    (conv_id, node_id) must be unique and not null.
    """
    key = ["conv_id", "node_id"]
    have = nodes.select("conv_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    up = (
        nodes.select(*key, "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
        .join(have, ["conv_id", "parent_id"], "left")
        .select(*key, F.when(F.col("there"), F.col("parent_id")).alias("up"), "total", F.lit(0).cast("long").alias("depth"))
    )
    # after round k, `up` is the ancestor 2 ** k above, `total` sums the scores below it and `depth` counts the steps to it; null: past the root
    state = staged(up.withColumn("depth", F.col("up").isNotNull().cast("long")), "tree")
    jumps, most = [], state.count()
    while (1 << len(jumps)) <= most and not (open_rows := state.filter("up is not null").select(*key, "up")).isEmpty():
        jumps.append(open_rows)
        above = state.select("conv_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        # rows past their root are done: only the others are joined again
        state = staged(
            state.filter("up is not null").join(above, ["conv_id", "up"], "left").select(
                *key, F.col("up2").alias("up"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")
            ).unionByName(state.filter("up is null").select(*key, "up", "total", "depth")),
            "tree",
        )
    rooted = state.filter("up is null")
    leaves = rooted.join(nodes.select("conv_id", F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct(), key, "left_anti")
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "node_id"))).filter(F.col("branch") <= branches)
    paths = staged(ranked.select("conv_id", "branch", "node_id", "depth"), "paths")
    for k in reversed(range(len(jumps))):
        # written, as each round reads it twice: the plan would double with every round
        paths = staged(paths.unionByName(paths.join(jumps[k], key).select("conv_id", "branch", F.col("up").alias("node_id"), (F.col("depth") - (1 << k)).alias("depth"))), "paths")
    return paths


def format_paths(turns: DataFrame, paths: DataFrame) -> DataFrame:
    """One row for each chosen path: conv_id, branch, formatted (the text), and loss_spans: for each turn the start (from 0) and
    the length in code points of its text in `formatted` if it is the assistant's, else null. Texts and roles that are null count as empty."""
    said = turns.select("conv_id", "node_id", whole("role").alias("role"), whole("text").alias("text"))
    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(COLON))
    body = escape(F.col("text"))
    own = F.struct(F.col("depth"), F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("head"), (F.col("role") == LEARNT_ROLE).alias("learnt"))
    rows = paths.join(said, ["conv_id", "node_id"]).select("conv_id", "branch", own.alias("turn")).groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    step = lambda a, t: F.struct(
        (a["at"] + F.length(t["piece"])).alias("at"),
        F.concat(a["spans"], F.array(F.when(t["learnt"], F.struct((a["at"] + t["head"]).alias("start"), (F.length(t["piece"]) - t["head"] - len(END)).alias("length"))))).alias("spans"),
    )
    spans = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")), step, lambda a: a["spans"])
    return rows.select("conv_id", "branch", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns: array of (role, text), parsed from the formatted text alone."""
    pieces = F.filter(F.split("formatted", END), lambda p: F.length(p) > 0)
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), COLON, 1)
    parsed = F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + F.lit(len(HEAD) + len(COLON) + 1))).alias("text")))
    return formatted.withColumn("turns", parsed)


def linear_nodes(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a reply tree in which each row answers the one before it by turn: adds node_id, parent_id
    and score. Equal turns stand in the order of role and text, a null turn first; rows without a conv_id form one conversation, whose
    id is the smallest long."""
    keyed = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("conv_id"), "turn", "role", "text")
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return keyed.withColumn("node_id", F.row_number().over(in_order)).withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(0.0))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold the template's own control strings, formatted and read back."""
    odd = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    nodes = staged(linear_nodes(rows.unionByName(extra)), "turns")
    out = read_back(format_paths(nodes, best_paths(nodes)))
    learnt = F.array_join(F.transform(F.filter("loss_spans", lambda s: s.isNotNull()), lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    return out.select(
        F.when(F.col("conv_id") != -(1 << 63), F.col("conv_id")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
