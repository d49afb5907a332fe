"""Chat formatting over reply trees, in DataFrame functions alone.

A row is a message with an id, the id of the message it answers, a role, a text and a score. Iterative
self-joins climb from every message to its root, twice as far in each round: they give its depth, the sum
of scores and the length of the formatted text above it. Trees whose messages have all arrived leave the
rounds. The leaves of a tree are ranked by the sum of scores on their path, and the best `branches` are
chosen. Their paths are enumerated by going back through the rounds' jumps, longest first: each doubles the
messages of a path that are known. So a path of depth d takes about 2 log2(d) joins, and only chosen paths
are ever listed.

A chosen path is one conversation: BEGIN role MIDDLE text END for each message, and the loss mask as spans
of bytes of the UTF-8 text, one for each text of the role to be learned (without marks). Control strings in
roles and texts get a backslash behind their first character, and backslashes are doubled first, so that no
control string is left in them and taking away one backslash of each pair (one before any character)
restores them.

Cases: a null text or role is an empty one, a null score 0; a message whose parent is null or doesn't exist
is a root; messages without an id are leaves; ids are compared as text. Rows with equal tree and id are one
message, the first by parent, role, text and score. Messages on a circle, or below one, have no root and
are on no path. A null tree is a tree. Equal sums: the leaf with the lesser id. An empty table gives no
rows. A conversation is one string, so it must stay below 2 GB.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripfold.llm.common import stored

BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat models read as control strings.
CONTROLS = (BEGIN, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
_FIRST = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_FIRST})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def messages(rows: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str) -> DataFrame:
    """_tree, _node, _parent, _score, and the formatted message: _piece, with the place of its text."""
    given = rows.select(
        F.col(tree).alias("_tree"), F.col(node).cast("string").alias("_node"), F.col(parent).cast("string").alias("_parent"), F.coalesce(role, F.lit("")).alias("_role"),
        F.coalesce(text, F.lit("")).alias("_text"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_score"),
    )
    nameless = F.concat(F.lit("without an id "), F.xxhash64("_parent", "_role", "_text", "_score").cast("string"))
    one = given.withColumn("_node", F.coalesce("_node", nameless)).groupBy("_tree", "_node").agg(F.min(F.struct("_parent", "_role", "_text", "_score")).alias("_m"))
    head, body = F.concat(F.lit(BEGIN), escaped(F.col("_m._role")), F.lit(MIDDLE)).alias("_head"), escaped(F.col("_m._text")).alias("_body")
    one = one.select("_tree", "_node", F.col("_m._parent").alias("_parent"), F.col("_m._score").alias("_score"), F.col("_m._role").alias("_role"), head, body)
    return one.select(
        "_tree", "_node", "_parent", "_score", "_role", F.concat("_head", "_body", F.lit(END)).alias("_piece"),
        F.octet_length("_head").cast("long").alias("_from"), F.octet_length("_body").cast("long").alias("_long"),
    )


def _same(a: str, b: str, at: str, to: str) -> Column:
    return F.col(f"{a}._tree").eqNullSafe(F.col(f"{b}._tree")) & (F.col(f"{a}.{at}") == F.col(f"{b}.{to}"))


def climbed(held: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """For each message with a root its _deep, _sum and _bytes up to the root, itself included; and for each
    round the jumps (_node to _up) that it began with. Sums are over the messages before _up."""
    bones = held.select("_tree", "_node", "_parent", F.col("_score").alias("_sum"), F.octet_length("_piece").cast("long").alias("_bytes"))
    there = bones.select("_tree", "_node")
    open_ = stored(
        bones.alias("b").join(there.alias("p"), _same("b", "p", "_parent", "_node"), "left")
        .select("b._tree", "b._node", F.col("p._node").alias("_up"), F.lit(1).cast("long").alias("_deep"), "b._sum", "b._bytes")
    )
    arrived, jumps, reach, most = [], [], 1, open_.count()
    while True:
        going = open_.where("_up is not null")
        trees = going.select("_tree").distinct()
        arrived.append(open_.alias("o").join(trees.alias("t"), F.col("o._tree").eqNullSafe(F.col("t._tree")), "left_anti"))
        if going.isEmpty():
            break
        if reach > most:  # further than any path is long: only circles are left, and trees that have one
            arrived.append(open_.where("_up is null"))
            break
        open_ = stored(open_.alias("o").join(trees.alias("t"), F.col("o._tree").eqNullSafe(F.col("t._tree")), "left_semi"))
        jumps.append(open_.where("_up is not null").select("_tree", "_node", "_up"))
        add = lambda c: (F.col(f"o.{c}") + F.coalesce(F.col(f"a.{c}"), F.lit(0))).alias(c)
        open_ = stored(
            open_.alias("o").join(open_.alias("a"), _same("o", "a", "_up", "_node"), "left")
            .select("o._tree", "o._node", "a._up", add("_deep"), add("_sum"), add("_bytes"))
        )
        reach *= 2
    done = arrived[0]
    for more in arrived[1:]:
        done = done.unionByName(more)
    return done.drop("_up"), jumps


def reply_paths(rows: DataFrame, tree="tree", node="node", parent="parent", role="role", text="text", score="score", branches: int = 1, learned: str = LEARNED) -> DataFrame:
    """tree, leaf (id as text), rank, score (sum on the path), n_turns, formatted and loss_spans (array of
    start and end, in bytes) for each of the best `branches` root-to-leaf paths of each tree."""
    held = stored(messages(rows, tree, node, parent, role, text, score))
    depth, jumps = climbed(held)
    depth = stored(depth)
    parents = held.select("_tree", "_parent").where("_parent is not null and _parent <> _node").distinct()
    leaves = depth.alias("d").join(parents.alias("p"), _same("d", "p", "_node", "_parent"), "left_anti")
    best = Window.partitionBy("_tree").orderBy(F.desc("_sum"), "_node")
    chosen = stored(leaves.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= branches).select("_tree", F.col("_node").alias("_leaf"), "_rank", "_sum"))
    path = chosen.select("_tree", "_leaf", F.col("_leaf").alias("_at"))
    for jump in reversed(jumps):
        path = (
            path.alias("p").join(jump.alias("j"), _same("p", "j", "_at", "_node"), "left")
            .select("p._tree", "p._leaf", F.explode(F.array_compact(F.array("p._at", "j._up"))).alias("_at"))
        )
    begins = (F.col("d._bytes") - F.octet_length("h._piece")).alias("begins")
    turns = (
        path.alias("p").join(held.alias("h"), _same("p", "h", "_at", "_node")).join(depth.alias("d"), _same("p", "d", "_at", "_node"))
        .select("p._tree", "p._leaf", F.struct("d._deep", begins, F.col("h._piece").alias("piece"), (F.col("h._role") == learned).alias("loss"), F.col("h._from").alias("at"), F.col("h._long").alias("long")).alias("_t"))
    )
    whole = turns.groupBy("_tree", "_leaf").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    span = lambda t: F.struct((t["begins"] + t["at"]).alias("start"), (t["begins"] + t["at"] + t["long"]).alias("end"))
    return (
        whole.alias("w").join(chosen.alias("c"), _same("w", "c", "_leaf", "_leaf"))
        .select(
            F.col("w._tree").alias("tree"), F.col("w._leaf").alias("leaf"), F.col("c._rank").alias("rank"), F.col("c._sum").alias("score"), F.size("w._turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("w._turns", lambda t: t["piece"]), "").alias("formatted"), F.transform(F.filter("w._turns", lambda t: t["loss"]), span).alias("loss_spans"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The given columns and those that the text and its mask give: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = F.transform(F.slice(F.split("formatted", re.escape(BEGIN)), 2, 1 << 30), lambda t: F.split(t, f"{re.escape(MIDDLE)}|{re.escape(END)}"))
    line = lambda p: F.concat(unescaped(p[0]), F.lit("\n"), unescaped(p[1]), F.lit("\n"))
    # the bytes are taken from the text once, whatever the number of spans
    cut = lambda b: F.transform("loss_spans", lambda s: unescaped(F.substring(b, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")))
    loss = F.array_join(F.element_at(F.transform(F.array(F.col("formatted").cast("binary")), cut), 1), "")
    got = formatted.withColumns({"_parts": parts, "_loss": loss})
    return got.withColumns(
        {
            "n_turns": F.size("_parts").cast("long"), "turns_sha256": F.sha2(F.array_join(F.transform("_parts", line), ""), 256), "loss_chars": F.length("_loss").cast("long"),
            "loss_sha256": F.sha2("_loss", 256), "formatted_chars": F.length("formatted").cast("long"),
        }
    ).drop("_parts", "_loss")


def as_trees(turns: DataFrame) -> DataFrame:
    """Conversations as trees: each row answers the one before it, by turn (ties: by role, then text)."""
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    nodes = turns.select("tree", "turn", "role", "text").withColumn("node", place)
    return nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").alias("score"))


def with_control_strings(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user's and an assistant's turn that say what ends and begins turns elsewhere."""
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.struct(F.lit(True).alias("added"), F.lit(-1).cast("long").alias("conv_id")).alias("tree"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))


def op12_reply_trees(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = rows.select(F.struct(F.lit(False).alias("added"), F.col("conv_id").cast("long").alias("conv_id")).alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text")
    out = stored(reply_paths(as_trees(turns.unionByName(with_control_strings(spark)))))
    return read_back(out).select(F.col("tree.conv_id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
