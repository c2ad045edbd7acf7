"""Reply trees to formatted conversations, with DataFrame functions only.

Nodes answer a parent.  Pointer jumping (each node joined to the node it points at, so paths double every round) gives every
node its root, depth and summed score in as many self-joins as the depth has binary digits; the jump tables then spread each
chosen leaf over its path in as many joins again.  A leaf's branch is scored by the mean score of its path; the best
``branches`` of each tree are formatted.

Format: ``<|im_start|>role`` newline text ``<|im_end|>`` newline for each turn.  ``&``, ``<`` and ``[`` in roles and texts become character
references, newlines in roles too, so no text can hold a control string of this or of bracketed templates; reading back
undoes it.  The loss mask is a list of stretches (begin, length in code points) over the texts of assistants.

Defined cases: null texts and roles are empty; a parent that isn't there makes its child a root; nodes on a cycle have no root
and are in no conversation; of rows with one node id in a conversation the least (role, text) counts; null conversation ids
are one conversation of null id; a tie between branches goes to the least leaf id; equal rows of a list of turns are turns each;
texts of any length work, one conversation with all its turns must fit a row; an empty table gives an empty result; other columns,
whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Fixed values of the format: what is escaped and how, in this order; reading back goes the other way.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]


def escaped(text: Column, role: bool = False) -> Column:
    for raw, safe in ESCAPES + [("\n", "&#10;")] * role:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for raw, safe in reversed(ESCAPES + [("\n", "&#10;")] * role):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def from_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Nodes of conversations that are lists of turns: each turn answers the one before."""
    order = Window.partitionBy(id_col).orderBy(F.col(turn_col).asc_nulls_first(), "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.select(F.col(id_col).alias("conv"), node.alias("node"), "role", "text").select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, leaf, turns) of each chosen branch of ``nodes`` (conv, node, parent, role, text, score); turns: (depth, role, text) from the root."""
    clear = nodes.select("conv", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    clear = clear.groupBy("conv", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("x")).select("conv", "node", "x.*")
    ids = clear.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    start = clear.join(ids, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n")), "left")
    state = stored(start.select("conv", "node", F.col("n").alias("up"), F.when(F.col("n").isNull(), F.col("node")).otherwise(F.col("n")).alias("top"), F.col("n").isNotNull().cast("long").alias("depth"), "score"), "jumps")
    jumps, most = [], state.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    while 1 << len(jumps) < max(2, most) and not state.where("up is not null").isEmpty():
        jumps.append(state.where("up is not null").select(F.col("conv").alias("c"), F.col("node").alias("n"), "up"))
        next_ = state.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        rest = state.where("up is null")  # these have their root
        joined = state.where("up is not null").join(next_, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n")), "left")
        state = stored(rest.unionByName(joined.select("conv", "node", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"))), "jumps")
    rooted = state.where("up is null")
    parents = start.where("n is not null").select(F.col("conv").alias("c"), "n").distinct()
    leaves = rooted.join(parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")
    order = Window.partitionBy("conv", "top").orderBy((F.col("score") / (F.col("depth") + 1)).desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).select("conv", F.col("node").alias("leaf"), "node")
    on_path = stored(chosen, "paths")
    for jump in jumps:
        ahead = on_path.join(jump, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv", "leaf", F.col("up").alias("node"))
        on_path = stored(on_path.unionByName(ahead), "paths")
    texts = clear.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text")
    depth = rooted.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "depth")
    full = on_path.join(texts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).join(depth, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")))
    return full.groupBy("conv", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))


def formatted(chats: DataFrame) -> DataFrame:
    """``chats`` with ``formatted`` and ``loss_mask``, an array of (begin, length) in code points."""
    turn = lambda t: F.concat(F.lit(BEGIN), escaped(t["role"], True), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))
    head = lambda t: F.lit(len(BEGIN) + 1) + F.length(escaped(t["role"], True))
    empty = F.lit(None).cast("array<struct<begin:int,length:int>>")
    step = lambda a, t: F.struct(
        (a["at"] + head(t) + F.length(escaped(t["text"])) + F.lit(len(END) + 1)).cast("int").alias("at"),
        F.when(t["role"] == "assistant", F.concat(a["mask"], F.array(F.struct((a["at"] + head(t)).cast("int").alias("begin"), F.length(escaped(t["text"])).cast("int").alias("length"))))).otherwise(a["mask"]).alias("mask"),
    )
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.coalesce(empty, F.array().cast("array<struct<begin:int,length:int>>")).alias("mask"))
    return chats.withColumn("formatted", F.concat_ws("", F.transform("turns", turn))).withColumn("loss_mask", F.aggregate("turns", zero, step, lambda a: a["mask"]))


def read_back(chats: DataFrame) -> DataFrame:
    """Turns (role, text) and the text under the loss mask, from ``formatted`` and ``loss_mask`` alone."""
    cut = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    turns = F.transform(cut, lambda x: F.struct(unescaped(F.substr(x, F.lit(len(BEGIN) + 1), F.locate("\n", x) - len(BEGIN) - 1), True).alias("role"), unescaped(F.substr(x, F.locate("\n", x) + 1)).alias("text")))
    loss = F.concat_ws("", F.transform("loss_mask", lambda m: unescaped(F.substr(F.col("formatted"), m["begin"] + 1, m["length"]))))
    return chats.withColumn("read_turns", turns).withColumn("loss_text", loss)


def digest(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text), computed from what was formatted."""
    out = read_back(formatted(conversations(from_turns(rows))).select("conv", "formatted", "loss_mask"))
    told = F.concat_ws("", F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        F.col("conv").alias("conv_id"), F.size("read_turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
