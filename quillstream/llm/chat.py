"""Chat formatting of reply trees (DataFrame functions only).

Template, one line per turn, in path order:

    system      [SYS] text [/SYS]
    user        [INST] text [/INST]
    assistant   <s> text </s>
    other       [ROLE] name [TEXT] text [/ROLE]

Control strings inside texts and role names get a backslash before them, and backslashes that stand directly before one are
doubled, so every text can be restored.  A template's own mark always follows a space, never a
backslash, so the marks of a formatted conversation can be found without knowing its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

_CONTROL = r"(</?s>|\[/?(?:INST|SYS|ROLE|TEXT)\])"
_OPEN = {"system": "[SYS] ", "user": "[INST] ", "assistant": "<s> "}
_CLOSE = {"system": " [/SYS]", "user": " [/INST]", "assistant": " </s>"}
_TURN = r"(?s)(?:\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE\] .*? \[TEXT\] .*? \[/ROLE\])\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + _CONTROL, r"$1$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)\1\\" + _CONTROL, "$1$2")


def _turn(role: Column, text: Column) -> Column:
    body = escaped(text)
    other = F.concat(F.lit("[ROLE] "), escaped(role), F.lit(" [TEXT] "), body, F.lit(" [/ROLE]\n"))
    out = None
    for name in _OPEN:
        known = F.concat(F.lit(_OPEN[name]), body, F.lit(_CLOSE[name] + "\n"))
        out = F.when(role == name, known) if out is None else out.when(role == name, known)
    return out.otherwise(other)


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """Every root-to-leaf path of every reply tree, a row per message: ``tree_, leaf_, id_, up_`` (steps above the leaf).

    ``messages`` has non-null ``tree_, id_`` and nullable ``parent_``.  A self-join of the jumps of 2^k steps with themselves gives
    those of 2^(k+1) steps, until no message is that deep.  Starting from the leaves, the jumps are then taken from the longest
    to the shortest: each round adds the messages one such jump above all that are reached, so every ancestor is reached
    once.  Rounds are the logarithm of the depth, rows those of the result.  A message whose parent is missing is a root;
    messages on a cycle of replies, and below one, have no root and are on no path.
    """
    ids = messages.select("tree_", F.col("id_").alias("parent_"))
    jump = messages.select("tree_", "id_", "parent_").join(ids, ["tree_", "parent_"]).select("tree_", "id_", F.col("parent_").alias("to_"))
    jump = written(jump, "chat-jumps")
    replied = messages.select("tree_", F.col("parent_").alias("id_")).where("id_ is not null").distinct()
    leaves = messages.select("tree_", "id_").join(replied, ["tree_", "id_"], "left_anti")
    most, jumps = messages.count(), []
    while not jump.isEmpty():
        if 1 << len(jumps) > most:
            leaves = leaves.join(jump.select("tree_", "id_"), ["tree_", "id_"], "left_anti")  # below a cycle
            break
        jumps.append(jump)
        on = jump.select("tree_", F.col("id_").alias("to_"), F.col("to_").alias("next_"))
        jump = written(jump.join(on, ["tree_", "to_"]).select("tree_", "id_", F.col("next_").alias("to_")), "chat-jumps")
    reached = leaves.select("tree_", F.col("id_").alias("leaf_"), "id_", F.lit(0).cast("long").alias("up_"))
    for k in range(len(jumps) - 1, -1, -1):
        reached = written(reached, "chat-paths")
        above = reached.join(jumps[k], ["tree_", "id_"]).select("tree_", "leaf_", F.col("to_").alias("id_"), (F.col("up_") + (1 << k)).alias("up_"))
        reached = reached.unionByName(above)
    return reached


def format_reply_trees(
    messages: DataFrame,
    *,
    tree_col: str,
    id_col: str,
    parent_col: str,
    role_col: str = "role",
    text_col: str = "text",
    score_col: str | None = None,
    branches: int | None = 1,
) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree (None: all), each as one formatted conversation.

    Branches rank by the sum of their messages' scores, ties by the smaller leaf id.  Returns ``tree, leaf_id, branch (from
    1), score, n_turns, formatted, loss_spans`` (array of start and length in code points of the assistant texts inside
    ``formatted``).  Null texts and roles count as empty; a null tree is a tree of its own; rows with a null
    id are not part of a tree; of rows that repeat an id, the one with the smallest parent, role and text is used; an
    empty table gives no rows.  Other columns are ignored.
    """
    kind = dict(messages.dtypes)[tree_col]
    rows = messages.select(
        F.struct(F.col(tree_col).isNull().alias("none"), F.col(tree_col).alias("key")).alias("tree_"),
        F.col(id_col).cast("long").alias("id_"),
        F.col(parent_col).cast("long").alias("parent_"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role_"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"),
        (F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)).alias("score_"),
    ).where("id_ is not null")
    tree_key = F.concat(F.col("tree_.none").cast("string"), F.lit("|"), F.coalesce(F.col("tree_.key").cast("string"), F.lit("")))
    rows = rows.withColumn("tree_", tree_key)
    first = F.min(F.struct("parent_", "role_", "text_", "score_"))
    rows = written(rows.groupBy("tree_", "id_").agg(first.alias("m_")).select("tree_", "id_", "m_.*"), "chat-rows")
    paths = written(root_to_leaf_paths(rows.select("tree_", "id_", "parent_")), "chat-paths")
    scores = paths.join(rows.select("tree_", "id_", "score_"), ["tree_", "id_"]).groupBy("tree_", "leaf_").agg(F.sum("score_").alias("score"))
    ranked = scores.withColumn("branch", F.row_number().over(Window.partitionBy("tree_").orderBy(F.desc("score"), "leaf_")))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    turns = (
        paths.join(ranked, ["tree_", "leaf_"])
        .join(rows.select("tree_", "id_", "role_", "text_"), ["tree_", "id_"])
        .select("tree_", "leaf_", "branch", "score", (-F.col("up_")).alias("pos_"), "role_", _turn(F.col("role_"), F.col("text_")).alias("turn_"))
    )
    lines = turns.groupBy("tree_", "leaf_", "branch", "score").agg(
        F.array_sort(F.collect_list(F.struct("pos_", (F.col("role_") == "assistant").alias("loss_"), "turn_"))).alias("t_")
    )
    spans = F.aggregate(
        "t_",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["turn_"])).alias("at"),
            F.when(
                t["loss_"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + 4).alias("start"), (F.length(t["turn_"]) - 10).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    key = F.substring_index("tree_", "|", 1)
    rest = F.expr("substring(tree_, instr(tree_, '|') + 1)")
    return lines.select(
        F.when(key == "true", F.lit(None)).otherwise(rest).cast(kind).alias("tree"),
        F.col("leaf_").alias("leaf_id"),
        "branch",
        "score",
        F.size("t_").cast("long").alias("n_turns"),
        F.array_join(F.transform("t_", lambda t: t["turn_"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation: array of struct<role, text>."""

    def one(turn: Column) -> Column:
        out = None
        for name, mark in _OPEN.items():
            size = len(mark) + len(_CLOSE[name]) + 1
            inner = F.substring(turn, F.lit(len(mark) + 1), F.length(turn) - size)
            this = F.struct(F.lit(name).alias("role"), unescaped(inner).alias("text"))
            out = F.when(turn.startswith(mark), this) if out is None else out.when(turn.startswith(mark), this)
        name = F.regexp_extract(turn, r"(?s)^\[ROLE\] (.*?) \[TEXT\] (.*) \[/ROLE\]\n$", 1)
        text = F.regexp_extract(turn, r"(?s)^\[ROLE\] (.*?) \[TEXT\] (.*) \[/ROLE\]\n$", 2)
        return out.otherwise(F.struct(unescaped(name).alias("role"), unescaped(text).alias("text")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, plus conversation -1, formatted and read back.

    A turn replies to the turn before it, so each conversation is a tree with one branch.  Turns are numbered by turn,
    role and text, so repeated rows stay turns of their own.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    mark = "</s>[INST] ok [/INST]"
    planted = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(mark).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t"),
    ).select("conv_id", "t.*")
    every = rows.unionByName(planted)
    numbered = every.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    numbered = numbered.withColumn("reply_to", F.when(F.col("n") > 1, F.col("n") - 1))
    chats = format_reply_trees(numbered, tree_col="conv_id", id_col="n", parent_col="reply_to", branches=None)
    back = chats.withColumn("turns", read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    loss = F.array_join(masked, "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
