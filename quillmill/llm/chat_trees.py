"""Chat formatting of reply trees, in DataFrame operations only.

Messages point to the message they answer. Root-to-leaf paths are found by iterative self-joins: a leaf starts with
itself, and every round the ancestors found so far are joined with a table of ancestors 2^k steps up, which is then
joined with itself, so that depth d takes about log2(d) rounds. Paths are ranked by the sum of their messages' scores,
and each chosen path is written as one conversation.

Template: every turn is <turn ROLE>TEXT</turn> and a line end. Inside ROLE and TEXT a backslash becomes \\b, a < becomes
\\l and a > becomes \\g, so that < and > stand at marks only, and the way back is the same whatever a text says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

OPEN, CLOSE = "<turn ", "</turn>\n"
#: In the order of escaping.
PAIRS = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escaped(text: Column) -> Column:
    for plain, pair in PAIRS:
        text = F.replace(text, F.lit(plain), F.lit(pair))
    return text


def unescaped(text: Column) -> Column:
    # The backslash comes back last: in escaped text it always opens a pair, so no step meets a pair that another made.
    for plain, pair in reversed(PAIRS):
        text = F.replace(text, F.lit(pair), F.lit(plain))
    return text


def root_paths(messages: DataFrame) -> DataFrame:
    """leaf, node, up: every message on the path from each leaf to its root; up counts the steps from the leaf.

    messages: node and parent, node distinct and not null. A parent that is not there makes its child a root. Messages
    on a cycle, or that answer one, have no root and are on no path.
    """
    nodes = messages.select("node", "parent")
    known = nodes.select(F.col("node").alias("p"))
    jumps = [cut(nodes.join(known, F.col("parent") == F.col("p")).select("node", F.col("p").alias("above")))]
    total = messages.count()
    while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= total:
        second = jumps[-1].select(F.col("node").alias("n2"), F.col("above").alias("a2"))
        jumps.append(cut(jumps[-1].join(second, F.col("above") == F.col("n2")).select("node", F.col("a2").alias("above"))))
    answered = jumps[0].select(F.col("above").alias("node")).distinct()
    # Who has an ancestor further up than there are messages is on a cycle or below one.
    endless = jumps[-1].select("node")
    leaves = nodes.join(answered, "node", "left_anti").join(endless, "node", "left_anti")
    paths = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps[:-1]):
        added = paths.join(jump, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = cut(paths.unionByName(added))
    return paths


def chosen_paths(messages: DataFrame, per_conversation: int = 1) -> DataFrame:
    """leaf, node, position, branch: the paths of highest score of each conversation, their messages in order from 0.

    messages: conv_id, node, parent, score (null counts as 0). Ties go to the path whose leaf sorts first. per_conversation = 0 takes all.
    """
    paths = root_paths(messages)
    scored = paths.join(messages.select("node", "conv_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "node")
    totals = scored.groupBy("conv_id", "leaf").agg(F.sum("score").alias("total"), F.max("up").alias("depth"))
    ranks = totals.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "leaf")))
    if per_conversation:
        ranks = ranks.where(F.col("branch") <= per_conversation)
    return paths.join(ranks.select("leaf", "depth", "branch"), "leaf").select("leaf", "node", (F.col("depth") - F.col("up")).alias("position"), "branch")


def formatted(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, formatted, loss_spans: one conversation for each value of the keys.

    turns: keys, position, role, text. loss_spans lists (start, length) of the assistant texts as they stand in the
    formatted string, in code points from 0. Null roles and texts count as empty. A conversation becomes one string, so
    it has to fit a row; nothing else gathers.
    """
    role, text = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    learned = F.coalesce(F.col("role"), F.lit("")) == "assistant"
    turn = F.struct("position", F.concat(F.lit(OPEN), role, F.lit(">"), text, F.lit(CLOSE)).alias("out"), (F.length(role) + len(OPEN) + 1).alias("lead"), F.length(text).alias("n"), learned.alias("learned"))
    gathered = turns.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # The running length goes through the array once: (end so far, spans so far).
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["lead"] + t["n"] + len(CLOSE)).alias("at"),
            F.when(t["learned"], F.concat(a["spans"], F.array(F.struct((a["at"] + t["lead"]).alias("start"), t["n"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return gathered.select(*keys, F.concat_ws("", F.transform("turns", lambda t: t["out"])).alias("formatted"), walk.alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """conversations with turns (role and text of each, unescaped) and loss_text, both taken from `formatted` alone
    and, for the loss, from the spans. Turns are cut at the marks, which no text can contain."""
    parts = F.filter(F.split("formatted", OPEN), lambda x: x != "")
    body = lambda x: F.substring_index(x, "</turn>", 1)
    turn = lambda x: F.struct(
        unescaped(F.substring_index(body(x), ">", 1)).alias("role"),
        unescaped(F.substr(body(x), F.length(F.substring_index(body(x), ">", 1)) + 2, F.length(body(x)))).alias("text"),
    )
    loss = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s["start"] + 1, s["length"]))
    return conversations.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", unescaped(F.concat_ws("", loss)))


def threads(conversations: DataFrame) -> DataFrame:
    """conv_id, node, parent, score, role, text of a table of conv_id, turn, role, text: each turn answers the one before.

    Turns of one number, and repeated rows, stand in the order of role and text. A null turn comes first. Rows without
    conv_id are one conversation. A turn scores the same wherever it stands, so the longest branch wins.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("i", F.row_number().over(order))
    node = lambda i: F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), i.alias("i"))
    return numbered.select("conv_id", node(F.col("i")).alias("node"), F.when(F.col("i") > 1, node(F.col("i") - 1)).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def format_trees(messages: DataFrame, per_conversation: int = 1) -> DataFrame:
    """conv_id, branch, formatted, loss_spans: the chosen paths of each conversation as strings.

    messages: conv_id, node, parent, score, role, text. More columns are ignored. An empty table gives an empty result.
    """
    messages = cut(messages.select("conv_id", "node", "parent", "score", "role", "text"))
    turns = chosen_paths(messages, per_conversation).join(messages.select("node", "conv_id", "role", "text"), "node")
    return formatted(turns, ["conv_id", "branch"])


def op8_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    read = read_back(format_trees(threads(conversations)))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _oracle() -> str:
    esc = lambda c: rf"replace(replace(replace({c}, '\', '\b'), '<', '\l'), '>', '\g')"
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(i))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
sum({len(OPEN) + 1 + len(CLOSE)} + length({esc("r")}) + length({esc("t")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


QUERIES = {"op8_chat_trees": op8_chat_trees}
ORACLES = {"op8_chat_trees": _oracle()}
