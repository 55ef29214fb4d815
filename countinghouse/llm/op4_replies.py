"""Chat formatting of reply trees.

Messages (tree, node, parent, role, text, score) form trees. Self-joins double
the distance that every node looks up its tree, so a tree of depth d takes
log2(d) rounds, and a row a node until it has reached its root; they give each leaf its branch's
length and score. The best branches of a tree are chosen, the same jumps taken
backwards enumerate their nodes from leaf to root, and each chosen path becomes
one conversation.

Template: each turn is `<s>[role]`, a line end, the text, `</s>` and a line
end. In roles and texts `&`, `<`, `[` and `]` are written as `&amp;`, `&lt;`,
`&lsqb;` and `&rsqb;`, so nothing inside a text reads as a mark, and undoing
the four in the opposite order gives the text back. loss_spans are the places
(start, length in code points) of assistant texts.

Native: DataFrame functions only. Texts are moved once, to their conversation.

Defined results: a null text or role is empty; a null score is 0; a parent that
doesn't exist makes a root; nodes on a cycle, or below one, lie on no path from
a root and yield none; ties go to the longer branch, then to the smaller leaf;
a null tree id is a tree of its own; a repeated (tree, node) makes its branches
repeat, so number the nodes first, as the query does with rows of one turn; an
empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))
TURN_END = "</s>\n"


def escape(text: Column) -> Column:
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jumps and reached roots.

    The k-th jump has, for each node that lies 2**k or more below its root, its 2**k-th ancestor, with length and score of
    the stretch below that. A node that has reached its root leaves the joins; its whole path's length and score are in
    the second result.
    """
    parent = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    step = nodes.join(parent, nodes["tree"].eqNullSafe(parent["t"]) & (nodes["parent"] == parent["n"]), "left")
    step = cut(step.select("tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("length"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    jumps, left = [], -1
    while True:
        below, rooted = step.where("up IS NOT NULL"), step.where("up IS NULL")
        before, left = left, below.count()
        if left in (0, before):  # none, or what is left runs in a circle
            return jumps, rooted
        jumps.append(below)
        far = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("length").alias("length2"), F.col("score").alias("score2"))
        on = below.join(far, below["tree"].eqNullSafe(far["t"]) & (below["up"] == far["n"]))
        on = on.select("tree", "node", F.col("up2").alias("up"), (F.col("length") + F.col("length2")).alias("length"), (F.col("score") + F.col("score2")).alias("score"))
        # Written whole at each level: a plan then reads one level, however deep the trees are.
        step = cut(on.unionByName(rooted))


def branches(nodes: DataFrame, rooted: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, length, score) of the best branches of each tree, by mean score."""
    parents = nodes.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(parents["t"]) & (rooted["node"] == parents["p"]), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("length")), F.desc("length"), F.asc("node"))
    return leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("tree", F.col("node").alias("leaf"), "length", "score")


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, place, node): the nodes of the best root-to-leaf paths, numbered from the root."""
    nodes = messages.select("tree", "node", "parent", "score")
    jumps, rooted = _jumps(nodes)
    # Each level reads the one before twice, so each is written.
    found = cut(branches(nodes, rooted, best).select("tree", "leaf", F.col("length").alias("place"), F.col("leaf").alias("node")))
    for k in reversed(range(len(jumps))):
        up = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        above = found.join(up, found["tree"].eqNullSafe(up["t"]) & (found["node"] == up["n"]))
        found = cut(found.unionByName(above.select("tree", "leaf", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("node"))))
    return found


def format_turns(turns: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_spans) from rows (tree, leaf, place, role, text)."""
    role, text = (escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("role", "text"))
    rows = turns.select("tree", "leaf", "place", "role", F.concat(F.lit("<s>["), role, F.lit("]\n")).alias("head"), text.alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(TURN_END))
    end = F.sum(size).over(Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("start", end - F.length("body") - F.lit(len(TURN_END)))
    turn = F.struct("place", F.concat("head", "body", F.lit(TURN_END)).alias("written"), "start", F.length("body").alias("length"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learned"))
    groups = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    learned = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return groups.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"), learned.alias("loss_spans"))


def conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """The best branches of each tree of messages (tree, node, parent, role, text, score), formatted."""
    chosen = paths(messages, best)
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = chosen.join(texts, chosen["tree"].eqNullSafe(texts["t"]) & (chosen["node"] == texts["n"])).drop("t", "n")
    return format_turns(turns)


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text), as its marks tell them, and loss_text, what lies under the loss mask."""
    pieces = F.split("formatted", TURN_END)
    header = F.lit(r"^<s>\[([^\]]*)\]\n")
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda x: F.struct(
            unescape(F.regexp_extract(x, r"^<s>\[([^\]]*)\]\n", 1)).alias("role"),
            unescape(F.substr(x, F.length(F.regexp_substr(x, header)) + 1)).alias("text"),
        ),
    )
    learned = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), F.array_join(learned, "").alias("loss_text"))


def as_trees(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without forks: each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    numbered = rows.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text")
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op4_replies(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    # Numbered once: the joins read the checkpoint.
    out = read_back(conversations(cut(as_trees(rows.unionByName(extra)))))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
         + 5 * (length(text) - length(replace(text, '[', ''))) + 5 * (length(text) - length(replace(text, ']', ''))) + length(role) + 11 AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
