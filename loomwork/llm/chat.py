"""Chat formatting of reply trees, by DataFrame operations alone.

Nodes name their parents. Iterative self-joins double the distance each node
sees towards its root, so a tree of any depth takes a logarithmic number of
rounds; each round's jumps are kept as a table. Leaves are ranked by the score
summed along their path; the best ``top`` leaves of a tree are walked back by the
same jumps, and each path becomes one conversation.

The template is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a
line feed. In texts a backslash is doubled and ``<|`` becomes ``<\\|``, so that no
control string is left in them and both can be undone; roles are URL-encoded.
The loss mask is a list of spans, one for each assistant text, in code points and
in bytes of the formatted string.

Defined results: null text and null role are empty; a null score counts 0; a
parent that does not exist makes its node a root; repeated (tree, node) rows keep
one, the least by parent, role and text; nodes on or below a cycle have no path
from a root and are in no conversation; leaves of equal score rank by node id.
Null tree ids form one tree. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.shared import cut

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _steps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jumps over 1, 2, 4, ... nodes as tables (tree, node, up), and (tree, node, total)
    of all nodes that reach a root; total sums the scores of their paths.

    Nodes that have reached their root leave the rounds, so that the rounds which
    only the longest paths need touch only these.
    """
    parents = nodes.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    found = nodes.join(parents, nodes["tree"].eqNullSafe(parents["t"]) & (nodes["parent"] == parents["up"]), "left")
    first = cut(found.select("tree", "node", "up", F.col("score").alias("total")), "jumps")
    now, done = first.where("up is not null"), [first.where("up is null")]
    jumps, reach, count = [], 1, first.count()
    while not now.isEmpty() and reach <= count:  # only cycles go on for longer than there are nodes
        jumps.append(now)
        far = _union([now, *done]).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("total").alias("more"))
        joined = now.join(far, now["tree"].eqNullSafe(far["t"]) & (now["up"] == far["n"]))
        state = cut(joined.select("tree", "node", F.col("u").alias("up"), (F.col("total") + F.col("more")).alias("total")), "jumps")
        done.append(state.where("up is null"))
        now = state.where("up is not null")
        reach *= 2
    return jumps, _union(done).select("tree", "node", "total")


def format_trees(df: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None = None, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, loss_spans): the best ``top`` paths of each tree."""
    rows = df.select(
        F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score") if score else F.lit(1.0).alias("score"),
    ).where(F.col("node").isNotNull())
    one = Window.partitionBy("tree", "node").orderBy("parent", "role", "text")
    rows = cut(rows.withColumn("k", F.row_number().over(one)).where("k = 1").drop("k"), "nodes")
    jumps, ends = _steps(rows.select("tree", "node", "parent", "score"))
    leaves = ends
    if jumps:
        used = jumps[0].select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct()
        leaves = ends.join(used, ends["tree"].eqNullSafe(used["t"]) & (ends["node"] == used["u"]), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    path = [cut(chosen.select("tree", F.col("node").alias("leaf"), "rank", F.col("total").alias("path_score"), "node", F.lit(0).cast("long").alias("back")), "paths")]
    for k, jump in enumerate(jumps):  # after each round all nodes within 2^(k+1) of the leaf are found
        now = _union(path)
        far = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        met = now.join(far, now["tree"].eqNullSafe(far["t"]) & (now["node"] == far["n"]))
        path.append(cut(met.select("tree", "leaf", "rank", "path_score", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back")), "paths"))
    path = _union(path)
    said = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = path.join(said, path["tree"].eqNullSafe(said["t"]) & (path["node"] == said["n"])).select(
        "tree", "leaf", "rank", "path_score", "back", "role",
        F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    before = Window.partitionBy("tree", "leaf", "rank", "path_score").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    measured = turns
    for name, length in (("at", F.char_length), ("byte_at", F.octet_length)):
        whole = (length(F.col("head")) + length(F.col("body")) + len(END)).cast("long")
        measured = measured.withColumn(name, F.coalesce(F.sum(whole).over(before), F.lit(0)) + length(F.col("head")))
    piece = F.struct(
        (-F.col("back")).alias("order"), F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == LEARNT).alias("learnt"),
        F.struct(
            F.col("at").alias("start"), (F.col("at") + F.char_length("body")).alias("end"),
            F.col("byte_at").alias("byte_start"), (F.col("byte_at") + F.octet_length("body")).alias("byte_end"),
        ).alias("span"),
    )
    grouped = measured.groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    return grouped.select(
        "tree", "leaf", "rank", F.col("path_score").alias("score"), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: t["span"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn of a formatted conversation."""

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        inside = F.char_length(part) - F.char_length(head) - 1 - len(END)
        return F.struct(F.url_decode(head).alias("role"), unescape(F.substring(part, F.char_length(head) + 2, inside)).alias("text"))

    parts = F.split(formatted, "<\\|im_start\\|>")
    return F.transform(F.filter(parts, lambda p: p != ""), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    data = formatted.cast("binary")
    return F.transform(spans, lambda s: unescape(F.decode(F.substring(data, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")), "UTF-8")))
