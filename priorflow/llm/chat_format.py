"""Conversations as training text: reply trees, their best branches, and one text for each.

Messages have an id and the id they reply to. Iterative self-joins enumerate root-to-leaf
paths: in round k each message that isn't done is joined with the message ``2**k`` replies
above it, so depth, path score and every ancestor are known after ``log2(depth)`` joins of
narrow tables. Leaves are ranked by the sum of scores on their path, the best ``keep`` paths
of a tree are spelled out by the same jumps, and each becomes one conversation. Texts are
shuffled once, when a tree's messages meet.

A tree's text is one value by nature: a tree may have up to 2 GB of text.

The template marks turns; control strings in texts are escaped: a backslash goes after their
first character, behind those already there, so ``unescape`` takes exactly one away. Roles
have ``%`` and line ends percent-encoded, as a line end closes a role.

Defined results: null texts and roles are empty; null trees, ids and turns are values like
others, but a null parent is none; a message whose parent isn't there is a root; messages on
a circle of replies, and those that reply to one, have no root and are left out; rows of one
id (or turn) are one message, whose texts follow each other as turns by role and text, whose
parent is the smallest and whose scores add up; scores that tie go by the smaller leaf id; an
empty table gives no rows; other columns are ignored, whatever their names. Everything here
is built-in DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scratch


@dataclass(frozen=True)
class Template:
    """How turns are marked: ``begin`` role line-end text ``end``. All ``controls`` are escaped in texts."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)

    def _pattern(self, marks: str) -> str:
        firsts = "".join(sorted({"\\" + c[0] for c in self.controls}))
        return f"([{firsts}]){marks}({'|'.join(re.escape(c[1:]) for c in self.controls)})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._pattern(r"(\\*)")), F.lit(r"$1$2\\$3"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._pattern(r"\\(\\*)")), F.lit("$1$2$3"))

    def turn(self, role: Column, text: Column) -> Column:
        """(piece, skip, train, rest): the turn's text, and how many of its characters are
        without loss, with loss and again without."""
        named = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
        head, body = F.concat(F.lit(self.begin), self.escape(named), F.lit("\n")), self.escape(text)

        def parts(x: Column) -> Column:
            piece = F.concat(x["head"], x["body"], F.lit(self.end))
            learnt = role.isin(*self.trained)
            train = F.when(learnt, F.char_length(x["body"])).otherwise(0)
            rest = F.when(learnt, len(self.end)).otherwise(0)
            return F.struct(piece.alias("piece"), (F.char_length(piece) - train - rest).alias("skip"), train.alias("train"), rest.alias("rest"))

        return F.get(F.transform(F.array(F.struct(head.alias("head"), body.alias("body"))), parts), F.lit(0))

    def pieces(self, formatted: Column) -> Column:
        """The turns of a formatted text, each without its end mark."""
        found = F.split(formatted, re.escape(self.end), -1)
        return F.slice(found, F.lit(1), F.size(found) - 1)

    def read(self, piece: Column) -> Column:
        """(role, text) of a piece."""
        role = F.substring_index(F.substring(piece, F.lit(len(self.begin) + 1), F.char_length(piece)), "\n", 1)
        text = F.substring(piece, F.char_length(role) + len(self.begin) + 2, F.char_length(piece))
        plain = F.replace(F.replace(self.unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        return F.struct(plain.alias("role"), self.unescape(text).alias("text"))

    def learnt(self, formatted: Column, turns: Column) -> Column:
        """All text under the loss mask ``turns``, unescaped."""
        cut = lambda piece, t: self.unescape(F.substring(piece, t["skip"] + 1, t["train"]))
        return F.array_join(F.zip_with(self.pieces(formatted), turns, cut), "")


CHATML = Template()


def _on(a: DataFrame, b: DataFrame, x: str = "id", y: str = "id") -> Column:
    return (a["tree"] == b["tree"]) & (a[x] == b[y])


def chosen_paths(links: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, id, rank, place, score) for each message on one of the ``keep`` best paths of its
    tree; places count from 1 at the root.

    ``links`` is a stored table (tree, id, parent, score) with one row for each message;
    tree, id and parent are structs of one column, so that nulls in them are values.
    """
    ids = links.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    known = links.join(ids, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("i")), "left")
    state = known.select("tree", "id", F.col("i").alias("up"), F.lit(1).alias("depth"), F.col("score").cast("double").alias("score"))
    state = scratch.keep(state, "reply-jumps-0")
    n, jumps = state.count(), []
    while (1 << len(jumps)) <= n:
        active = state.filter("up IS NOT NULL")
        if active.isEmpty():
            break
        jumps.append(active.select("tree", "id", "up"))
        above = state.select("tree", F.col("id").alias("i"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("score").alias("s"))
        moved = active.join(above, (active["tree"] == above["tree"]) & (active["up"] == above["i"]))
        moved = moved.select(active["tree"], "id", F.col("next").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("score") + F.col("s")).alias("score"))
        state = scratch.keep(state.filter("up IS NULL").unionByName(moved), f"reply-jumps-{len(jumps)}")
    rooted = state.filter("up IS NULL")
    parents = known.filter("i IS NOT NULL").select(F.col("tree").alias("t"), "i").distinct()
    leaves = rooted.join(parents, (F.col("tree") == F.col("t")) & (F.col("id") == F.col("i")), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "id"))
    best = leaves.withColumn("rank", rank).filter(F.col("rank") <= keep)
    paths = scratch.keep(best.select("tree", "id", "rank", F.col("depth").alias("place"), "score"), "reply-paths")
    for k, jump in enumerate(jumps):
        up = paths.join(jump, ["tree", "id"]).select("tree", F.col("up").alias("id"), "rank", (F.col("place") - (1 << k)).alias("place"), "score")
        paths = scratch.keep(paths.unionByName(up), f"reply-paths-{k}")
    return paths


def _formatted(messages: DataFrame, links: DataFrame, keep: int, template: Template) -> DataFrame:
    """``messages`` has (tree, id, role, text), ``links`` also n, the rows of each message."""
    paths = chosen_paths(links, keep).groupBy("tree", "id").agg(F.collect_list(F.struct("rank", "place", "score")).alias("places"))
    nodes = links.select("tree", "id", "n").join(paths, ["tree", "id"], "left").select("tree", F.struct("id", "n", "places").alias("node"))
    message = F.struct("id", "role", "text", template.turn(F.col("role"), F.col("text")).alias("turn"))
    both = messages.select("tree", message.alias("message")).unionByName(nodes, allowMissingColumns=True)
    trees = both.groupBy("tree").agg(F.collect_list("message").alias("messages"), F.collect_list("node").alias("nodes"))
    # both in the order of ids: a message's rows meet its places
    places = F.flatten(F.transform(F.sort_array("nodes"), lambda x: F.array_repeat(F.struct(x["places"].alias("places")), x["n"].cast("int"))))
    met = F.zip_with(F.sort_array("messages"), places, lambda m, p: F.struct(p["places"].alias("places"), m.alias("m")))
    rows = trees.select("tree", met.alias("met")).select("tree", "met", F.explode(F.sequence(F.lit(1), F.lit(keep))).alias("rank"))

    def on_path(x: Column) -> Column:
        at = F.get(F.filter(x["places"], lambda p: p["rank"] == F.col("rank")), F.lit(0))
        return F.struct(at["place"].alias("place"), at["score"].alias("score"), x["m"].alias("m"))

    path = F.sort_array(F.filter(F.transform("met", on_path), lambda x: x["place"].isNotNull()))
    rows = rows.select("tree", "rank", path.alias("path")).filter(F.size("path") > 0)
    return rows.select(
        "tree", "rank", F.get("path", F.lit(0))["score"].alias("score"), F.size("path").cast("long").alias("n_turns"),
        F.array_join(F.transform("path", lambda x: x["m"]["turn"]["piece"]), "").alias("formatted"),
        F.transform("path", lambda x: F.struct(x["m"]["turn"]["skip"].alias("skip"), x["m"]["turn"]["train"].alias("train"), x["m"]["turn"]["rest"].alias("rest"))).alias("turns"),
    )


def _plain(messages: DataFrame, tree_col: str, id_col: str, role_col: str, text_col: str, *more: Column) -> DataFrame:
    empty = F.lit("")
    return messages.select(
        F.struct(F.col(tree_col).alias("tree")).alias("tree"), F.struct(F.col(id_col).alias("id")).alias("id"),
        F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"), *more,
    )


def format_trees(
    messages: DataFrame, tree_col: str = "tree_id", id_col: str = "message_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str | None = None, keep: int = 1,
    template: Template = CHATML,
) -> DataFrame:
    """The ``keep`` best root-to-leaf paths of each tree: (tree, rank, score, n_turns,
    formatted, turns).

    ``turns`` is the loss mask, an entry for each turn: so many characters without loss, with
    loss, and without.
    """
    score = F.lit(0.0) if score_col is None else F.coalesce(F.col(score_col).cast("double"), F.lit(0.0))
    parent = F.when(F.col(parent_col).isNotNull(), F.struct(F.col(parent_col).alias("id")))
    plain = _plain(messages, tree_col, id_col, role_col, text_col, parent.alias("parent"), score.alias("score"))
    links = plain.groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    out = _formatted(plain.select("tree", "id", "role", "text"), scratch.keep(links, "reply-links"), keep, template)
    return out.withColumn("tree", F.col("tree.tree"))


def format_chains(messages: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = CHATML) -> DataFrame:
    """Conversations whose turns are numbered: each turn replies to the one before it. The same
    columns as those of :func:`format_trees`."""
    plain = _plain(messages, tree_col, turn_col, role_col, text_col)
    turns = plain.groupBy("tree", "id").agg(F.count(F.lit(1)).alias("n"))
    order = turns.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("turns"))
    pairs = F.transform("turns", lambda x, k: F.struct(x["id"].alias("id"), F.when(k > 0, F.get(F.col("turns"), k - 1)["id"]).alias("parent"), x["n"].alias("n")))
    links = order.select("tree", F.explode(pairs).alias("x")).select("tree", "x.id", "x.parent", F.lit(0.0).alias("score"), "x.n")
    return _formatted(plain, scratch.keep(links, "reply-links"), 1, template).withColumn("tree", F.col("tree.tree"))
