"""Reply trees formatted as conversations."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, durable

#: What the template writes around role and text of a turn.
HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"


def escape(text: str) -> str:
    """A text in which no marker of the template stands unescaped."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of code points under the loss mask.

    A span holds one text of the role `learn`, as escaped.
    """
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{HEAD}{escape(role).replace(':', chr(92) + ':')}{COLON}"
        body = escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), spans


def _free(text: str, mark: str, at: int) -> int:
    """Where the next mark that isn't escaped begins."""
    while True:
        at = text.index(mark, at)
        slashes = at - len(text[:at].rstrip("\\")) if text[at - 1 : at] == "\\" else 0
        if slashes % 2 == 0:
            return at
        at += 1


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of render."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn begins at {at}")
        colon = _free(formatted, COLON, at + len(HEAD))
        end = _free(formatted, TAIL, colon + len(COLON))
        turns.append((unescape(formatted[at + len(HEAD) : colon]), unescape(formatted[colon + len(COLON) : end])))
        at = end + len(TAIL)
    return turns


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, path, branch, score, node, place).

    messages: (tree, node, parent, score); tree, node and parent are strings, node is unique in
    its tree, a root's parent is null. place counts from the leaf (0) to the root. Branches of a
    tree are ranked by the sum of their messages' scores, ties to the smaller leaf; the best
    `branches` of each are kept, or all. A message whose parent is not there is a root. Messages
    on a cycle have no root and are on no path.

    Ancestors are found by self-joins whose reach doubles, so a tree of depth d takes log2(d)
    rounds, and a message takes part only as long as it has an ancestor that far. Each round is
    written to the shared folder; only whether one is left reaches the driver.
    """
    messages = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    first = messages.join(there, ["tree", "parent"], "left").withColumn("up", F.when(F.col("there"), F.col("parent")))
    first = durable(first.select("tree", "node", "up", F.col("score").alias("total")))
    ended, active = first.where("up IS NULL"), first.where("up IS NOT NULL")
    levels, limit = [], first.count().bit_length()
    while len(levels) <= limit and not active.isEmpty():
        levels.append(active.select("tree", "node", "up"))
        other = ended.union(active).select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("total").alias("more"))
        reached = active.join(other, ["tree", "up"]).select("tree", "node", F.col("further").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        reached = durable(reached)
        ended, active = ended.union(reached.where("up IS NULL")), reached.where("up IS NOT NULL")
    replied = messages.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = ended.join(replied, ["tree", "node"], "left_anti")
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node")))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    found = durable(ranked.select("tree", F.col("node").alias("path"), "branch", F.col("total").alias("score"), "node", F.lit(0).cast("long").alias("place")))
    for k, step in enumerate(levels):
        further = found.join(step, ["tree", "node"]).select("tree", "path", "branch", "score", F.col("up").alias("node"), (F.col("place") + (1 << k)).alias("place"))
        found = found.union(durable(further))
    return found


def format_trees(messages: DataFrame, branches: int | None = None, learn: str = "assistant") -> DataFrame:
    """(tree, path, branch, score, formatted, spans): each chosen path as one conversation.

    messages: (tree, node, parent, score, role, text). Null roles and texts count as empty. spans
    are [start, end) code points under the loss mask. A conversation is one value, so one task
    holds all of its text; a table without messages gives no row.
    """
    chosen = paths(durable(messages.select("tree", "node", "parent", "score")), branches)  # read several times, and without texts
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct((-F.col("place")).alias("at"), "role", "text")
    whole = chosen.join(said, ["tree", "node"]).groupBy("tree", "path", "branch", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    schema = "tree string, path string, branch int, score double, formatted string, spans array<struct<start:int,stop:int>>"

    def run(part: pa.RecordBatch) -> dict:
        made = [render([(t["role"], t["text"]) for t in turns], learn) for turns in part.column("turns").to_pylist()]
        spans = [[{"start": a, "stop": b} for a, b in s] for _, s in made]
        return {c: part.column(c) for c in ("tree", "path", "branch", "score")} | {"formatted": [f for f, _ in made], "spans": spans}

    return whole.mapInArrow(batches(run, schema), schema)


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text): each row replies to the one before.

    Rows of one turn follow each other by role and text, null turns come first, and a null
    conv_id is one conversation. Scores are zero.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = conversations.select(tree.alias("tree"), "turn", "role", "text").withColumn("k", F.row_number().over(order))
    node = F.lpad(F.col("k").cast("string"), 12, "0")
    parent = F.when(F.col("k") > 1, F.lpad((F.col("k") - 1).cast("string"), 12, "0"))
    return numbered.select("tree", node.alias("node"), parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    schema = "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, spans in zip(part.column("formatted").to_pylist(), part.column("spans").to_pylist()):
            turns = parse(text)
            learnt = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            for c, v in zip(out, (len(turns), sha(said), len(learnt), sha(learnt), len(text))):
                out[c].append(v)
        return {"tree": part.column("tree")} | out

    return formatted.mapInArrow(batches(run, schema), schema)
