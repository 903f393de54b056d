"""Chat formatting of reply trees.

A message has a tree, a node, the node it replies to and a score.  Iterative self-joins by pointer doubling
give each node its root, depth and the score sum of the path to it; leaves rank by the mean score of their
path (ties: the longer path, then the smaller leaf), and each tree's ``paths`` best become one conversation
each.  The nodes of a chosen path are enumerated by joining back down the same pointers.  Both take
log2(depth) joins, whatever the number of messages.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  A control string inside a text has a
backslash put after its first character, one more than it had, and so is not one any more; reading back
takes it off.  Roles are escaped alike, and their backslashes and newlines besides.  The loss mask covers
the texts of the assistant's turns, as code points of the formatted text.

A null role or text is empty.  A node is one message: of rows that repeat it, the least by parent, score, role and
text counts.  Messages whose parent does not exist are roots; messages on a cycle have no
root and are left out.  Rows of ``conversations`` follow by turn (null first), ties by role and text; rows
without a conv_id form one conversation; an empty table gives no rows; other columns are ignored.
"""

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm.common import Scratch, table

CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"

# No control string overlaps another or itself, so matches are the same before and after escaping.
_PLAIN = re.compile("|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"({re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss spans."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"<|im_start|>{_role_out(role)}\n", escape(text), "<|im_end|>\n"
        if role == ASSISTANT:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(_role_in(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def best_paths(scratch: Scratch, nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(tree, leaf, place, node) of the best root-to-leaf paths of ``nodes(tree, node, parent, score)``."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    state = nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")
    )
    state = scratch.cut(state, "paths")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # Only nodes that have not met their root are joined again; jumps[k] leads 2**k messages up.
    settled, live = state.where("up is null"), scratch.cut(state.where("up is not null"), "live")
    jumps = []
    for _ in range(math.ceil(math.log2(largest)) + 1 if largest else 0):
        if live.isEmpty():
            break
        jumps.append(live)
        over = settled.union(live).select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        moved = live.join(over, ["tree", "up"]).select("tree", "node", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total"))
        moved = scratch.cut(moved, "moved")
        settled, live = settled.union(moved.where("up is null")), moved.where("up is not null")
    state = settled
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct() if jumps else nodes.select("tree", "node").limit(0)
    leaves = state.join(inner, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= paths).select("tree", F.col("node").alias("leaf"), "node")
    for jump in reversed(jumps):
        up = jump.select("tree", "node", "up")
        both = F.expr("filter(array(node, up), n -> n is not null)")
        chosen = chosen.join(up, ["tree", "node"], "left").select("tree", "leaf", F.explode(both).alias("node"))
    return chosen.join(state.select("tree", "node", F.col("depth").alias("place")), ["tree", "node"]).select("tree", "leaf", "place", "node")


def format_trees(messages: DataFrame, paths: int = 1) -> DataFrame:
    """``messages(tree, node, parent, role, text, score)`` to (tree, leaf, formatted, loss_mask)."""
    scratch = Scratch(messages.sparkSession, "chat")
    once = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m"))
    messages = scratch.cut(once.select("tree", "node", "m.*"), "messages")
    picked = best_paths(scratch, messages.select("tree", "node", "parent", "score"), paths)
    turns = picked.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))

    def run(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = [render(list(zip(r, t, strict=True))) for r, t in zip(roles, texts, strict=True)]
        return pd.DataFrame({"formatted": [x[0] for x in out], "loss_mask": [[{"start": a, "end": b} for a, b in x[1]] for x in out]})

    made = F.pandas_udf(run, "formatted string, loss_mask array<struct<start: int, end: int>>")(F.col("t.role"), F.col("t.text"))
    return turns.select("tree", "leaf", made.alias("m")).select("tree", "leaf", "m.*")


def read_back(formatted: pd.Series, masks: pd.Series) -> pd.DataFrame:
    out = []
    for text, mask in zip(formatted, masks, strict=True):
        turns = parse(text)
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
        whole = "".join(f"{role}\n{said}\n" for role, said in turns)
        out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def from_turns(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation as a tree in which each replies to the one before."""
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(by).cast("long"))
    return node.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    made = format_trees(from_turns(rows))
    kind = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    got = made.select(F.expr("try_cast(tree as bigint)").alias("conv_id"), F.pandas_udf(read_back, kind)("formatted", "loss_mask").alias("r"))
    return got.select("conv_id", "r.*")


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>')) AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + len(role) + 1 + n + 11) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
