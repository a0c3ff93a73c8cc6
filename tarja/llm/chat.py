r"""Operator 9: chat formatting over a prefix tree of conversations.

A conversation's turns, each written by a template, are a path in a tree in which conversations with
the same first turns share nodes. Conversations are sorted by the digests of their turns, which is
the tree's depth-first order, and split over tasks by ranges of it (with the id behind, so
that even one conversation told by a third of all splits). Each task walks its range with the
path of open nodes and fills packs of about PACK tokens: a node's tokens stand once in a pack, with

- their span in the pack's tokens, the parent and the position id of the first one (the number of tokens
  before it on its path, whatever else stands in the pack);
- the intervals of the pack that it attends to: its ancestors' spans (adjoining ones merged) and its own;
- the span under the loss mask: an assistant's text.

A conversation that opens a pack brings its whole path, so packs need nothing of one another. What the template
writes and what was said are encoded apart, so no token crosses the edge of a text or of the loss mask, and a prefix
has the same tokens in every conversation. The tokenizer is a byte-level one, whose tokens decode to
exactly the text; strings of its special tokens are ordinary text.

Template: ``<s>`` before the first turn; then ``[INST] text [/INST]`` for a user, ``<<SYS>>text<</SYS>>``
for a system, ``text</s>`` for an assistant and ``[ROLE=hex]text</s>`` for any other role, with the
hexadecimal UTF-8 of its name (a null role: no digits). Inside texts a control string gets a
backslash after its first character, and one with backslashes there already gets one more; taking
one away restores the text.

Rows of one conversation are ordered by turn, then role, then text; equal rows all count; a null turn
comes first. A null text is empty. Rows with a null conv_id are one conversation with a null id.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, table

#: Tokens, and conversations, after which a pack ends.
PACK, LEAVES = 1 << 16, 2048
_ESCAPE = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>|ROLE=)")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>|ROLE=)")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|\[ROLE=(?P<role>[0-9a-f]*)\](?P<other>.*?)</s>|(?P<assistant>.*?)</s>", re.S)
PACK_SCHEMA = "tokens array<int>, nodes array<struct<start:int,end:int,parent:int,position:long,attends:array<struct<start:int,end:int>>,loss_start:int,loss_end:int>>, leaves array<struct<conv_id:long,node:int,n_turns:long>>"
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESCAPED = r"regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>|ROLE=)', '\1\\\2\3', 'g')"
ORACLE_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, length({_ESCAPED}) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 ELSE 11 + length(hex(encode(coalesce(role, '')))) END AS size FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + 3 AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def turn_parts(role: str | None, text: str) -> tuple[str, str, str]:
    """A turn by the template: what stands before the escaped text, the text, and what stands behind it."""
    own = escape(text)
    if role == "assistant":
        return "", own, "</s>"
    if role == "user":
        return "[INST] ", own, " [/INST]"
    if role == "system":
        return "<<SYS>>", own, "<</SYS>>"
    return f"[ROLE={(role or '').encode().hex()}]", own, "</s>"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    own.encode_special_tokens = True
    return own


def _conversations(rows: DataFrame) -> DataFrame:
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.substring(F.sha2(F.to_json(F.struct(t["role"], t["text"])), 256), 1, 16)), "")
    return own.select(F.col("conv_id").cast("string").alias("conv_id"), "turns", path.alias("path"))


class _Pack:
    def __init__(self):
        self.tokens, self.nodes, self.leaves, self.open = [], [], [], []

    def add(self, key: tuple, parts: list[list[int]], loss: bool) -> None:
        """A child of the last open node: the tokens before its text, of it, and behind it."""
        parent = self.open[-1][1] if self.open else -1
        start = len(self.tokens)
        for part in parts:
            self.tokens += part
        end = len(self.tokens)
        above = self.nodes[parent] if parent >= 0 else None
        attends = [dict(x) for x in above["attends"]] if above else []
        if attends and attends[-1]["end"] == start:
            attends[-1]["end"] = end
        else:
            attends.append({"start": start, "end": end})
        position = above["position"] + above["end"] - above["start"] if above else 0
        masked = start + len(parts[0]) if loss else start
        self.nodes.append({"start": start, "end": end, "parent": parent, "position": position, "attends": attends, "loss_start": masked, "loss_end": masked + len(parts[1]) if loss else masked})
        self.open.append((key, len(self.nodes) - 1))

    def row(self) -> dict:
        return {"tokens": self.tokens, "nodes": self.nodes, "leaves": self.leaves}


def _packed(path: str):
    def run(frames):
        model = _tokenizer(path)
        pack = _Pack()
        for f in frames:
            for conv, turns in zip(f["conv_id"].tolist(), f["turns"].tolist(), strict=True):
                if len(pack.tokens) >= PACK or len(pack.leaves) >= LEAVES:
                    yield pd.DataFrame([pack.row()])
                    pack = _Pack()
                same = 0
                while same < len(turns) and same < len(pack.open) and pack.open[same][0] == (turns[same]["role"], turns[same]["text"]):
                    same += 1
                del pack.open[same:]
                texts = [x for t in turns[same:] for x in turn_parts(t["role"], t["text"])]
                if texts and not same:
                    texts[0] = "<s>" + texts[0]
                ids = [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
                for k, t in enumerate(turns[same:]):
                    pack.add((t["role"], t["text"]), ids[3 * k : 3 * k + 3], t["role"] == "assistant")
                pack.leaves.append({"conv_id": None if conv is None else int(conv), "node": pack.open[-1][1], "n_turns": len(turns)})
        if pack.leaves:
            yield pd.DataFrame([pack.row()])

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Packs (tokens, nodes, leaves) for rows (conv_id, turn, role, text); see the module. ``tokenizer``: the file of
    a byte-level tokenizer, at the same path on every executor."""
    limit_batches(rows.sparkSession)
    own = _conversations(rows)
    return own.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").drop("path").mapInPandas(_packed(tokenizer), PACK_SCHEMA)


def _read(path: str):
    def run(frames):
        model = _tokenizer(path)
        for f in frames:
            for tokens, nodes, leaves in zip(f["tokens"], f["nodes"], f["leaves"], strict=True):

                def decode(start: int, end: int, tokens=tokens) -> str:
                    return model.decode(tokens[start:end].tolist(), skip_special_tokens=False)

                told: dict[int, tuple] = {}  # by node: copies of a conversation end at one
                for leaf in leaves:
                    if leaf["node"] not in told:
                        whole = "".join([decode(s["start"], s["end"]) for s in nodes[leaf["node"]]["attends"]])
                        loss, at = [], leaf["node"]
                        while at >= 0:
                            loss.append(unescape(decode(nodes[at]["loss_start"], nodes[at]["loss_end"])))
                            at = nodes[at]["parent"]
                        told[leaf["node"]] = _digests(whole, "".join(reversed(loss)))
                out = [(leaf["conv_id"], *told[leaf["node"]]) for leaf in leaves]
                yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return run


def _digests(whole: str, loss: str) -> tuple[int, str, int, str, int]:
    turns = hashlib.sha256()
    count = 0
    for m in _TURN.finditer(whole, 3):
        kind = m.lastgroup
        role = bytes.fromhex(m["role"]).decode() if kind == "other" else kind
        turns.update(f"{role}\n{unescape(m[kind])}\n".encode())
        count += 1
    return count, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)


def read_back(packs: DataFrame, tokenizer: str) -> DataFrame:
    """The digests of every conversation, taken from the packs alone: its text is what its last node
    attends to, its turns are parsed from that, its loss text is what its path has under the mask."""
    return packs.mapInPandas(_read(tokenizer), READ_SCHEMA)


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra), tokenizer_path()), tokenizer_path())
