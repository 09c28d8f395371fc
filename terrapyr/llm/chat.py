"""Operator 6, chat formatting with offset-aligned loss masks.

A conversation's rows, by turn (nulls first; ties by role, then text), are rendered whole:
`<|im_start|>` role `<|im_sep|>` text `<|im_end|>` for every turn. Control strings inside
roles and texts are escaped by a backslash after their first character, and those that
already have some get one more, so that the escape can be undone. The rendered text is
encoded once, with the three marks as tokens of their own, and with character offsets. The
loss mask is the intersection of token spans with the sorted spans of the assistant's texts,
found by binary search.

`format_conversations` returns the formatted text, the token identifiers, which of them are
under the mask, and the mask's parts as spans of characters; `digests` reads all of that back.

Null roles and texts are empty; rows without conv_id are one conversation. Repeated rows are
turns of their own; ties in turn go by role, then text, so reruns agree. Empty tables give no
conversation. Other columns may have any names; they are not read. Rows arrive sorted and a
worker holds one small batch of conversations (a very long one alone), so no group of
conversations is gathered. The vocabulary's file is read by the driver and sent as a
broadcast of fixed size. Offsets follow from the lengths of tokens in bytes: a token that
ends inside a character counts as touching it.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .token_counts import PATTERN, VOCABULARY, encode

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates; each is escaped inside texts.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_PLAIN = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))
_MARKS = re.compile(f"({re.escape(START)}|{re.escape(SEP)}|{re.escape(END)})")
_LONG = re.compile(r"\s{2048}")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.S)
OUT = "conv_id long, formatted string, ids array<int>, loss array<boolean>, spans array<array<int>>"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises if anything else is in it."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


def mask(tokens: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tokens, spans: sorted [start, end) pairs. Which tokens touch a span, and the parts of spans that tokens cover."""
    if not len(spans) or not len(tokens):
        return np.zeros(len(tokens), bool), np.zeros((0, 2), np.int64)
    first = np.searchsorted(spans[:, 1], tokens[:, 0], side="right")
    past = np.searchsorted(spans[:, 0], tokens[:, 1], side="left")
    many = np.where(tokens[:, 1] > tokens[:, 0], np.maximum(past - first, 0), 0)
    token = np.repeat(np.arange(len(tokens)), many)
    span = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + first[token]
    low, high = np.maximum(tokens[token, 0], spans[span, 0]), np.minimum(tokens[token, 1], spans[span, 1])
    return many > 0, np.stack([low, high], 1)


def joined(parts: np.ndarray) -> np.ndarray:
    """Sorted parts that overlap (tokens that share a character) or touch, as one each."""
    if not len(parts):
        return parts
    top = np.maximum.accumulate(parts[:, 1])
    first = np.flatnonzero(np.concatenate([[True], parts[1:, 0] > top[:-1]]))
    out = np.stack([parts[first, 0], top[np.concatenate([first[1:], [len(parts)]]) - 1]], 1)
    return out[out[:, 1] > out[:, 0]]


class Encoder:
    """A byte-level vocabulary (a file of ranks) with the three marks as tokens of their own."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        free = max(ranks.values()) + 1
        self.marks = {m: free + i for i, m in enumerate((START, SEP, END))}
        self.core = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.marks)
        self.sizes = np.zeros(free + len(self.marks), np.int64)
        for token, i in [*ranks.items(), *((m.encode(), i) for m, i in self.marks.items())]:
            self.sizes[i] = len(token)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token identifiers, and the [start, end) characters that each touches."""
        if _LONG.search(text):  # the marks cut the text before anything else does
            ids = [i for part in _MARKS.split(text) for i in ([self.marks[part]] if part in self.marks else encode(self.core, part))]
        else:
            ids = self.core.encode(text, allowed_special="all", disallowed_special=())
        ids = np.array(ids, np.int64)
        ends = np.cumsum(self.sizes[ids])
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) == len(text):
            return ids, np.stack([ends - self.sizes[ids], ends], 1)
        inner = (data & 0xC0) == 0x80
        chars = np.concatenate([[0], np.cumsum(~inner)])
        begin = ends - self.sizes[ids]
        return ids, np.stack([chars[begin] - inner[begin], chars[ends]], 1)


def format_conversations(rows: DataFrame, vocabulary: str = VOCABULARY, loss_roles: tuple[str, ...] = ("assistant",), batch_chars: int = 1 << 20) -> DataFrame:
    """(conv_id, formatted, ids, loss, spans) of every conversation; loss: which tokens are under the mask, spans: the characters that are."""
    spark = rows.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches):
        import pyarrow as pa

        encoder = Encoder(shared.value)

        def finish(waiting):
            out = []
            for conv, turns in waiting:
                text, spans = render(turns)
                ids, tokens = encoder(text)
                loss = np.array([s for (role, _), s in zip(turns, spans) if role in loss_roles], np.int64).reshape(-1, 2)
                hit, parts = mask(tokens, loss)
                out.append((conv, text, ids.astype(np.int32), hit, joined(parts)))
            lists = lambda k, t: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x[k]) for x in out])]), pa.int32()), pa.array(np.concatenate([x[k] for x in out]), t))
            pairs = np.concatenate([x[4] for x in out]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(pairs) + 1) * 2, pa.int32()), pa.array(pairs.ravel(), pa.int32()))
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x[4]) for x in out])]), pa.int32()), flat)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), lists(2, pa.int32()), lists(3, pa.bool_()), spans], ["conv_id", "formatted", "ids", "loss", "spans"])

        waiting, chars, now = [], 0, None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if now is None or now[0] != conv:
                    if now is not None and chars >= batch_chars:
                        yield finish(waiting)
                        waiting, chars = [], 0
                    now = (conv, [])
                    waiting.append(now)
                now[1].append((role, text))
                chars += len(role) + len(text)
        if waiting:
            yield finish(waiting)

    return rows.mapInArrow(work, OUT)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in formatted conversations: turns, and the text under the mask with its escapes undone."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))):
                back = read_back(text)
                under = "".join(unescape(text[a:b]) for a, b in spans)
                turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode())
                out.append((conv, len(back), turns.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            names, types = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -7L as conv_id, t.* from values (0L, 'user', '{odd}'), (1L, 'assistant', '{odd}') as t(turn, role, text)")
    return digests(format_conversations(given.unionByName(extra)))

SQL = r"""
with given as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (select *, 32 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text,
  '<\\*\|im_start\|>|<\\*\|im_sep\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*\|startoftext\|>|<\\*s>|<\\*/s>|<\\*unk>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>')) as chars from given)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""
