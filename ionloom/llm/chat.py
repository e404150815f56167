"""Chat formatting from event logs.

A conversation's log holds, in the order of `seq`, what happened to its messages: `open` (a message with a
role), `delta` (text streamed to its end), `edit` (the whole text replaced) and `regenerate` (the text thrown
away, to be streamed anew). Logs are partitioned by conversation and sorted; folding them gives the final
messages, which are rendered one row a turn: the rows of a conversation in the order of `turn_no`, joined,
are its formatted text. A task holds one message at a time, so a conversation may be of any length.

The template: BEGIN, then for each turn HEAD role HEAD_END newline text END newline. In texts and roles every
ESCAPE is doubled and every control string gets one ESCAPE after its first character, so that no text can pose as
markup and reading back gives exactly what was written. The loss mask covers the escaped text of assistant turns.

Null texts and roles count as empty. Rows of one conversation and turn keep an order by role and text. Events
without an open message are an error of the log and open one with an empty role. Rows with a null conv_id
are one conversation. An empty table gives no conversation but those the caller adds. Columns other than conv_id,
turn, role and text are not looked at. A message, however long, is one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BEGIN, HEAD, HEAD_END, END = "<s>", "<|turn|>", "<|text|>", "</s>"
ESCAPE = "\\"
#: Strings that a text may not hold unescaped: the template's own and those of other common templates.
CONTROLS = [BEGIN, END, HEAD, HEAD_END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
ROLES_WITH_LOSS = ("assistant",)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    """Undoes `escape`: of two ESCAPEs one stays, a single one goes."""
    return re.sub(r"\\(\\?)", lambda m: m[1], text)


# --- from rows to a log, and from a log to messages ---------------------------------------------------


def event_log(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, kind, role, payload) of `turns` (conv_id, turn, role, text), as a chat service would have logged them.

    Users' messages come as a draft and an edit. Assistants' messages are streamed twice, as a first attempt that
    is thrown away and in two halves that stay. Others are one delta.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")

    def event(kind: str, payload) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), (payload if not isinstance(payload, str) else F.lit(payload)).alias("payload"))

    front, back = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))
    events = (
        F.when(role == "user", F.array(event("open", ""), event("delta", back), event("edit", text)))
        .when(role == "assistant", F.array(event("open", ""), event("delta", back), event("regenerate", ""), event("delta", front), event("delta", back)))
        .otherwise(F.array(event("open", ""), event("delta", text)))
    )
    order = F.struct("turn", role.alias("role"), F.xxhash64(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    made = turns.select("conv_id", order.alias("order"), role.alias("role"), F.posexplode(events).alias("step", "event"))
    return made.select("conv_id", F.struct("order", "step").alias("seq"), "role", "event.kind", "event.payload")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages (conv_id, turn_no, role, text) from events (conv_id, kind, role, payload) in order."""
    names, kinds = ["conv_id", "turn_no", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    current: tuple | None = None  # conversation, number, role, parts
    started, conv, number = False, None, -1
    for batch in batches:
        out = []
        for conv_id, kind, role, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or conv_id != conv:
                if current:
                    out.append((*current[:3], "".join(current[3])))
                started, conv, number, current = True, conv_id, -1, None
            if kind == "open" or current is None:
                if current:
                    out.append((*current[:3], "".join(current[3])))
                number += 1
                current = (conv_id, number, (role or "") if kind == "open" else "", [])
            parts = current[3]
            if kind in ("edit", "regenerate"):
                parts.clear()
            if kind in ("delta", "edit"):
                parts.append(payload or "")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
    if current:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*current[:3], "".join(current[3])), kinds)], names)


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, turn_no, role, text): the final messages of an event log."""
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.select(F.col("conv_id").cast("long"), "kind", "role", "payload").mapInArrow(_fold, "conv_id long, turn_no long, role string, text string")


# --- rendering and reading back -----------------------------------------------------------------------


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_no, formatted, loss_start, loss_end) in the order of `messages`; the mask is in code points of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv_id", "turn_no", "formatted", "loss_start", "loss_end"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for conv_id, number, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                head = (BEGIN if number == 0 else "") + HEAD + escape(role) + HEAD_END + "\n"
                body = escape(text)
                mask = (len(head), len(head) + len(body)) if role in ROLES_WITH_LOSS else (0, 0)
                out.append((conv_id, number, head + body + END + "\n", *mask))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return messages.select("conv_id", "turn_no", "role", "text").mapInArrow(run, "conv_id long, turn_no long, formatted string, loss_start long, loss_end long")


_TURN = re.compile(re.escape(HEAD) + "(.*?)" + re.escape(HEAD_END) + "\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    found = _TURN.fullmatch(formatted.removeprefix(BEGIN))
    if not found:
        raise ValueError("not a rendered turn")
    return unescape(found[1]), unescape(found[2])


class _Reader:
    """What a conversation's rendered turns say when read back; hashes grow turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        role, text = parse(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        masked = unescape(formatted[start:end])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation of `rendered`, whose rows are in order: what is read from the formatted text alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out = []
            for conv_id, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or reader.conv_id != conv_id:
                    if reader:
                        out.append(reader.row())
                    reader = _Reader(conv_id)
                reader.add(formatted, start, end)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
        if reader:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(reader.row(), kinds)], names)

    return rendered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)


def format_chats(turns: DataFrame) -> DataFrame:
    """The rendered turns of all conversations of `turns`, each conversation's rows together and in order."""
    return render(reconstruct(event_log(turns)))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(turns.unionByName(more)))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE * 2}')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0] + ESCAPE + c[1:]}')"
    return out


OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, {_sql_escape("role")} AS r, {_sql_escape("text")} AS x FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role)) AS loss_sha256,
  CAST({len(BEGIN)} + sum({len(HEAD + HEAD_END + END) + 2} + length(r) + length(x)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
