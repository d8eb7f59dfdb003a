"""Chat formatting from event logs.

A log row is an event: `message` starts a message, `delta` appends to
it, `edit` replaces its text and `regenerate` empties it for a new try.
Events are partitioned by conversation and message, sorted by sequence
and folded one message at a time, so a long conversation is shared by many tasks.
Each message is then rendered on its own; a conversation's formatted text is its
turns in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

EVENTS = "conv_id {id}, message bigint, seq bigint, kind string, role string, text string"
#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = '<turn role="', '">\n', "\n</turn>\n"
ASSISTANT = "assistant"


def escape(text: str) -> str:
    """No `<` or `"` is left, so no text can open or close a turn; unescape() undoes it."""
    return text.replace("\\", "\\\\").replace("<", "\\l").replace('"', "\\q")


def unescape(text: str) -> str:
    """The text that escape() was given; what it never gives is an error."""
    # two backslashes in a row are always one escaped one, read from the left
    parts = [p.replace("\\l", "<").replace("\\q", '"') for p in text.split("\\\\")]
    if any("\\" in p for p in parts):
        raise ValueError("a backslash that escapes nothing")
    return "\\".join(parts)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(the formatted turn, start and end of the part under the loss mask)."""
    head = OPEN + escape(role) + MIDDLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + (len(body) if role == ASSISTANT else 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; anything that isn't a row of turns is an error. Looks for the marks, which no text holds, so it takes the memory of the texts alone."""
    out, at = [], 0
    while at < len(formatted):
        role = at + len(OPEN)
        middle = formatted.find(MIDDLE, role)
        body = middle + len(MIDDLE)
        close = formatted.find("<", body) - 1  # the first `<` is in the mark
        if not formatted.startswith(OPEN, at) or middle < 0 or close < body or not formatted.startswith(CLOSE, close) or '"' in formatted[role:middle] or "<" in formatted[role:middle]:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(formatted[role:middle]), unescape(formatted[body:close])))
        at = close + len(CLOSE)
    return out


def fold(events) -> list[tuple[str, str]]:
    """(role, text) of one message's events in order. A second start opens one more message of that number."""
    done: list[list] = []
    for kind, role, text in events:
        if kind == "message" or not done:
            done.append([role or "", []])
        if kind == "delta" or kind == "message":
            done[-1][1].append(text or "")
        elif kind == "edit":
            done[-1][1] = [text or ""]
        elif kind == "regenerate":
            done[-1][1] = [text or ""]
        if role and kind != "message":
            done[-1][0] = role
    return [(role, "".join(parts)) for role, parts in done]


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, message, part, formatted, loss_start, loss_end: one row per final message.

    events: conv_id, message, seq, kind, role, text. Ties in seq go by
    kind, role and text. Null text is empty, a null role is the empty role, a null kind is a
    message, null conversations, messages and sequence numbers sort first.
    Repeated events are applied again. Other columns are ignored;
    an empty table gives no rows.
    """
    id_type = events.schema["conv_id"].dataType.simpleString()
    rows = events.select("conv_id", F.col("message").cast("long").alias("message"), F.coalesce("kind", F.lit("message")).alias("kind"), "role", "text", F.col("seq").alias("seq"))
    parts = rows.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text").drop("seq")

    def run(batches):
        key, held = None, []
        schema = None

        def flush():
            turns = [render(r, t) for r, t in fold(held)]
            n = len(turns)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, schema.field("conv_id").type), pa.array([key[1]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([t[0] for t in turns], pa.string()),
                 pa.array([t[1] for t in turns], pa.int64()), pa.array([t[2] for t in turns], pa.int64())], ["conv_id", "message", "part", "formatted", "loss_start", "loss_end"])

        done = []
        for b in batches:
            schema = b.schema
            for conv, message, kind, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text")), strict=True):
                if held and (conv, message) != key:
                    done.append(flush())
                    held = []
                key = (conv, message)
                held.append((kind, role, text))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if held:
            yield flush()

    return parts.mapInArrow(run, f"conv_id {id_type}, message bigint, part int, formatted string, loss_start bigint, loss_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the formatted turns in order. Holds one turn at a time."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "message", "part")

    def run(batches):
        key, state, done, id_arrow = None, None, [], None

        def batch():
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_arrow), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close():
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            id_arrow = b.schema.field("conv_id").type
            for conv, text, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                loss = unescape(text[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            if done:
                yield batch()
                done = []
        if state is not None:
            close()
            yield batch()

    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_events(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.col("turn").cast("long").alias("message"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


TRAP = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    extra = spark.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(TRAP).alias("text"))
    return read_back(format_chats(as_events(rows).union(as_events(extra))))


def sql() -> str:
    text = "coalesce(text, '')"
    escaped = f"replace(replace(replace({text}, '\\', '\\\\'), '<', '\\l'), '\"', '\\q')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, {text} AS text, length({escaped}) AS escaped_chars FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{TRAP}'), (-7, 1, 'assistant', '{TRAP}')
  )
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
  sum({len(OPEN) + len(MIDDLE) + len(CLOSE)} + length(role) + escaped_chars)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
