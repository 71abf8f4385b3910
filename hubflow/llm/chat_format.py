"""Chat formatting by event-sourced reconstruction (operator 9).

A log has events of messages: ``start`` (role), ``delta`` (text to append), ``edit`` (the
text is replaced) and ``regenerate`` (the text is cleared; deltas follow). Events are dealt
by (conversation, message), sorted by sequence and folded into final messages, so a huge conversation is
folded by many tasks; only its finished messages meet, in the one row that is the output.

Rendering: ``### role: text</turn>`` and a line feed for every turn. Backslash, ``#``,
``<`` and, in roles, ``:`` and line feeds are escaped by a backslash in front, so no text
can hold a control string; taking the backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import map_rows

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\#<:\n]|\\.)*+): ((?:[^\\#<]|\\.)*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\#<:\n])" if role else r"([\\#<])", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """[(role, text, from, to)] of the turns; from and to bound the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


#: The columns that tell a turn of ``events_of_turns`` from others.
TURN = ("conv_id", "turn", "digest", "copy")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log (conv_id, turn, digest, copy, seq, kind, role, text) of finished turns (conv_id, turn, role, text).

    A hash of the turn picks how it was written: streamed in two deltas, a draft that an
    edit replaces, a half that is regenerated, or an edited half that a delta continues. Each folds back to
    the turn's text. Repeated rows and equal turns stay apart by ``copy``. A null turn comes
    first, a null role is empty.
    """
    keyed = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    # texts are shuffled here, by conversation, turn and digest, and keep that place until the turns are rendered
    each = (keyed.groupBy("conv_id", "turn", "digest").agg(F.count("*").alias("n"), F.first("role").alias("role"), F.first("text").alias("text"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))))
    half = F.expr("length(text) div 2")
    head, tail = F.substring("text", F.lit(1), half), F.expr("substring(text, length(text) div 2 + 1)")

    def log(*events):
        return F.array(*[F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), add.alias("add"))
                         for seq, (kind, add) in enumerate((("start", F.lit("")), *events))])

    way = F.pmod(F.xxhash64("conv_id", "turn", "digest", "copy"), F.lit(4))
    written = (F.when(way == 0, log(("delta", head), ("delta", tail)))
               .when(way == 1, log(("delta", tail), ("edit", F.col("text"))))
               .when(way == 2, log(("delta", head), ("regenerate", F.lit("")), ("delta", head), ("delta", tail)))
               .otherwise(log(("delta", tail), ("edit", head), ("delta", tail))))
    return each.select(*TURN, "role", F.explode(written).alias("e")).select(*TURN, "e.seq", "e.kind", "role", F.col("e.add").alias("text"))


def fold(events: DataFrame, key: tuple[str, ...] = ("conv_id", "message")) -> DataFrame:
    """(*key, role, text): the final message of each ``key`` of the log.

    Events count by ascending seq (ties: by kind, then text; a null seq first). The last
    edit or regenerate discards what was before it; deltas after it are appended. The
    role is the first event's that has one; null texts add nothing.
    """
    by = Window.partitionBy(*key)
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.coalesce("seq", F.lit(-(2 ** 62))))).over(by)
    live = events.withColumn("reset", reset).where(F.col("reset").isNull() | (F.coalesce("seq", F.lit(-(2 ** 62))) >= F.col("reset")) | (F.col("kind") == "start"))
    text = F.when(F.col("kind").isin("delta", "edit"), F.coalesce("text", F.lit(""))).otherwise("")
    return (live.groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("seq", "kind", text.alias("add")))).alias("parts"), F.min_by("role", F.struct(F.col("role").isNull(), "seq")).alias("role"))
            .select(*key, F.coalesce("role", F.lit("")).alias("role"), F.concat_ws("", F.transform("parts", lambda p: p["add"])).alias("text")))


def render(messages: DataFrame, order: str = "message") -> DataFrame:
    """(conv_id, formatted): the messages of a conversation by ``order`` (ties: by role, then text), one string."""
    said = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "role", "text")))
    part = lambda m: F.concat(F.lit(OPEN), escape(m["role"], True), F.lit(AFTER_ROLE), escape(m["text"]), F.lit(CLOSE))
    return messages.groupBy("conv_id").agg(said.alias("said")).select("conv_id", F.concat_ws("", F.transform("said", part)).alias("formatted"))


def loss_spans(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans): [from, to) in code points of every assistant text, the places a loss is taken on."""
    def rows(cols):
        for conv, text in zip(cols["conv_id"], cols["formatted"]):
            yield conv, text, [{"from": a, "to": b} for role, _, a, b in read_back(text) if role == "assistant"]

    return map_rows(formatted, rows, "conv_id long, formatted string, spans array<struct<from:long,to:long>>", rows=64)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) of finished turns, by way of their events. An empty table gives an empty result."""
    return loss_spans(render(fold(events_of_turns(turns), TURN), "turn"))


def chat_report(turns: DataFrame) -> DataFrame:
    """Read back from the formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A null conv_id is a conversation."""
    def rows(cols):
        for conv, text, spans in zip(cols["conv_id"], cols["formatted"], cols["spans"]):
            found = read_back(text)
            loss = "".join(unescape(text[s["from"]:s["to"]]) for s in spans)
            whole = "".join(f"{role}\n{said}\n" for role, said, _, _ in found)
            yield (conv, len(found), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))

    return map_rows(format_conversations(turns), rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
