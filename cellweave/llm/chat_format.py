"""Chat formatting from an event log.

A conversation is a log of events: whole messages, streamed deltas, edits, regenerations and deletions. The log, sorted by
sequence within (conversation, message), is folded into final messages; each is rendered to a piece of the template on its own, and the pieces of
a conversation in order are its formatted text. No step needs a whole conversation in memory.

Template: an assistant's message is `text</s>`, any other is `[ROLE]role[INST]text[/INST]`. A control string or a
backslash inside a role or text gets a backslash behind its first character (a backslash is doubled), so that none is
left, and reading back restores the text exactly. The loss mask covers the assistants' texts without their `</s>`.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ASSISTANT = "assistant"
CONTROL = ("[ROLE]", "[INST]", "[/INST]", "<s>", "</s>")
RESETS = ("message", "edit", "regenerate")
_CONTROL = "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL)
_PIECE = re.compile(r"\[ROLE\](.*?)\[INST\](.*)\[/INST\]", re.S)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of events (conv_id, seq, kind, message, role, text).

    Events of one (conv_id, message) make a message; an event whose message is null is one of its own. In order of seq,
    "message", "edit" and "regenerate" set the text anew, "delta" appends to it, and a "delete" that comes after the last
    of those removes the message; other kinds are ignored. The message stands at its first event's seq, with the first
    role that is not null. Null texts and roles are empty. A null seq comes before all others; among equal seq, kinds that
    set the text come first, deletes last, and texts decide the rest. An empty log gives no rows, repeated whole messages
    stay as often as they occur, other columns are not read.

    The log is dealt by (conversation, message), so that a hot conversation is split, sorted, and folded as a stream: a
    task holds the text of one message.
    """
    known = events.select("conv_id", "seq", "kind", F.col("message").cast("string").alias("message"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = F.when(F.col("kind").isin(*RESETS), 0).when(F.col("kind") == "delta", 1).when(F.col("kind") == "delete", 2)
    known = known.withColumn("kind", kind.cast("long")).where("kind is not null")
    alone = known.where("message is null and kind < 2").select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), "text")
    dealt = known.where("message is not null").repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "text", "role")
    return alone.union(dealt.select("conv_id", "message", "seq", "kind", "role", "text").mapInArrow(fold_batches, alone.schema))


def fold_batches(batches):
    """mapInArrow function from (conv_id, message, seq, kind, role, text), sorted, to final messages (conv_id, seq, role, text)."""
    now, state = None, None
    done: list[tuple] = []

    def close():
        if state is not None and not state["gone"]:
            done.append((now[0], state["seq"], state["role"] or "", "".join(state["parts"])))

    for batch in batches:
        for conv, message, seq, kind, role, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if now != (conv, message):
                close()
                now, state = (conv, message), {"seq": seq, "role": None, "parts": [], "gone": False}
            if state["role"] is None:
                state["role"] = role
            if kind == 0:
                state["parts"], state["gone"] = [text], False
            elif kind == 1:
                state["parts"].append(text)
            else:
                state["gone"] = True
        types = [batch.schema.field(k).type for k in (0, 2, 4, 5)]
        yield pa.record_batch([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], ["conv_id", "seq", "role", "text"])
        done.clear()
    close()
    if done:
        yield pa.record_batch([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], ["conv_id", "seq", "role", "text"])


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_CONTROL})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text, piece, loss_start, loss_length): each message's part of its formatted conversation.

    loss_start and loss_length (code points of the piece; null where there is no loss) are the mask.
    """
    body, is_reply = escape(F.col("text")), F.col("role") == ASSISTANT
    made = messages.withColumn("body", body)
    other = F.concat(F.lit("[ROLE]"), escape(F.col("role")), F.lit("[INST]"), F.col("body"), F.lit("[/INST]"))
    return made.select(
        "conv_id", "seq", "role", "text", F.when(is_reply, F.concat("body", F.lit("</s>"))).otherwise(other).alias("piece"),
        F.when(is_reply, F.lit(0)).alias("loss_start"), F.when(is_reply, F.length("body")).alias("loss_length"),
    )


def conversations(pieces: DataFrame, most_chars: int = 1 << 24) -> DataFrame:
    """(conv_id, part, formatted, loss_spans) of all conversations; loss_spans are code points of the part.

    A conversation is one part, numbered 0, unless it has over most_chars code points: then each part is of whole
    messages that begin within the same most_chars. The parts in order are the formatted text.
    """
    order = ["seq", "role", "text", "piece", "loss_length"]
    at = F.coalesce(F.sum(F.length("piece").cast("long")).over(W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("part", F.floor(at / most_chars).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct(*order)))
    whole = rows.groupBy("conv_id", "part").agg(parts.alias("parts"))
    step = lambda a, p: F.struct(
        (a.at + F.length(p.piece)).alias("at"),
        F.when(p.loss_length.isNull(), a.spans).otherwise(F.concat(a.spans, F.array(F.struct(a.at.alias("start"), (a.at + p.loss_length).alias("end"))))).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return whole.select("conv_id", "part", F.array_join(F.transform("parts", lambda p: p.piece), "").alias("formatted"), F.aggregate("parts", zero, step).spans.alias("loss_spans"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every message of a formatted conversation."""
    out = []
    for part in re.findall(r"\[ROLE\].*?\[INST\].*?\[/INST\]|.*?</s>", formatted, re.S):
        got = _PIECE.fullmatch(part)
        out.append((unescape(got[1]), unescape(got[2])) if got else (ASSISTANT, unescape(part.removesuffix("</s>"))))
    return out


def digest_batches(batches):
    """mapInArrow function from (conv_id, piece, loss_start, loss_length), sorted, to DIGEST: a running fold by conversation."""
    now, seen = None, False
    turns = loss = None
    n_turns = loss_chars = chars = 0
    done: list[list] = [[] for _ in range(6)]

    def close():
        for column, value in zip(done, (now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True):
            column.append(value)

    def out():
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(done, types, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])
        for column in done:
            column.clear()
        return batch

    for batch in batches:
        for conv, piece, start, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if not seen or conv != now:
                if seen:
                    close()
                now, seen, n_turns, loss_chars, chars = conv, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            ((role, text),) = read_back(piece)
            n_turns += 1
            chars += len(piece)
            turns.update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = unescape(piece[start : start + length])
                loss_chars += len(masked)
                loss.update(masked.encode())
        yield out()
    if seen:
        close()
        yield out()


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from its pieces in order of (seq, role, text): see DIGEST.

    The order of a hash makes a conversation's pieces pass through one task, but as a stream: memory holds one piece.
    A null conv_id is a conversation of its own.
    """
    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")
    return rows.select(F.col("conv_id").cast("long"), "piece", "loss_start", "loss_length").mapInArrow(digest_batches, DIGEST)
