"""Chat formatting with typed content parts.

A visitor turns each part of a turn (text, image, audio, document) into what stands in the formatted
conversation: text is escaped, every other part leaves an ordered placeholder, an attachment reference and the
number of tokens that it will expand to. All formatting is Column expressions; a turn is one output row, so a
conversation of any length is never held as one value.

Defined results: a null text or role counts as the empty string, a null parts array as no parts, an unknown kind of
part as a document without pages. A null conversation id is a conversation of its own. Turns sort by (order column
with nulls first, role, text), so repeated rows and ties give the same output on each run. An empty table gives no
rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
OPEN, MID, CLOSE = "<s>[ROLE]", "[/ROLE]\n", "</s>\n"
_BODY = r"(?:[^\\<\[]|\\.|<(?:image|audio|document) \d+\.\d+>)*"
TURN = re.compile(rf"{re.escape(OPEN)}({_BODY}){re.escape(MID)}({_BODY}){re.escape(CLOSE)}", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    """Control strings all begin with < or [: a backslash before these, and before backslashes, hides them."""
    return F.regexp_replace(text, r"[\\<\[]", r"\\$0")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class PartVisitor:
    """What each kind of part becomes: (rendered text, reference, expanded tokens)."""

    patch: int = 14
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 256

    def text(self, part: Column, at: Column) -> tuple[Column, Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("string"), F.lit(0).cast("long")

    def _attached(self, kind: str, part: Column, at: Column, tokens: Column) -> tuple[Column, Column, Column]:
        mark = F.concat(F.lit(f"<{kind} "), at, F.lit(">"))
        return mark, F.coalesce(part["ref"], F.lit("")), F.coalesce(tokens, F.lit(0)).cast("long")

    def image(self, part: Column, at: Column) -> tuple[Column, Column, Column]:
        tiles = F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch)
        return self._attached("image", part, at, tiles)

    def audio(self, part: Column, at: Column) -> tuple[Column, Column, Column]:
        return self._attached("audio", part, at, F.ceil(part["seconds"] * self.audio_tokens_per_second))

    def document(self, part: Column, at: Column) -> tuple[Column, Column, Column]:
        return self._attached("document", part, at, part["pages"] * self.tokens_per_page)

    def visit(self, part: Column, at: Column) -> Column:
        def record(kind: str) -> Column:
            rendered, ref, tokens = getattr(self, kind)(part, at)
            return F.struct(
                rendered.alias("rendered"), F.lit(kind).alias("kind"), at.alias("at"), ref.alias("ref"), tokens.alias("tokens")
            )

        chosen = F.when(part["kind"] == "text", record("text")).when(part["kind"] == "image", record("image"))
        return chosen.when(part["kind"] == "audio", record("audio")).otherwise(record("document"))


def text_parts(text: Column) -> Column:
    """The parts array of a turn that is only text."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(text, F.lit("")).alias("text"),
        *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))),
    )
    return F.array(part)


def format_turns(
    rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", parts: str = "parts", visitor: PartVisitor | None = None
) -> DataFrame:
    """One row per turn: conv_id, pos, role, segment, loss_start, loss_end, attachments, expanded_tokens.

    Joined in the order of pos, the segments of a conversation are its formatted text; [loss_start, loss_end) in code
    points of the segment is under the loss mask (the body of assistant turns, without markers).
    """
    visitor = visitor or PartVisitor()
    turns = rows.select(
        F.col(conv).alias("conv_id"), F.col(order).alias("_turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(PARTS_TYPE)).alias("_parts"),
    )
    inside = Window.partitionBy("conv_id").orderBy("_turn", "role", F.to_json("_parts"))
    turns = turns.withColumn("pos", F.row_number().over(inside) - 1)
    visited = F.transform("_parts", lambda p, i: visitor.visit(p, F.concat_ws(".", F.col("pos").cast("string"), i.cast("string"))))
    turns = turns.withColumn("_seen", visited)
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID))
    turns = turns.withColumn("_body", F.array_join(F.transform("_seen", lambda s: s["rendered"]), ""))
    start = F.when(F.col("role") == "assistant", F.length(head))
    attached = F.filter("_seen", lambda s: s["kind"] != "text")
    return turns.select(
        "conv_id", "pos", "role", F.concat(head, "_body", F.lit(CLOSE)).alias("segment"),
        start.alias("loss_start"), (start + F.length("_body")).alias("loss_end"),
        F.transform(attached, lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["ref"].alias("ref"), s["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, s: n + s["tokens"]).alias("expanded_tokens"),
    )


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read formatted turns back, conversation by conversation, with one running state."""
    state, out, none = None, [], object()
    current = none

    def closed() -> dict:
        n, turns, chars, loss, formatted = state
        return {"conv_id": current, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}

    for batch in batches:
        for conv, segment, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
            if current is none or conv != current:
                if current is not none:
                    out.append(closed())
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            match = TURN.fullmatch(segment)
            if match is None:
                raise ValueError(f"turn of conversation {conv} can't be read back")
            role, text = unescape(match[1]), unescape(match[2])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = unescape(segment[start:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(segment)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
            out = []
    if current is not none:
        yield pa.RecordBatch.from_pylist([closed()], schema=_DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation, what reading its formatted turns back gives. Turns stream through in order; none are collected."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "segment", "loss_start", "loss_end")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
