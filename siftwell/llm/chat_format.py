"""Chat formatting with typed content parts.

A visitor turns the parts of a message into text with one ordered placeholder per image, audio clip and document, and
records each attachment with its reference, place and expanded token count. Parts of text that follow each other keep
their border as ``<|text|>``. Control strings inside texts are escaped: ``<``, any backslashes, ``|`` gets one
more backslash, which reading takes away again.

Formatting is one projection per turn. A conversation is its turns in order; ``read_back`` streams them, so neither
operator holds a whole conversation.

Null text or no parts: empty text. Null role: empty role. Null ``conv_id``: a conversation of its own. Turns are
ordered by ``turn`` (null first), then by their formatted text; repeated rows are turns of their own. Empty tables give
empty results; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_CONTROL = re.compile(r"<\|(im_start|im_end|text|image|audio|document)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|")


class Expansion(NamedTuple):
    """How many tokens an attachment stands for."""

    pixels: int = 28
    audio_per_second: float = 25.0
    per_page: int = 256

    def tokens(self, part: Column) -> Column:
        tiles = F.ceil(part["width"] / self.pixels) * F.ceil(part["height"] / self.pixels)
        counted = (
            F.when(part["kind"] == "image", tiles)
            .when(part["kind"] == "audio", F.ceil(part["seconds"] * self.audio_per_second))
            .when(part["kind"] == "document", part["pages"].cast("long") * self.per_page)
        )
        return F.greatest(F.coalesce(counted, F.lit(0)).cast("long"), F.lit(1).cast("long"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    """A role stays on its line: backslashes and line feeds are written as two characters."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    null = lambda kind: F.lit(None).cast(kind)
    fields = {"kind": F.lit("text"), "text": text, "ref": null("string"), "width": null("int"), "height": null("int"), "seconds": null("double"), "pages": null("int")}
    return F.array(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _visit(part: Column, at: Column, parts: Column) -> Column:
    """One part as formatted text."""
    again = (at > 0) & (F.get(parts, at - 1)["kind"] == "text")
    written = F.concat(F.when(F.coalesce(again, F.lit(False)), F.lit("<|text|>")).otherwise(F.lit("")), escape(F.coalesce(part["text"], F.lit(""))))
    return F.when(part["kind"].isin(*KINDS), F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(written)


def format_turns(messages: DataFrame, expansion: Expansion = Expansion()) -> DataFrame:
    """``conv_id, turn, role, parts`` to one formatted piece per turn.

    ``formatted`` pieces of a conversation, in order and with nothing between, are its text. ``loss_start`` and
    ``loss_length`` (code points) mark what an assistant turn is trained on; ``attachments`` hold ``kind, ref, place``
    (code points into the piece) and ``tokens``. Kinds other than the four count as text.
    """
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    parts = F.coalesce("parts", F.array().cast(PARTS_TYPE))
    flat = messages.select("conv_id", "turn", "role", head.alias("head"), parts.alias("parts"))
    flat = flat.withColumn("written", F.transform("parts", lambda p, i: _visit(p, i, F.col("parts"))))
    body = F.array_join("written", "")

    def attachment(part: Column, at: Column) -> Column:
        before = F.array_join(F.slice(F.col("written"), F.lit(1), at), "")
        place = (F.length("head") + F.length(before)).cast("long")
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), place.alias("place"), expansion.tokens(part).alias("tokens"))

    found = F.transform("parts", lambda p, i: F.when(p["kind"].isin(*KINDS), attachment(p, i)))
    return flat.select(
        "conv_id", "turn", "role", F.concat("head", body, F.lit(END + "\n")).alias("formatted"),
        F.length("head").cast("long").alias("loss_start"),
        F.when(F.col("role") == "assistant", F.length(body)).otherwise(0).cast("long").alias("loss_length"),
        F.filter(found, lambda a: a.isNotNull()).alias("attachments"),
    )


def read_turn(piece: str) -> tuple[str, list[str]]:
    """Role and contents of a formatted piece: unescaped texts, and the control strings of attachments."""
    marks = list(_CONTROL.finditer(piece))
    if not marks or marks[0].span() != (0, len(START)) or marks[-1].group() != END or marks[-1].end() != len(piece) - 1:
        raise ValueError("not a formatted turn")
    role_end = piece.index("\n")
    contents, at = [], role_end + 1
    for mark in marks[1:]:
        contents.append(unescape(piece[at : mark.start()]))
        if mark[1] in KINDS:
            contents.append(mark.group())
        at = mark.end()
    return unescape_role(piece[len(START) : role_end]), contents


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces come one after another; only hash states are kept."""
    open_id: object = _digests
    turns = loss = None
    n = loss_chars = chars = 0
    for batch in batches:
        done: list[tuple] = []
        for conv, piece, start, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if conv != open_id or turns is None:
                if turns is not None:
                    done.append((open_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                open_id, turns, loss, n, loss_chars, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            role, contents = read_turn(piece)
            turns.update(f"{role}\n{''.join(contents)}\n".encode())
            masked = unescape(piece[start : start + length])
            loss.update(masked.encode())
            n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + len(piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
    if turns is not None:
        last = (open_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
        yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(last, _DIGEST, strict=True)], schema=_DIGEST)


def read_back(turns: DataFrame) -> DataFrame:
    """What formatted conversations say, read from the formatted pieces alone: one row per conversation.

    A digest needs its conversation in order, so a conversation stays in one task; its rows are sorted outside of memory
    where needed and pass as a stream.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    pieces = ordered.select(F.col("conv_id").cast("long"), "formatted", "loss_start", "loss_length")
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return pieces.mapInArrow(_digests, kinds)
