"""Packing by concatenation and cutting.

Documents are tokenised once, by tasks that also number the tokens of their own partition, and written to the shared
folder. Partition totals (one row each) are summed up in order, which gives every document its global offset; windows
of fixed length then cut it, one row per piece. Only the last sequence needs padding.

Null text is empty: such a document is the end token alone. Repeated rows are packed each. Empty tables give empty
results; other columns of the input are ignored. A long text is tokenised by itself and cut inside its row.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import Words, byte_spans, checkpointed, small, text_slices, written

SEQUENCE = 2048
END_ID = 1
# Words whose tokens a worker remembers.
REMEMBERED = 400_000
# Marks that the vocabulary keeps apart from a letter before them; those of its special tokens are not among them.
MARKS = ".,!?;:*$%&#"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARK = np.isin(np.arange(256), list(MARKS.encode()))

_TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_TOKENS_DDL = "doc_id long, part long, place long, n long, ids binary"


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that are tokenised by themselves: lowered bytes, where each starts and ends, and the rows' borders.

    A piece is a word, or a word's stem, or the marks behind it. ASCII letters are lowered unless something that may
    combine with them follows or the bytes hold a control string.
    """
    words = Words(data, offsets)
    starts, ends = words.starts, words.ends
    if b"<|" not in data.tobytes():
        alone = np.append(data[1:] < 0x80, True)
        data = np.where((data >= 65) & (data <= 90) & alone, data | 0x20, data)
    other = np.maximum.accumulate(np.where(_MARK[data], 0, np.arange(len(data))))
    stems = other[ends - 1] + 1
    last, before = data[np.maximum(stems - 1, 0)], data[np.maximum(stems - 2, 0)]
    letter = ((last | 0x20) >= 97) & ((last | 0x20) <= 122)
    letter |= (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (stems - 2 >= starts)
    marked = (stems < ends) & (stems > starts) & letter
    at = np.arange(len(starts)) + np.cumsum(marked) - marked
    n = len(starts) + int(marked.sum())
    begin, end = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    begin[at], end[at] = starts, np.where(marked, stems, ends)
    begin[at[marked] + 1], end[at[marked] + 1] = stems[marked], ends[marked]
    return data, begin, end, np.append(at, n)[words.first]


def _tokenise(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens of each text, by words.

    The vocabulary drops white space and never joins across it, so the tokens of a text are those of its words; each
    different word (by a 64-bit hash within a slice of texts) goes through the tokenizer once. It lowers case, and a run
    of marks after a letter stands by itself, so words that differ in these alone share a stem. A stem of Latin letters
    alone is one word of the tokenizer's model, which takes it without the rules that split and normalise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model = tokenizer.model
        # Letters as the model sees them.
        letters = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        packed_ids = [struct.pack("<I", i) for i in range(tokenizer.get_vocab_size())]
        part, place = TaskContext.get().partitionId(), 0
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                data, begin, end, borders = _pieces(data, offsets)
                _, first, which = np.unique(byte_spans(data, begin, end), return_index=True, return_inverse=True)
                if len(known) > REMEMBERED:
                    known = {}
                raw = data.tobytes()
                different = [raw[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
                rest = []
                for piece in different:
                    if piece in known:
                        continue
                    text = piece.decode()
                    if _LATIN.fullmatch(text):
                        text = text.lower() if piece.isascii() else text.lower().translate(letters)
                        known[piece] = b"".join([packed_ids[token.id] for token in model.tokenize(text)])
                    else:
                        rest.append(piece)
                for piece, got in zip(rest, tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False), strict=True):
                    known[piece] = b"".join([packed_ids[i] for i in got.ids])
                blobs = [known[piece] for piece in different]
                flat = np.frombuffer(b"".join(blobs), dtype="<u4")
                sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
                lengths = sizes[which]
                tos = np.concatenate([[0], np.cumsum(lengths)])
                shift = (np.cumsum(sizes) - sizes)[which] - tos[:-1]
                n = np.diff(tos[borders]) + 1
                ends = np.cumsum(n)
                inner = np.ones(int(ends[-1]), dtype=bool)
                inner[ends - 1] = False
                ids = np.full(len(inner), end_id, dtype="<u4")
                ids[inner] = flat[np.arange(tos[-1]) + np.repeat(shift, lengths)]
                edges = np.concatenate([[0], ends * 4]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                places = place + ends - n
                place += int(ends[-1])
                columns = [rows.column(0).cast(pa.int64()), pa.array(np.full(len(n), part)), pa.array(places), pa.array(n), binary]
                yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS)

    return run


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, place, n, ids``: token ids (little-endian, 32 bits) and where they lie in their partition."""
    return written(docs.select("doc_id", "text").mapInArrow(_tokenise(path, end_id), _TOKENS_DDL), "tokens")


def _piece(window: Column, offset: Column, n: Column, ids: Column, length: int) -> Column:
    start = F.greatest(window * length - offset, F.lit(0))
    stop = F.least((window + 1) * length - offset, n)
    cut = ids.substr((start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int"))
    return F.struct(
        start.alias("start"), (stop - start).alias("length"), F.crc32(cut).alias("ids_crc32"), cut.alias("ids"),
        window.alias("sequence_id"), (offset + start - window * length).alias("offset"),
    )


def packed(tokens: DataFrame, length: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Pieces of ``tokenised`` documents in sequences of ``length`` tokens.

    ``sequence_id`` and ``offset`` say where a piece lies; a document that crosses a border has a piece on either side.
    The first pass reads lengths only. Its result has a row per partition of the written table.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = checkpointed(totals.select("part", before.alias("base")))
    placed = tokens.join(small(bases), "part").withColumn("at", F.col("base") + F.col("place"))
    windows = F.sequence((F.col("at") / length).cast("long"), ((F.col("at") + F.col("n") - 1) / length).cast("long"))
    cut = F.transform(windows, lambda w: _piece(w, F.col("at"), F.col("n"), F.col("ids"), length))
    pieces = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(cut).alias("p"))
    columns = ["p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *(["p.ids"] if with_ids else [])]
    return pieces.select("doc_id", *columns)


def pack(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenise and pack. ``path`` names a tokenizer file whose tokens never cross white space."""
    return packed(tokenised(docs, path, end_id), length, with_ids)
