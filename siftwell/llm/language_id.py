"""Language identification by cross-parsing entropy.

From a bounded sample of labelled text per language a suffix automaton is built. A text is parsed from left to right
into the longest phrases that the sample holds; phrases times the logarithm of the sample's length, over the text's
length, estimate its entropy given that language, and the lowest wins (ties: the first name). A symbol that the sample
lacks costs its ``LITERAL`` bits besides, so a sample of few symbols does not come out as the shortest code.

Texts are lower-cased; runs of ASCII other than letters are one space. They are parsed in blocks of ``BLOCK``
symbols, all of them, so a long text is many short parses that run side by side and add up.

Null texts and texts without a letter are ``und`` with score 0, as are all texts where nothing could be learned.
Repeated rows get their result each, empty tables an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import text_slices

# Bounds of the labelled sample: texts per language, and leading characters of each.
SAMPLE_TEXTS = 32
SAMPLE_CHARS = 800
BLOCK = 256
# Bits of a symbol that a sample does not hold.
LITERAL = 8
UNKNOWN = "und"

_NEW_PHRASE = np.uint32(1 << 31)
# ASCII other than a to z is space. Other bytes of UTF-8 stand for themselves.
_SYMBOL = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)


class Model(NamedTuple):
    """Per language a table of next states; its high bit says that a phrase ended before this symbol."""

    names: list[str]
    logs: np.ndarray
    codes: np.ndarray
    width: int
    tables: list[np.ndarray]


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads the substrings of ``symbols``; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in following[p]:
            following[p][s] = state
            p = link[p]
        if p >= 0:
            q = following[p][s]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(s) == q:
                    following[p][s] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return following


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts and their borders: one space for a run of spaces, none at the start of a text."""
    symbols = _SYMBOL[data]
    space = symbols == 32
    before = np.empty_like(space)
    before[1:] = space[:-1]
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[starts] = True
    keep = ~(space & before)
    kept = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    return symbols[keep], kept[offsets]


def _table(symbols: bytes, codes: np.ndarray, width: int) -> np.ndarray:
    """The automaton as numbers: ``table[state + code]`` is the next state, states being multiples of ``width``."""
    states = suffix_automaton(symbols)
    start = np.zeros(width, dtype=np.uint32)
    for s, to in states[0].items():
        start[codes[s]] = to * width
    table = np.tile(start | _NEW_PHRASE, (len(states), 1))
    for at, following in enumerate(states):
        for s, to in following.items():
            table[at, codes[s]] = to * width
        table[at, 0] = at * width
    return table.ravel()


def fit(labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from ``text`` and ``lang``: per language the texts whose hash is lowest in each of ``texts`` bins.

    Texts without a letter teach nothing; of the others the characters from the first letter on are taken, at most
    ``texts`` x ``chars`` per language, which come to the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    rows = rows.withColumn("bin", F.pmod("h", F.lit(texts)))
    chosen = rows.groupBy("lang", "bin").agg(F.min("h").alias("h"))
    found = chosen.select("lang", "bin", "h").collect()
    if not found:
        return Model([], np.zeros(0), np.zeros(256, np.uint8), 1, [])
    wanted = labelled.sparkSession.createDataFrame(found, chosen.schema)
    sample = rows.join(F.broadcast(wanted), ["lang", "bin", "h"], "left_semi")
    sample = sample.select("lang", "h", F.lower(F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, chars)).alias("text")).distinct()
    by_lang: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect()):
        data = np.frombuffer(r.text.encode(), dtype=np.uint8)
        by_lang.setdefault(r.lang, []).append(symbols_of(data, np.array([0, len(data)]))[0].tobytes())
    joined = {lang: b" ".join(found) for lang, found in sorted(by_lang.items())}
    alphabet = sorted(set(b"".join(joined.values())))
    codes = np.full(256, 1, dtype=np.uint8)  # 0: padding, 1: a symbol that no language has
    codes[alphabet] = np.arange(2, len(alphabet) + 2)
    width = len(alphabet) + 2
    logs = np.log2([max(len(s), 2) for s in joined.values()])
    return Model(list(joined), logs, codes, width, [_table(s, codes, width) for s in joined.values()])


def phrases(model: Model, symbols: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Phrases of each text under each language."""
    lengths = np.diff(borders)
    blocks = -(-lengths // BLOCK)
    first = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(blocks, out=first[1:])
    counts = np.zeros((len(model.names), len(lengths)), dtype=np.int64)
    if not first[-1]:
        return counts
    lanes = np.zeros((first[-1], BLOCK), dtype=np.uint8)
    where = np.arange(len(symbols)) + np.repeat(first[:-1] * BLOCK - borders[:-1], lengths)
    lanes.reshape(-1)[where] = model.codes[symbols]
    steps = np.ascontiguousarray(lanes.T)
    some = blocks > 0
    for k, table in enumerate(model.tables):
        state = np.zeros(len(lanes), dtype=np.uint32)
        ended = np.ones(len(lanes), dtype=np.int64)
        for codes in steps:
            state += codes
            to = table.take(state)
            ended += to >> np.uint32(31)
            state = to & ~_NEW_PHRASE
        counts[k, some] = np.add.reduceat(ended, first[:-1][some])
    return counts


def missing(model: Model, symbols: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Symbols of each text that the sample of each language lacks."""
    counts = np.zeros((len(model.names), len(borders) - 1), dtype=np.int64)
    codes = model.codes[symbols]
    sums = np.zeros(len(symbols) + 1, dtype=np.int64)
    for k, table in enumerate(model.tables):
        np.cumsum((table[: model.width] >> np.uint32(31))[codes], out=sums[1:])
        counts[k] = np.diff(sums[borders])
    return counts


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        names = np.array([*model.names, UNKNOWN], dtype=object)
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                symbols, borders = symbols_of(data, offsets)
                known = rows.column(2).to_numpy(zero_copy_only=False).astype(bool) & (np.diff(borders) > 0)
                best = np.full(len(known), len(model.names))
                score = np.zeros(len(known))
                if model.names:
                    bits = phrases(model, symbols, borders) * model.logs[:, None] + missing(model, symbols, borders) * LITERAL
                    entropy = bits / np.maximum(np.diff(borders), 1)
                    order = np.sort(entropy, axis=0)
                    best[known] = entropy.argmin(axis=0)[known]
                    others = order[1] if len(order) > 1 else np.full(len(known), np.inf)
                    score[known] = (1 - order[0] / np.maximum(others, 1e-12))[known]
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], schema=_PREDICTED)

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of each document; the score is one less the ratio of lowest to second entropy."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    rows = docs.select("doc_id", F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model) -> DataFrame:
    """Documents in one of the languages, all columns as they were; those that come out as ``und`` go.

    Where no language was learned, those with a letter stay.
    Only the text goes to Python; rows stay where they are, so ids may be null or repeated.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.names:
        return docs.where(letter)
    known = F.arrow_udf(_known(docs.sparkSession.sparkContext.broadcast(tuple(model))), "boolean")
    return docs.where(known(F.lower("text"), letter))


def _known(shared) -> Callable[[pa.Array, pa.Array], pa.Array]:
    predict_rows = _predict(shared)

    def run(text: pa.Array, letter: pa.Array) -> pa.Array:
        asked = pa.RecordBatch.from_arrays([pa.array(range(len(text)), pa.int64()), text, letter], names=["doc_id", "text", "letter"])
        known = [pa.compute.not_equal(found.column(1), UNKNOWN) for found in predict_rows(iter([asked]))]
        return pa.concat_arrays(known) if known else pa.array([], pa.bool_())

    return run
