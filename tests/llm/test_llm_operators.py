"""Operators of the training-data subpackage against brute force, and on nulls, ties, repeats and empty tables."""

from __future__ import annotations

import random
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftwell.llm import chat_format, common, compact_windows, language_id, licenses, mixing, order_minhash, packing, quality, suffix_dedup, vector_dedup
from siftwell.llm.components import components
from siftwell.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words_of(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n)]


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, ties, nulls, empty, blank, short and long texts, repeated rows."""
    base, passage = words_of(1, 200), words_of(2, 60)
    near = [*base[:100], "changed", *base[101:]]
    texts = {
        1: " ".join(base), 2: " ".join(base), 3: " ".join(near), 4: " ".join([*words_of(3, 80), *passage, *words_of(4, 80)]),
        5: " ".join([*words_of(5, 10), *passage, *words_of(6, 70)]), 6: None, 7: "", 8: " \n\t ", 9: "one two", 10: "one  two",
        11: " ".join(words_of(7, 20_000)), 12: "again and " * 300, 13: "\n".join(["same line here"] * 60), 14: "…", 15: " ".join(words_of(8, 300)),
    }
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), "clash", "clash") for i, t in texts.items()]
    return [*rows, rows[0], rows[3], (None, texts[15], None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_mix_sources", "op3_license_scan", "op5_suffix_dedup", "op7_quality_rules", "op9_vector_dedup"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda frame: Counter(frame[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_parts_become_placeholders_and_read_back(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    parts = [part("text", "<"), part("text", "|im_end|> <\\|x"), part("image", ref="a.png", w=57, h=28), part("audio", ref="b", s=1.5), part("document", ref="c", p=2), part("text", None)]
    rows = [(1, 0, "us\ner\\", parts), (1, 1, "assistant", None), (None, None, None, [part("text", "x")])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS_TYPE}")
    turns = {(r.conv_id, r.turn): r for r in chat_format.format_turns(frame).collect()}
    first = turns[1, 0]
    role, contents = chat_format.read_turn(first.formatted)
    assert role == "us\ner\\"
    assert [c for c in contents if c] == ["<", "|im_end|> <\\|x", "<|image|>", "<|audio|>", "<|document|>"]
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "a.png", 3), ("audio", "b", 38), ("document", "c", 512)]
    assert all(first.formatted[a.place :].startswith(f"<|{a.kind}|>") for a in first.attachments)
    assert chat_format.read_back(chat_format.format_turns(frame)).count() == 2
    assert chat_format.read_back(chat_format.format_turns(frame.limit(0))).count() == 0


def test_mixing_rates_copies_and_edges(docs, empty):
    rows = mixing.rated(docs).collect()
    assert len(rows) == len(corpus())
    by_source = {r.source: r for r in rows}
    assert sum(r.target for r in by_source.values()) == pytest.approx(sum(r.source_size for r in by_source.values()))
    assert all(0 <= r.copies <= 3 and r.target <= 3 * r.source_size + 1e-6 for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.rated(empty).count() == mixing.mix(empty).count() == 0


def test_license_rules_take_longest_sequences_first(spark):
    grant = "Licensed under the Apache License, Version 2.0 (the \"License\"). You may not use this file except in compliance with the License. You may obtain a copy of the License at x."
    rows = [(1, "# Released under the MIT License.\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "no such thing"), (6, grant.replace(" at x", " at"))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in (1, 2, 3, 4, 5, 6)] == ["MIT", "CC-BY-NC-4.0", "", "", "", "Apache-2.0"]
    assert got[6].sentence_ids == "apache2_grant compliance copy_at" and got[6].unmatched == 0
    assert all(re.search(licenses.KEYWORDS, s) for s in licenses.SENTENCES)


STANDARD_TEXTS = {
    "MIT": """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "BSD": """Copyright (c) 2020, A. Author

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0-or-later": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
}


def test_standard_licence_texts_wrapped_and_unwrapped(spark):
    rows, want = [], {}
    for name, text in STANDARD_TEXTS.items():
        for width, mark in ((None, ""), (70, ""), (78, ""), (60, " * "), (40, "# ")):
            lines = [x for line in text.split("\n") for x in (textwrap.wrap(line, width) or [""] if width else [line])]
            want[len(rows)] = name
            rows.append((len(rows), "\n".join(mark + x for x in lines)))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == want
    assert {r.unmatched for r in got.values()} == {0}


def test_packing_is_exact(docs, empty):
    pieces = packing.pack(docs, TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, *_ in corpus())
    pieces.sort(key=lambda p: (p.sequence_id, p.offset))
    at = 0
    got, open_doc = Counter(), []
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4")
        assert (p.sequence_id, p.offset) == divmod(at, 2048) and len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        at += p.length
        assert p.start == len(open_doc)
        open_doc += ids.tolist()
        if len(open_doc) == p.doc_tokens:
            got[p.doc_id, tuple(open_doc)] += 1
            open_doc = []
    assert got == want and not open_doc
    assert packing.pack(empty, TOKENIZER).count() == 0


def spans_by_brute_force(rows: list[tuple], size: int = 50) -> set[tuple]:
    seen: dict[tuple, set] = {}
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k : k + size]), set()).add(-1 if i is None else i)
    covered = set()
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - size + 1):
            ids = seen[tuple(w[k : k + size])]
            if len(ids) > 1:
                covered |= {(i, j, (-1 if i is None else i) != min(ids)) for j in range(k, k + size)}
    return covered


def test_repeated_passages_equal_brute_force(docs, empty, monkeypatch):
    want = spans_by_brute_force(corpus())
    for hot in (2000, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = {(r.doc_id, j, r.redundant) for r in suffix_dedup.repeated_passages(docs).collect() for j in range(r.start_word, r.end_word)}
        assert got == want
    assert suffix_dedup.repeated_passages(empty).count() == 0
    cut = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).where("doc_id is not null").collect()}
    assert 2 not in cut and len(WORD.findall(cut[5].text)) == 80 and cut[4].text == dict((r[0], r[1]) for r in corpus())[4]
    assert cut[6].text is None and cut[5].n_chars == len(cut[5].text)


def test_near_duplicates_classes(docs, empty):
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in (1, 2, 3)] == [1, 1, 1] and got[9] == got[10] == 9
    assert all(got[i] == i for i in (4, 5, 6, 7, 8, 11, 12, 13, 14))
    assert order_minhash.near_duplicates(docs).count() == len(corpus())
    kept = [r.doc_id for r in order_minhash.one_of_each(docs).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14]
    assert order_minhash.near_duplicates(empty).count() == order_minhash.one_of_each(empty).count() == 0


def test_near_duplicate_classes_equal_all_pairs(spark):
    rng, texts = random.Random(9), []
    for family in range(8):
        base = words_of(5000 + family, 120)
        texts += [[w if rng.random() > 0.02 else f"new{len(texts)}x{k}" for k, w in enumerate(base)] for _ in range(6)]
    shingles = [[" ".join(w[k : k + 5]) for k in range(len(w) - 4)] for w in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(shingles):
        for j, y in enumerate(shingles[:i]):
            if not set(x) & set(y):
                continue
            row = [0] * (len(y) + 1)
            for a in x:
                new = [0]
                for at, b in enumerate(y):
                    new.append(row[at] + 1 if a == b else max(row[at + 1], new[at]))
                row = new
            if row[-1] >= 0.8 * (len(x) + len(y) - row[-1]) - 1e-9:
                low, high = sorted((label[i], label[j]))
                label = [low if n == high else n for n in label]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame).collect()} == dict(enumerate(label))
    assert 8 < len(set(label)) < len(texts)


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 6, rng.integers(1, 25)).astype(np.int32)
        y = x[rng.random(len(x)) > 0.1] if rng.random() < 0.7 else rng.integers(0, 6, rng.integers(1, 25)).astype(np.int32)
        if not len(y):
            continue
        m = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                m[i + 1, j + 1] = m[i, j] + 1 if a == b else max(m[i, j + 1], m[i + 1, j])
        lcs = m[-1, -1]
        assert order_minhash.aligned(x, y) == (lcs / (len(x) + len(y) - lcs) >= 0.8 - 1e-12)


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(100):
        borders = np.concatenate([[0], np.cumsum(rng.integers(0, 12, 4))])
        values = rng.integers(1, 9, borders[-1]).astype(np.uint64)
        want = set()
        for k in range(4):
            x = values[borders[k] : borders[k + 1]].tolist()
            for c in range(len(x)):
                low = next((i + 1 for i in range(c - 1, -1, -1) if x[i] <= x[c]), 0)
                high = next((i - 1 for i in range(c + 1, len(x)) if x[i] < x[c]), len(x) - 1)
                if high - low + 1 >= 3:
                    want.add((k, low, c, high))
        assert set(zip(*(a.tolist() for a in compact_windows.compact_windows(values, borders, 3)), strict=True)) == want


def test_near_passages_are_found(docs, empty):
    rows = compact_windows.near_passages(docs).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in rows}
    assert {frozenset((1, 2)), frozenset((4, 5))} <= pairs and {3} <= {r.doc_id for r in rows} | {r.other_id for r in rows}
    assert not {i for p in pairs for i in p} & {6, 7, 8, 9, 10, 11, 14}
    shared = next(r for r in rows if {r.doc_id, r.other_id} == {4, 5})
    assert (shared.end_word - shared.start_word) >= 50
    assert compact_windows.near_passages(empty).count() == 0


def passages_around(line: list[str], seed: int) -> list[tuple[int, str]]:
    """Pairs ``2k, 2k + 1`` of texts that share 50 words around a line which all of them hold."""
    texts = []
    for k in range(12):
        before, after = words_of(seed + 10 * k, 5), words_of(seed + 10 * k + 1, 5)
        texts += [(2 * k + i, " ".join([*words_of(seed + 10 * k + 2 + i, 60), *before, *line, *after, *words_of(seed + 10 * k + 4 + i, 60)])) for i in (0, 1)]
    return texts


def test_near_passages_beside_a_frequent_line(spark):
    rows = compact_windows.near_passages(spark.createDataFrame(passages_around(words_of(99, 40), 1000), "doc_id long, text string")).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in rows}
    assert {frozenset((2 * k, 2 * k + 1)) for k in range(12)} <= pairs


def test_near_passages_at_later_places_of_a_text(spark):
    texts = []
    for k in range(12):
        line, at = words_of(2000 + k, 40), 3000 + 10 * k
        passage = [*words_of(at, 5), *line, *words_of(at + 1, 5)]
        texts += [(2 * k, " ".join([*line, *words_of(at + 2, 150), *passage, *words_of(at + 3, 60)])), (2 * k + 1, " ".join([*line, *words_of(at + 4, 150), *passage, *words_of(at + 5, 60)]))]
    rows = compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {frozenset((2 * k, 2 * k + 1)) for k in range(12)} <= {frozenset((r.doc_id, r.other_id)) for r in rows}


def test_near_passages_of_varied_copies_equal_brute_force(spark):
    rng, base, texts = random.Random(5), words_of(4000, 120), []
    for i in range(40):
        copy = [w if rng.random() > 0.03 else f"new{i}" for w in base]
        texts.append((i, [*words_of(4100 + i, 30), *copy, *words_of(4200 + i, 30)]))
    shingles = [np.array([zlib.crc32(" ".join(w[k : k + 5]).encode()) for k in range(len(w) - 4)], dtype=np.uint32).view(np.int32) for _, w in texts]
    # Words are only replaced, so shingles are aligned where they stand.
    want = set()
    for i, x in enumerate(shingles):
        for j, y in enumerate(shingles[:i]):
            equal = np.concatenate([[0], np.cumsum(x == y)])
            if any((m := equal[k:] - equal[:-k])[m >= 0.8 * (2 * k - m) - 1e-9].size for k in range(46, len(x) + 1)):
                want |= {i, j}
    rows = compact_windows.near_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")).collect()
    assert {n for r in rows for n in (r.doc_id, r.other_id)} == want


def test_languages_by_held_out_accuracy(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_language_id"](spark, sf_dir).join(table, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (6, 7, 8, 14)] == ["und"] * 4 and got[1].lang_pred == "en"
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    assert language_id.keep_languages(docs, model).columns == docs.columns


def test_labels_with_hardly_any_text_attract_nothing(spark):
    rows = [(k, " ".join(words_of(500 + k, 100)), "en") for k in range(8)]
    rows += [(20, "", "none"), (21, "ok", "two"), (22, "hola", "four"), (23, " 12 ", "blank"), (24, " " * 900 + " ".join(words_of(600, 100)), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    assert model.names == ["en", "four", "two"]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(frame, model).collect()}
    assert [got[k] for k in (*range(8), 24)] == ["en"] * 9 and got[21] == "two" and got[22] == "four"
    assert language_id.fit(frame.where("doc_id = 24").withColumn("lang", F.lit("late"))).names == ["late"]


def test_without_labels_documents_with_letters_stay(spark, sf_dir, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, bare, sf_dir)
    assert kept.columns == docs.columns
    ids = lambda rows: Counter(r[0] for r in rows)
    assert ids(kept.select("doc_id").collect()) == ids(r for r in corpus() if re.search("[a-z]", r[1] or ""))


def test_only_texts_go_to_python_where_languages_are_kept(spark, docs):
    model = language_id.fit(docs)
    kept = language_id.keep_languages(docs, model)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert sorted(kept.collect(), key=str) == sorted((r for r in docs.collect() if re.search("[a-z]", r.text or "")), key=str)
    assert language_id.keep_languages(docs.limit(0), model).count() == 0


def test_sketches_hold_a_bounded_part_of_a_batch():
    rows = pa.RecordBatch.from_pydict({"id": list(range(40)), "th": list(range(40)), "text": [" ".join(words_of(k, 12_000)) for k in range(40)]})
    assert rows.column(2).nbytes > 2 * order_minhash.NARROW_BYTES
    sketch = order_minhash._sketch(5, 16, 3, 11)
    alone = [r for k in range(40) for b in sketch(iter([rows.slice(k, 1)])) for r in b.to_pylist()]
    tracemalloc.start()
    together = [r for b in sketch(iter([rows])) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert together == alone and most < 60 * order_minhash.NARROW_BYTES


def test_written_tables_meet_python_in_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    wide = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 3400).alias("text")).mapInArrow(sizes, "bytes long")
    most = lambda df: max(r.bytes for r in df.collect())
    before = spark.conf.get(common.BATCH_SETTING)
    assert most(wide) > 20_000_000 and most(common.written(wide, "sizes")) < 5_000_000 and most(common.checkpointed(wide)) < 5_000_000
    assert spark.conf.get(common.BATCH_SETTING) == before and spark.conf.get(common.BATCH_SETTING, None) is None
    spark.conf.set(common.BATCH_SETTING, "8m")
    assert 5_000_000 < most(common.written(wide, "sizes")) < 9_000_000 and spark.conf.get(common.BATCH_SETTING) == "8m"
    spark.conf.unset(common.BATCH_SETTING)


def test_suffix_automaton_reads_exactly_the_substrings():
    text = b"abcbcabbaacab"
    states = language_id.suffix_automaton(text)
    for candidate in {text[i:j] for i in range(13) for j in range(i + 1, 14)} | {b"aaa", b"cc", b"abab"}:
        at = 0
        for s in candidate:
            at = states[at].get(s) if at is not None else None
        assert (at is not None) == (candidate in text)


def test_vectors_that_cannot_link(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [1.0, 0.0]), (8, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.n_links, r.component_id) for r in vector_dedup.linked(frame).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 2, 1), (8, 0, 8)}
    assert vector_dedup.linked(frame.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_quality_edges(docs, empty):
    got = {r.doc_id: r for r in quality.quality(docs).where("doc_id is not null").collect()}
    assert [got[i].n_words for i in (6, 7, 8, 9)] == [0, 0, 0, 2] and got[12].n_repeat_words == 600 and got[12].base_failed
    assert got[13].n_dup_lines == 59 and not got[6].kept
    assert quality.quality(empty).count() == 0


def test_pipeline_hands_on_what_a_stage_wrote(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read = []

    def seen(spark, rows, sf_dir):
        read.append(rows.inputFiles())
        return rows.withColumn("node", F.expr("uuid()"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first one", seen), ("second", seen), ("third", lambda _, rows, __: rows)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(out.collect(), key=str) == sorted(out.collect(), key=str)
    assert "siftwell-first-one-" in read[1][0] and "siftwell-third-" in out.inputFiles()[0]


def test_pipeline_stages(spark, sf_dir, docs, tmp_path):
    for name, rows in (("given", docs), ("none", docs.limit(0))):
        at = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{name}{k}")
            stage(spark, at, sf_dir).write.parquet(out)
            at = spark.read.parquet(out)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == docs.columns
        assert (at.count() > 0) == (name == "given")


def test_columns_with_odd_names_travel_along(spark, docs):
    odd = docs.select("doc_id", "text", "lang", "source", F.col("size").alias("a.b"), F.lit(1).alias("__mix_source"), F.lit("x").alias("row"), F.lit("y").alias("back`tick"))
    model = language_id.fit(odd)
    for changed in (mixing.mix(odd), order_minhash.one_of_each(odd), suffix_dedup.without_repeats(odd), language_id.keep_languages(odd, model)):
        assert changed.columns == odd.columns
        rows = changed.collect()
        assert rows and {(r["a.b"], r["__mix_source"], r["row"], r["back`tick"]) for r in rows} <= {("clash", 1, "x", "y"), (None, 1, "x", "y")}


def test_exact_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 100)
    text, own = " ".join(words_of(7001, 70)), " ".join(words_of(7002, 60))
    rows = [(i, text) for i in range(3000)] + [(9000, " ".join([own] * 20)), (9001, f"{own} {text}")]
    spans = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(i, 0, 70, i > 0) for i in range(3000)} | {(9000, 0, 1200, False), (9001, 0, 60, True), (9001, 60, 130, True)}
    got = set()
    for r in spans:
        got.add((r.doc_id, r.start_word, r.end_word, r.redundant))
    assert {g for g in got if g[0] < 9000} == {w for w in want if w[0] < 9000}
    assert (9001, 0, 130, True) in got or {(9001, 0, 60, True), (9001, 60, 130, True)} <= got


def test_dense_stretches_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(100):
        places = np.flatnonzero(rng.random(int(rng.integers(1, 60))) < rng.random())
        width, density, held, want = int(rng.integers(1, 9)), float(rng.choice([0.5, 0.8])), set(places.tolist()), set()
        for s in held:
            for e in held:
                if e - s + 1 >= width and sum(i in held for i in range(s, e + 1)) >= density * (e - s + 1) - 1e-9:
                    want |= set(range(s, e + 1))
        starts, ends = compact_windows.dense_stretches(places, width, density)
        assert {i for s, e in zip(starts, ends, strict=True) for i in range(s, e)} == want
        shared = rng.random((5, 21)) < rng.random()
        around = [any(r[s] and r[e - 1] and r[s:e].sum() >= 0.8 * (e - s) - 1e-6 for s in range(11) for e in range(max(s + width, 11), 22)) for r in shared]
        assert compact_windows.dense_around(shared, width, 0.8).tolist() == around


def test_near_passages_of_a_repeated_phrase_and_of_lines_among_own_words(spark):
    line, phrase = words_of(8000, 35), words_of(8001, 9)
    texts = [(i, " ".join([*words_of(8100 + i, 60), *line, *words_of(8500 + i, 60)])) for i in range(300)]
    texts += [(1000, " ".join([*words_of(8901, 50), *phrase * 8])), (1001, " ".join([*phrase * 11, *words_of(8902, 120)]))]
    rows = compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in rows} == {frozenset((1000, 1001))}
    assert max(r.end_word - r.start_word for r in rows) >= 72


def chains(spark, count: int, variants: int = 40) -> list[tuple[int, str]]:
    """Texts ``4k .. 4k + 3``, each near to the next one only; by their hashes the first is the least and the last the greatest."""
    texts = []
    for k in range(count):
        base = words_of(9000 + k, 60)
        for i, changed in enumerate(({15: "a"}, {}, {30: "b"}, {30: "b", 15: "c"})):
            passage = [changed.get(p, w) + "new" * (p in changed) for p, w in enumerate(base)]
            texts += [(4 * k + i, " ".join([*words_of(10_000 + 4 * k + i, 30), *passage, f"v{v}"])) for v in range(variants)]
    hashed = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text, false) AS h").collect()
    order = lambda r: (r.h, abs(r.h), abs(r.h), -r.h)[r.doc_id % 4]
    return [min((r.doc_id, order(r), r.text) for r in hashed if r.doc_id == d)[::2] for d in range(4 * count)]


def test_near_passages_link_covered_places_of_different_classes(spark):
    """Both middle texts of a chain are covered by passages with the ends of their group; they are near to each other all the same."""
    rows = compact_windows.near_passages(spark.createDataFrame(chains(spark, 16), "doc_id long, text string")).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in rows}
    missing = [k for k in range(16) for i in range(3) if frozenset((4 * k + i, 4 * k + i + 1)) not in pairs]
    assert not missing and all(len({d // 4 for d in p}) == 1 for p in pairs)


def test_least_places_equal_the_windows_of_the_tree():
    rng = np.random.default_rng(4)
    for k in range(150):
        borders = np.concatenate([[0], np.cumsum(rng.integers(0, 60, 5))])
        values, width = rng.integers(1, (9, 50, 10**9)[k % 3], borders[-1]).astype(np.uint64), int(rng.integers(1, 13))
        row, _, at, high = compact_windows.compact_windows(values, borders, width)
        keep = compact_windows._apart(row, values[borders[row] + at], at, high, width)
        got = compact_windows.least_places(values, borders, width)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(row[keep].tolist(), at[keep].tolist(), strict=True))


def test_tokens_of_two_texts_are_found_and_frequent_ones_pass_their_bucket():
    rng, rows, dealt = np.random.default_rng(5), [], []
    for texts in np.arange(400).reshape(4, 100):
        # Token 7 << 32 stands in every text.
        tokens = np.sort(np.append(rng.integers(0, 900, 500) * 100 + rng.choice(100, 500), np.arange(100)))
        keys, row = tokens.astype(np.uint64) // np.uint64(100) << np.uint64(34), tokens % 100
        keys[:100], row[:100] = np.uint64(7) << np.uint64(32), np.arange(100)
        at = np.arange(len(keys))
        rows += zip(keys.tolist(), texts[row].tolist(), at.tolist(), strict=True)
        dealt.append(compact_windows._dealt(keys, row, texts, at, 3))
    held: dict[int, set[int]] = {}
    for key, doc, _ in rows:
        held.setdefault(key, set()).add(doc)
    batches = [r for b in dealt for r in b.to_pylist()]
    assert sum(k == 7 << 32 for r in batches for k in r["key"]) == 2 * len(dealt)
    got = []
    for bucket in {r["bucket"] for r in batches}:
        group = pa.Table.from_pylist([r for r in batches if r["bucket"] == bucket], schema=compact_windows._DEALT)
        got += [(r["doc"], c) for r in compact_windows._repeated(group).to_pylist() for c in r["c"]]
    assert sorted(got) == sorted((doc, at) for key, doc, at in rows if len(held[key]) > 1)


def test_runs_of_many_pairs_equal_those_of_each():
    rng, pairs = np.random.default_rng(6), []
    for _ in range(60):
        x = rng.integers(-5, rng.integers(2, 40), rng.integers(1, 80)).astype(np.int32)
        y = np.tile(x[rng.random(len(x)) > 0.1], 3) if rng.random() < 0.7 else rng.integers(0, 30, 60).astype(np.int32)
        pairs.append((x, y, int(rng.integers(-90, 90))))
    numbered = lambda side: np.repeat(np.arange(len(pairs)), [len(p[side]) for p in pairs])
    x, y = (np.concatenate([p[side] for p in pairs]) for side in (0, 1))
    got = list(zip(*(c.tolist() for c in compact_windows.shared_runs(x, numbered(0), y, numbered(1), np.array([p[2] for p in pairs]), 5, 0.8)), strict=True))
    for k, (x, y, drift) in enumerate(pairs):
        held, want = set(y.tolist()), []
        dense = lambda places: compact_windows.dense_stretches(np.array(places, dtype=np.int64), 5, 0.8)
        starts, ends = dense([i for i, v in enumerate(x.tolist()) if v in held])
        if len(starts) and len(dense([j for j, v in enumerate(y.tolist()) if v in set(x.tolist())])[0]):
            for i in (i for s, e in zip(starts, ends, strict=True) for i in range(s, e) if x[i] in held):
                j = min(np.flatnonzero(y == x[i]).tolist(), key=lambda j: (abs(j - i - drift), j))
                if want and (want[-1][2], want[-1][4]) == (i, j):
                    want[-1] = (k, want[-1][1], i + 1, want[-1][3], j + 1)
                else:
                    want.append((k, i, i + 1, j, j + 1))
        assert [g for g in got if g[0] == k] == want


def test_no_region_is_verified_twice(spark, monkeypatch):
    """Two families hold the same lines in another order: every round proposes pairs of both, more than the round before, and none is near."""
    regions, keep = [], compact_windows.written
    monkeypatch.setattr(compact_windows, "written", lambda df, name: regions.append(keep(df, name)) or regions[-1] if name == "regions" else keep(df, name))
    first, line, second = (words_of(20_000 + k, 30) for k in range(3))
    texts = []
    for i in range(24):
        passage = [*first, *line, *second] if i % 2 else [*second, *line, *first]
        texts.append((i, " ".join([*words_of(20_100 + i, 40), *passage, *words_of(20_200 + i, 40)])))
    rows = compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all((r.doc_id - r.other_id) % 2 == 0 for r in rows) and {n for r in rows for n in (r.doc_id, r.other_id)} == set(range(24))
    seen = [tuple(r) for df in regions for r in df.collect()]
    assert len(regions) > 2 and len(seen) == len(set(seen))


def classes_of(pairs) -> set[frozenset[int]]:
    names: dict[int, set[int]] = {}
    for pair in pairs:
        one = set().union(*(names.get(n, {n}) for n in pair))
        names |= dict.fromkeys(one, one)
    return {frozenset(one) for one in names.values()}


@pytest.mark.parametrize("block", [1024, 32])
def test_near_passages_of_many_varied_copies_are_linked_by_few_pairs(spark, monkeypatch, block):
    """Each text is compared with some others, however many are near; those that near passages link are linked, also across blocks."""
    monkeypatch.setattr(compact_windows, "BLOCK", block, raising=False)
    rng, base, texts = random.Random(8), words_of(30_000, 150), []
    for i in range(160):
        copy = [w if rng.random() > 0.03 else f"new{i}x{k}" for k, w in enumerate(base)]
        texts.append((i, [*words_of(30_100 + i, 30), *copy, *words_of(30_400 + i, 30)]))
    shingles = [np.array([zlib.crc32(" ".join(w[k : k + 5]).encode()) for k in range(len(w) - 4)], dtype=np.uint32) for _, w in texts]
    near = set()
    for i, x in enumerate(shingles):
        for j, y in enumerate(shingles[:i]):
            equal = np.concatenate([[0], np.cumsum(x == y)])
            if any((m := equal[k:] - equal[:-k])[m >= 0.8 * (2 * k - m) - 1e-9].size for k in range(46, len(x) + 1)):
                near.add((i, j))
    rows = compact_windows.near_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")).collect()
    pairs = {(max(r.doc_id, r.other_id), min(r.doc_id, r.other_id)) for r in rows}
    assert classes_of(pairs) == classes_of(near) and pairs <= near
    assert len(near) > 20 * len(texts) and len(pairs) < 12 * len(texts)


def test_runs_around_a_place_make_a_passage():
    rng, found = np.random.default_rng(9), 0
    for _ in range(400):
        x = rng.integers(0, 10**6, 60).astype(np.int32)
        cut, kept = rng.random(60) < 0.06, rng.random(60)
        y = np.concatenate([[v] if not c else ([] if k < 0.5 else [-1, v][: 1 + (k < 0.7)]) for v, c, k in zip(x, cut, kept, strict=True)]).astype(np.int32)
        at = int(rng.integers(0, 60))
        if x[at] not in y:
            continue
        other, zeros = int(np.flatnonzero(y == x[at])[0]), lambda z: np.zeros(len(z), np.int64)
        pair, *sides = compact_windows.shared_runs(x, zeros(x), y, zeros(y), np.array([other - at]), 20, 0.8)
        runs = list(zip(*(s.tolist() for s in sides), strict=True))
        around = compact_windows.runs_around(runs, at, other, 20, 0.8) if runs else []
        for x0, x1, y0, y1 in around:
            assert x0 <= at < x1 and y0 <= other < y1 and min(x1 - x0, y1 - y0) >= 20
            assert order_minhash.aligned(x[x0:x1], y[y0:y1], 0.8)
        # Whatever runs joined from left to right make of them, these do too.
        joined = compact_windows.joined_runs(runs, x, y, 20, 0.8, 5) if runs else []
        assert around or not any(j[0] <= at < j[1] and j[2] <= other < j[3] for j in joined)
        found += len(around)
    assert found > 200
