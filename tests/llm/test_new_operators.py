"""Periodic runs, the Merkle manifest and main text: against brute force, on cut structures, and on edge cases."""

from __future__ import annotations

import hashlib
import html
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import main_text, merkle_manifest, periodic_runs
from siftwell.llm.block_layouts import drawn_pages
from siftwell.llm.common import mix
from siftwell.llm.html_blocks import blocks
from siftwell.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, pos string, proof string"


def documents() -> list[tuple]:
    """Nulls in each column, ties, repeats, empty, blank and very long texts."""
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", " \n\t", "one", "a\nb\nc", "x y z " * 40, " ".join(f"u{i % 90}" for i in range(400)), long, "last\n"]
    rows = [(i, t, "en" if i % 2 else None, ["s1", None, "s2", "é"][i % 4], i if i % 3 else None, "c", "c", "c") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (4, "other", None, "s1", None, None, None, None), (None, "n\n", None, None, None, None, None, None), (None,) * 8]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3).cache()


def rows_of(frame, columns):
    return Counter(frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_merkle_manifest"])
@pytest.mark.parametrize("given", ["small", "edges", "empty"])
def test_queries_equal_their_sql(spark, sf_dir, tmp_path, docs, name, given):
    folder = sf_dir
    if given != "small":
        folder = str(tmp_path)
        (docs.limit(0) if given == "empty" else docs).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'' if given == 'small' else '/*.parquet'}'")
    got, want = QUERIES[name](spark, folder).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    if given == "empty":
        assert len(got) == 0
    else:
        assert rows_of(got, columns) == rows_of(want, columns)


# --- runs ---------------------------------------------------------------------------------------------------------


def plain_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """Every period, word by word."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // 3 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end - at + period >= max(24, 3 * period):
                found.setdefault((at, end - at + period), period)
            at = end + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def drawn_words(rng: random.Random) -> list[int]:
    """Runs in runs, runs with periods at the borders of scales, runs that touch, and noise of few or many words."""
    few = rng.choice([1, 2, 3, 5, 50])
    out = [rng.randrange(few) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        period = rng.choice([1, 2, 3, 7, 8, 9, 23, 24, 25, 26, 47, 48, 49, 50, 73, 96, 97, 100])
        part = rng.randrange(1, period + 1)
        inner = [rng.randrange(few) for _ in range(max(1, part // rng.choice([1, 3, 9])))]
        base = (inner * period)[:part] + [rng.randrange(few + 3) for _ in range(period - part)]
        out += (base * 6)[: rng.randrange(2 * period, 5 * period + 3)]
        out = out * rng.choice([1, 1, 1, 2, 3])
        out += [rng.randrange(few) for _ in range(rng.randrange(30))]
    return out[:1500]


def found_runs(rows: list[list[int]]) -> list[tuple[int, int, int]]:
    hashes = mix(np.array([w for row in rows for w in row], dtype=np.uint64) + np.uint64(9))
    first = np.cumsum([0, *map(len, rows)]).astype(np.int64)
    return sorted(zip(*(c.tolist() for c in periodic_runs.find_runs(hashes, first)), strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain_scan(seed):
    rng = random.Random(seed)
    for _ in range(12):
        rows = [drawn_words(rng) for _ in range(rng.randrange(1, 5))]
        starts = np.cumsum([0, *map(len, rows)]).tolist()
        assert found_runs(rows) == sorted((s + at, n, p) for at, row in zip(starts, rows, strict=False) for s, n, p in plain_runs(row))


def test_runs_never_cross_rows():
    assert found_runs([[1] * 23, [1] * 23]) == []
    assert found_runs([[1] * 23, [], [1] * 24]) == [(23, 24, 1)]
    assert found_runs([list(range(2000)) * 3]) == [(0, 6000, 2000)]


def test_runs_of_documents(spark, docs):
    got = {(r.doc_id, r.n_words): r for r in periodic_runs.periodic_runs(docs).collect()}
    assert len(periodic_runs.periodic_runs(docs).collect()) == len(documents())
    assert [tuple(r) for r in got[5, 120].runs] == [(0, 120, 3)] and got[5, 120].collapsed == "x y z"
    assert [tuple(r) for r in got[6, 400].runs] == [(0, 400, 90)]
    assert got[7, 60_000].runs == [] and got[7, 60_000].collapsed.startswith("w0 w1 ")
    assert got[0, 0].collapsed == "" and got[2, 0].runs == []
    assert got[None, 0].n_words == 0 and got[None, 1].collapsed == "n"


def test_strongest_run_and_ties(spark):
    rows = [(1, [(5, 30, 10), (0, 24, 8), (40, 24, 8)]), (2, []), (3, [(0, 48, 3), (60, 32, 2), (10, 32, 2)])]
    frame = spark.createDataFrame(rows, "doc_id long, runs array<struct<start:long,length:long,period:long>>")
    best = {r.doc_id: r.b and tuple(r.b) for r in frame.select("doc_id", periodic_runs.strongest(F.col("runs")).alias("b")).collect()}
    # All three of row 1 are three periods long, all of row 3 sixteen: the first of the list stands, which is in order.
    assert best == {1: (5, 30, 10), 2: None, 3: (0, 48, 3)}


# --- Merkle manifest ----------------------------------------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes: list[str]) -> tuple[str, list[str]]:
    """The last node, and for each node its proof, level by level."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            run = at // 3 * 3
            proofs[i].append("".join(nodes[run:at]) + ":" + "".join(nodes[at + 1 : run + 3]))
            places[i] = at // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


@pytest.mark.parametrize(("levels", "sizes"), [(5, {"a": 1}), (2, {"a": 30, None: 1, "b": 2, "c": 82}), (1, {f"s{i}": 1 + i % 4 for i in range(10)})])
def test_manifest_equals_plain_trees(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 3**levels)
    leaves = {s: [sha(f"{s}-{i}") for i in range(n)] for s, n in sizes.items()}
    rows = [(i, s, leaf, sha("other") if i % 7 == 3 else None) for s, of in leaves.items() for i, leaf in enumerate(of)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, source string, leaf string, claim string").repartition(4)
    trees = {s: plain_tree(leaves[s]) for s in sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))}
    root, above = plain_tree([subroot for subroot, _ in trees.values()])
    want = {}
    for (s, (subroot, proofs)), rest in zip(trees.items(), above, strict=True):
        for i, steps in enumerate(proofs):
            want[leaves[s][i]] = (i, subroot, root, "/".join([*steps, *rest]))
    # Levels are read by the tasks, too: the functions are shipped by value with this module's numbers.
    got = {r.leaf: r for r in merkle_manifest.manifest(frame).collect()}
    assert {leaf: (r.doc_id, r.subroot, r.root, r.proof) for leaf, r in got.items()} == want
    claims = {leaf: claim for _, _, leaf, claim in rows}
    for leaf, r in got.items():
        assert r.folded_root == merkle_manifest.fold(claims[leaf] or leaf, r.proof)
        assert r.verified == (claims[leaf] is None)


def test_tampering_shows(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(got) == len(documents()) and len({r.root for r in got}) == 1
    assert {r.verified for r in got} == {True, False} and all(r.verified == (r.folded_root == r.root) for r in got)


# --- main text ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return main_text.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))


PAGE = """<!DOCTYPE html><HTML><HEAD><TITLE>Top &amp; more</TITLE><STYLE>p > a {x:1}</STYLE></HEAD><BODY>
<header><h1>My site</h1><form action=/s><input name=q><button>Search</button></form></header>
<nav class='menu'><a href=/1>Home</a> <a href=/2>About</a></nav><div class="cookie-banner"><p>We use cookies to improve your experience.</p></div>
<main><article><h1>A title &lt;here&gt;</h1><p>The first <b>para</b>graph&nbsp;has
  some   words, caf&eacute; &#8212; and a <a href="x>y">link</a>.<p>The second one is not closed<br>and has a break.
<div class="ad-slot">Advertisement: buy this wonderful thing now.</div><!-- <p>not this</p> -->
<ul><li>item one of the list<li>item two of the list</ul><script>document.write("<p>no</p>")</script></article>
<section id="comments"><h3>2 comments</h3><p>Reader: I like this a lot, thank you for it.</p></section></main>
<aside class="sidebar"><h3>Related articles</h3><ul><li><a href=/3>Other things</a></li></ul></aside>
<footer>&copy; 2024 All rights reserved</footer>"""


def test_blocks_of_a_page():
    texts = [b.text for b in blocks(PAGE)]
    assert "The first paragraph has some words, café — and a link." in texts
    assert "item one of the list" in texts and "A title <here>" in texts and "and has a break." in texts
    assert not any(w in t for t in texts for w in ("not this", "document", "Top & more", "x:1"))
    assert blocks("") == blocks("<p></p><br>") == blocks("<!-- never closed <p>x") == blocks("<script>x<p>y") == []
    assert [b.text for b in blocks("a <b <p>c</p> & d &am")] == ["a c", "& d &am"]
    assert [b.text for b in blocks('1 < 2 <p title="a>b" class=x>three</i></p></div>four')] == ["1 < 2", "three", "four"]
    assert len(blocks("<p>x" * 3000)) == 3000 and {len(b.path) for b in blocks("<p>x" * 3000)} == {1}


def test_article_is_taken_and_nothing_else(spark, model):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "e", "", "x"), (3, "n", "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>", "x"), (1, "u", PAGE, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extracted(frame, model).collect()
    want = "A title <here> The first paragraph has some words, café — and a link. The second one is not closed and has a break. item one of the list item two of the list"
    assert Counter((r.page_id, r.url, r.text) for r in got) == Counter([(1, "u", want), (1, "u", want), (2, None, ""), (None, "e", ""), (3, "n", "")])
    assert main_text.extracted(frame.limit(0), model).count() == 0


def test_held_out_layouts(model):
    pages = drawn_pages(12345, 300, [f"token{i}" for i in range(3000)])
    found = [blocks(p.html) for p in pages]
    right = [(score > 0) == (b.text in p.kept) for p, page, scores in zip(pages, found, model.scores(found), strict=True) for b, score in zip(page, scores, strict=True)]
    assert len(right) > 5000 and sum(right) / len(right) > 0.98


def test_very_long_page(model):
    page = "<nav><a href=/>Home</a></nav><article>" + "".join(f"<p>Paragraph {i} says something.</p>" for i in range(20_000)) + "</article><footer>© all rights reserved</footer>"
    scores = model.scores([blocks(page), []])
    assert len(scores[0]) == 20_002 and (scores[0] > 0).sum() == 20_000 and len(scores[1]) == 0


def test_pages_of_the_tables(spark, sf_dir):
    """All text of the article element, and nothing else."""
    got = {r.page_id: r for r in QUERIES["op13_main_text"](spark, sf_dir).collect()}
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", row.html, re.S)[1]
        text = re.sub("<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
        assert got[row.page_id].text == " ".join(html.unescape(text).split())
        assert got[row.page_id].n_chars == len(got[row.page_id].text)


def test_labeller_without_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    model = main_text.fit(empty, layouts=40)
    assert main_text.extracted(empty, model).count() == 0
