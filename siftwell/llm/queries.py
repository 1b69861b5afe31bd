"""Registered queries of the operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import chat_format, compact_windows, language_id, licenses, main_text, merkle_manifest, mixing, order_minhash, packing, periodic_runs, quality, suffix_dedup, vector_dedup
from siftwell.llm.common import WORD, let, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS line, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, line, body)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(12 + length(regexp_replace(line, '<(\\*)\|', '<\\\1|', 'g')) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""


@query("op1_chat_format", CHAT_SQL)
def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    messages = rows.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    return chat_format.read_back(chat_format.format_turns(messages))


@query("op4_pack_sequences")
def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, with_ids=False)


@query("op10_language_id")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = language_id.fit(docs.where(fold != 1))
    predicted = language_id.predict(docs, model)
    return predicted.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
levels AS (
    SELECT *, CAST(cap AS DOUBLE) / weight AS fill,
        CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
        row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS place
    FROM weighted),
held AS (SELECT level FROM levels WHERE level <= fill ORDER BY place LIMIT 1),
rates AS (
    SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM held) * weight) AS target,
        coalesce(least(CAST(cap AS DOUBLE), (SELECT level FROM held) * weight) / nullif(source_size, 0), 0) AS rate
    FROM levels),
taken AS (
    SELECT s.doc_id, s.size, r.source_size, r.target, r.rate,
        CAST('0x' || md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(s.text, '')))[1:12] AS BIGINT) / 281474976710656.0 AS share
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
    CAST(size * (floor(rate) + CASE WHEN share < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM taken"""


@query("op2_mix_sources", MIX_SQL)
def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.rated(table(spark, sf_dir, "documents"))
    return rated.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def _license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in licenses.SENTENCES.items())
    steps, last = [], "marked"
    for n, (name, ids) in enumerate(licenses.RULES):
        pattern = quoted(";" + ";;".join(ids) + ";")
        steps.append(
            f"r{n} AS (SELECT doc_id, sentence_ids, replace(rest, {pattern}, ';|;') AS rest, CASE WHEN contains(rest, {pattern}) "
            f"AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) ELSE names END AS names FROM {last})"
        )
        last = f"r{n}"
    return rf"""
WITH known(sentence, id) AS (VALUES {pairs}),
parts AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS s FROM parts),
clean AS (SELECT doc_id, pos, regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g') AS s FROM lines),
hits AS (SELECT doc_id, string_agg(id, ' ' ORDER BY pos) AS sentence_ids, string_agg(';' || id || ';', '' ORDER BY pos) AS rest FROM clean JOIN known ON s = sentence GROUP BY doc_id),
marked AS (SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(rest, '') AS rest, CAST([] AS VARCHAR[]) AS names FROM documents d LEFT JOIN hits USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, sentence_ids, array_to_string(names, ' AND ') AS licenses,
    CAST(len(list_filter(regexp_split_to_array(rest, ';+'), lambda x: x <> '' AND x <> '|')) AS BIGINT) AS unmatched
FROM {last}"""


@query("op3_license_scan", _license_sql())
def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return rf"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
word_rows AS (SELECT doc_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM split),
windows AS (
    SELECT doc_id, pos, word, lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third
    FROM word_rows WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
counted AS (SELECT doc_id, pos, third IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, second, third) > 1 AS again FROM windows),
covered AS (
    SELECT doc_id, again OR coalesce(lag(again, 1) OVER w, false) OR coalesce(lag(again, 2) OVER w, false) AS inside
    FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
repeats AS (SELECT doc_id, count(*) FILTER (inside) AS n FROM covered GROUP BY doc_id),
counts AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, CAST(len(list_intersect(words, [{stops}])) AS BIGINT) AS n_stop_words
    FROM split LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND n_words <= 1000000
    AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.1 AND n_stop_words >= 2
    AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AND n_repeat_words / n_words <= 0.5 AS kept
FROM counts"""


@query("op7_quality_rules", _quality_sql())
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


VECTOR_SQL = """
WITH RECURSIVE raw AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
vecs AS (SELECT * FROM raw WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id"""


@query("op9_vector_dedup", VECTOR_SQL)
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.linked(table(spark, sf_dir, "embeddings"))


SUFFIX_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, unnest(range(len(words) - 49)) AS start, words FROM split WHERE len(words) >= 50),
hashed AS (SELECT doc_id, start, md5(array_to_string(words[start + 1 : start + 50], ' ')) AS h FROM windows),
seen AS (SELECT doc_id, start, min(doc_id) OVER w AS least, max(doc_id) OVER w AS most FROM hashed WINDOW w AS (PARTITION BY h)),
hits AS (SELECT doc_id, start, doc_id <> least AS redundant FROM seen WHERE least <> most),
marked AS (SELECT *, CASE WHEN start - lag(start) OVER w <= 50 THEN 0 ELSE 1 END AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id, redundant ORDER BY start)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, redundant ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start_word, CAST(max(start) + 50 AS BIGINT) AS end_word, CAST(max(start) + 50 - min(start) AS BIGINT) AS n_words, redundant
FROM runs GROUP BY doc_id, redundant, run"""


@query("op5_suffix_dedup", SUFFIX_SQL)
def _suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query("op8_order_minhash")
def _near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_compact_windows")
def _near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(table(spark, sf_dir, "documents"))


# The CRC-32 of the decimal doc_id (reversed polynomial, table of 256), as `crc` of `keyed`; every row has a number.
CRC_SQL = r"""
crc_table AS (
    SELECT list(list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) AS r(i)),
keyed AS (
    SELECT row_number() OVER () AS row, *, xor(list_reduce(
        [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM documents, crc_table)"""

RUNS_SQL = rf"""
WITH {CRC_SQL},
split AS (SELECT row, doc_id, crc % 10 AS last, crc // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM keyed),
placed AS (SELECT *, len(w) AS n, g % greatest(len(w), 1) AS a, 1 + (len(w) - g % greatest(len(w), 1)) // (3 + g % 8) AS p FROM split),
word_rows AS (
    SELECT row, n, unnest(range(n)) AS pos,
        unnest(CASE WHEN last = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END) AS word
    FROM placed),
pairs AS (SELECT x.row, x.pos, y.pos - x.pos AS q FROM word_rows x JOIN word_rows y ON x.row = y.row AND x.word = y.word AND y.pos > x.pos WHERE 3 * (y.pos - x.pos) <= x.n),
islands AS (SELECT row, q, pos, pos - row_number() OVER (PARTITION BY row, q ORDER BY pos) AS island FROM pairs),
stretches AS (SELECT row, q, min(pos) AS start, count(*) + q AS length FROM islands GROUP BY row, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length),
listed AS (SELECT row, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY row),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY row ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS pos FROM runs),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY pos) AS collapsed FROM word_rows ANTI JOIN gone USING (row, pos) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
    CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM keyed LEFT JOIN listed USING (row) LEFT JOIN best USING (row) LEFT JOIN kept USING (row)"""


@query("op11_periodic_runs", RUNS_SQL)
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        start = (g % F.greatest(n, F.lit(1))).cast("int")

        def from_there(a: Column) -> Column:
            period = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
            return let(period, lambda p: F.transform(words, lambda word, i: F.when(i < a, word).otherwise(F.get(words, a + (i - a) % p))))

        return F.array_join(let(start, from_there), " ")

    text = F.when(crc % 10 == 0, let(F.regexp_extract_all("text", F.lit(f"({WORD})")), repeated)).otherwise(F.col("text"))
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


MERKLE_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
fields AS (
    SELECT row, source, doc_id, crc, text, concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
        coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head
    FROM keyed),
leaves AS (
    SELECT row, source, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END) || ':' || CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END, '-')) AS claim
    FROM fields),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS tree, count(*) AS n FROM leaves GROUP BY source),
placed AS (SELECT l.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
grown(tree, level, pos, digest, n) AS (
    SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM placed
    UNION ALL SELECT tree, any_value(level) + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value(n + 2) // 3 FROM grown WHERE n > 1 GROUP BY tree, pos // 3),
subroots AS (SELECT tree, digest AS subroot, level AS height FROM grown WHERE n = 1),
above(level, pos, digest, n) AS (
    SELECT 0, tree - 1, subroot, count(*) OVER () FROM subroots
    UNION ALL SELECT any_value(level) + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value(n + 2) // 3 FROM above WHERE n > 1 GROUP BY pos // 3),
whole AS (SELECT digest AS root FROM above WHERE n = 1),
steps AS (
    SELECT x.tree, x.level, x.pos, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS lefts, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS rights
    FROM grown x JOIN grown y ON x.tree = y.tree AND x.level = y.level AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY x.tree, x.level, x.pos),
top_steps AS (
    SELECT x.level, x.pos, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS lefts, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS rights
    FROM above x JOIN above y ON x.level = y.level AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY x.level, x.pos),
folded(row, tree, level, pos, claim, siblings) AS (
    SELECT row, tree, 0, pos, claim, '' FROM placed
    UNION ALL SELECT f.row, f.tree, f.level + 1, f.pos // 3, sha256(lefts || claim || rights), siblings || lefts || rights
    FROM folded f JOIN steps s ON f.tree = s.tree AND f.level = s.level AND f.pos = s.pos),
to_root(row, level, pos, claim, siblings) AS (
    SELECT row, 0, f.tree - 1, claim, siblings FROM folded f JOIN subroots s ON f.tree = s.tree AND f.level = s.height
    UNION ALL SELECT f.row, f.level + 1, f.pos // 3, sha256(lefts || claim || rights), siblings || lefts || rights FROM to_root f JOIN top_steps s ON f.level = s.level AND f.pos = s.pos)
SELECT p.doc_id, p.leaf, subroot, root, sha256(t.siblings) AS proof_sha256, t.claim AS folded_root, t.claim = root AS verified
FROM to_root t JOIN placed p USING (row) JOIN subroots s ON s.tree = p.tree CROSS JOIN whole
WHERE t.level = (SELECT max(level) FROM above)"""


@query("op12_merkle_manifest", MERKLE_SQL)
def _merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    presented = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(presented != F.col("text"), merkle_manifest.leaf(*fields, presented))
    docs = table(spark, sf_dir, "documents")
    entries = docs.select("doc_id", "source", merkle_manifest.leaf(*fields, F.col("text")).alias("leaf"), changed.alias("claim"))
    proved = merkle_manifest.manifest(entries)
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("proof", ":/", ""), 256).alias("proof_sha256"), "folded_root", "verified")


@query("op13_main_text")
def _main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = main_text.extracted(pages, main_text.fit(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))
