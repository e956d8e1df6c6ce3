"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, conversations, decontaminate, licences, lm, mixing, packing, passages, quality, sharding, simhash, urls
from .common import materialize, table

#: Vocabulary of op9 and of the pipeline's packing, by name in the folder of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.add_features(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", F.xxhash64("text").alias("text_hash"))
    mixed = mixing.mix_sources(materialize(docs, "features"), MIX_TARGETS, text=None)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "selected")


#: Marginals: sources by the square root of their tokens, languages flattened a little, topics as they are.
MIX_TARGETS = {"source": 0.5, "lang": 0.7, "topic": 1.0}


def op5_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.EXAMPLE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a layout by source (32 shards) to 40 shards of equal bytes."""
    placed = sharding.reshard(table(spark, sf_dir, "documents"), "pmod(crc32(source), 32)", 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), root_share=0.5)


def op8_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op9_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(), 1024)


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_suffix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return decontaminate.with_digest(found).select("row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest, "contaminated")


def op13_parallel_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_conversations(conversations.damage(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repeated_passages, op2_licence_sentences, op3_quality_cascade, op4_mix_sources, op5_url_aliases, op6_min_cost_reshard, op7_backoff_automaton, op8_one_bit_codes, op9_shortest_pack_first, op10_simhash_pivots, op11_toivonen_phrases, op12_suffix_matches, op13_parallel_viterbi, pipeline)}

_OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x)) AS n_stutter,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS n_ellipses FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_stutter > 30 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)
        OR (n_lines >= 5 AND (100 * n_bullets > 90 * n_lines OR 100 * n_ellipses > 50 * n_lines))
        OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 2 * letters < word_chars) AS kept
FROM b
"""

def _host_sql(url: str) -> str:
    return rf"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path_sql(url: str) -> str:
    return rf"regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"


def _node_sql(url: str) -> str:
    """The query loses its tracking parameters one by one as a list."""
    query = rf"regexp_extract(coalesce({url}, ''), '(?s)^[^?#]*\?([^#]*)', 1)"
    kept = rf"array_to_string(list_filter(string_split({query}, '&'), lambda x: NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)=')), '&')"
    return rf"CASE WHEN {_host_sql(url)} <> '' THEN {_host_sql(url)} || regexp_replace({_path_sql(url)}, '/$', '') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"


_OP5 = rf"""
WITH RECURSIVE r AS (SELECT *, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p
    FROM (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')) v(kind, rule)),
u AS (SELECT page_id, url, {_host_sql('url')} AS host, {_path_sql('url')} AS path, {_node_sql('url')} AS node, html FROM pages),
tags AS (SELECT url, list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b') AND regexp_matches(x, '(?is)\bhref\s*=\s*["'']?[^"''\s>]'))[1] AS c,
    list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?is)http-equiv\s*=\s*["'']?refresh\b') AND regexp_matches(x, '(?is)\bcontent\s*=\s*["''][^"''>]*?url\s*=\s*[^"''\s>]'))[1] AS m FROM u),
links AS (SELECT url, regexp_extract(c, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS l FROM tags WHERE c IS NOT NULL
    UNION ALL SELECT url, regexp_extract(m, '(?is)\bcontent\s*=\s*["''][^"''>]*?url\s*=\s*([^"''\s>]+)', 1) FROM tags WHERE m IS NOT NULL),
ends AS (SELECT url AS s, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l
    WHEN starts_with(l, '//') THEN split_part(url, '://', 1) || ':' || l
    WHEN starts_with(l, '/') THEN split_part(url, '://', 1) || '://' || {_host_sql('url')} || l
    ELSE split_part(url, '://', 1) || '://' || {_host_sql('url')} || coalesce(nullif(regexp_replace({_path_sql('url')}, '[^/]*$', ''), ''), '/') || l END AS d FROM links),
e AS (SELECT s, d, {_node_sql('s')} AS a, {_node_sql('d')} AS b FROM ends),
either AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM either UNION SELECT reach.a, either.b FROM reach JOIN either ON reach.b = either.a),
ruled AS (SELECT url, max_by(rule, length(rule)) AS rule, max_by(kind, length(rule)) AS kind
    FROM (SELECT DISTINCT url, {_host_sql('url')} AS host, {_path_sql('url')} AS path FROM (SELECT url FROM pages UNION SELECT s FROM e UNION SELECT d FROM e) WHERE url IS NOT NULL)
    JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
votes AS (SELECT node, kind FROM u JOIN ruled USING (url) UNION SELECT a, kind FROM e JOIN ruled ON s = url UNION SELECT b, kind FROM e JOIN ruled ON d = url),
said AS (SELECT reach.a AS node, min(kind) AS kind FROM reach JOIN votes ON reach.b = votes.node GROUP BY reach.a)
SELECT page_id, host, path, rule, coalesce(ruled.kind, said.kind, 'allow') AS verdict
FROM u LEFT JOIN ruled ON u.url = ruled.url LEFT JOIN said ON u.node = said.node
"""

_OP8 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM x, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score FROM k JOIN n USING (lang)
    JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM c, (SELECT unnest(range(2, 5)) AS k), (SELECT unnest(range(1, 5)) AS i) WHERE k < m AND i + k - 1 <= m GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)),
g AS (SELECT row, k, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS k FROM d), (SELECT DISTINCT m FROM i) WHERE k + m - 1 <= len(w)),
h AS (SELECT row, k, m, item FROM g JOIN i USING (m, s)),
n AS (SELECT row, count(DISTINCT k + o) AS n_hit FROM (SELECT DISTINCT row, k, unnest(range(0, m)) AS o FROM h) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)
"""

def _op13_sql() -> str:
    """Forward search over four states (nothing, system, user, assistant); of equal costs the least audit stays."""
    edit = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': {f'list_append({s}.o, {line})' if line else f'{s}.o'}}}"
    far = "{'c': 1000000000, 'a': '', 'o': []::VARCHAR[]}"
    kept = {0: [], 1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}
    step = {0: (2, "user:"), 1: (2, "user:"), 2: (3, "assistant:"), 3: (2, "user:")}

    def after(q: int) -> str:
        ways = [edit(f"s{q}", 3, "D", "")]
        ways += [f"CASE WHEN live AND role[1:1] = '{r}' THEN {edit(f's{p}', 'cut', 'K', chr(39).join(['role || ', ':', ' || text']))} ELSE {far} END" for p, r in kept[q]]
        ways += [f"CASE WHEN live THEN {edit(f's{p}', '2 + cut', 'R', chr(39).join(['', line, ' || text']))} ELSE {far} END" for p, (to, line) in step.items() if to == q]
        return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]

    user = "least(s2, " + ", ".join(edit(f"s{p}", 2, "I", "'user:'") for p in (0, 1, 3)) + ")"
    closed = f"SELECT conv_id, i, s0, s1, s2, least(s3, {edit('s2', 2, 'I', chr(39) + 'assistant:' + chr(39))}) AS s3 FROM (SELECT conv_id, i, s0, s1, {user} AS s2, s3 FROM (FROM_HERE))"
    begin = f"SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM conversations"
    go = f"SELECT v.conv_id, v.i + 1 AS i, {after(0)} AS s0, {after(1)} AS s1, {after(2)} AS s2, {after(3)} AS s3 FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1"
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
g AS (SELECT *, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS e, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i)[1:1] || role[1:1] AS pair FROM o),
f AS (SELECT *, e <> '' AND NOT again AS live, CASE WHEN e NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM g),
v(conv_id, i, s0, s1, s2, s3) AS (({closed.replace('FROM_HERE', begin)}) UNION ALL ({closed.replace('FROM_HERE', go)})),
w AS (SELECT conv_id, least(s0, s3) AS s FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (e = '') AS blank, count(*) FILTER (e <> '' AND again) AS duplicate,
    count(*) FILTER (live AND cut = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    s.c::BIGINT AS cost, s.a AS audit, sha256(array_to_string(s.o, chr(10))) AS repaired_sha256
FROM w LEFT JOIN t ON w.conv_id IS NOT DISTINCT FROM t.conv_id
"""


ORACLE_SQL: dict[str, str] = {"op2_licence_sentences": licences.scan_sql(), "op3_quality_cascade": _OP3, "op5_url_aliases": _OP5, "op8_one_bit_codes": _OP8, "op11_toivonen_phrases": _OP11, "op12_suffix_matches": _OP12, "op13_parallel_viterbi": _op13_sql()}
