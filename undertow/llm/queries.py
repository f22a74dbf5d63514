"""One query per operator over its whole table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, prepare
from . import bpe, chat, decontam, extract, langid, lines, manifest, rans, resample, simhash, tokens, toxicity, urls, vectors
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, root: fn(prepare(spark), root)
    return fn


@query
def op6_byte_bpe(spark, root):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(read(spark, root, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)


@query
def op7_decontamination(spark, root):
    documents = read(spark, root, "documents", "doc_id", "text")
    return decontam.digest(decontam.hits(documents, read(spark, root, "benchmark")))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op7_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
pats AS (SELECT item, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w
         FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, n, w[i : i + n - 1] AS words FROM pats),
sizes AS (SELECT DISTINCT n FROM pat),
wins AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
found AS (SELECT DISTINCT r, i, wins.n, item FROM wins JOIN pat
          ON wins.n = pat.n AND wins.w[i : i + wins.n - 1] = pat.words),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN names USING (r)
"""

_PROBE = "</s>[INST] ok [/INST]"


@query
def op2_chat_format(spark, root):
    rows = read(spark, root, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PROBE).alias("text"),
    )
    return chat.digest(chat.render(chat.fold(chat.events(rows.union(probe)))))


_ESCAPED = r"regexp_replace({0}, '(<s>|</s>|\[INST\]|\[/INST\])', '\\\1', 'g')"

ORACLES["op2_chat_format"] = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learnt,
        sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})
            + CASE WHEN role = 'assistant' THEN 11 ELSE 17 END) AS n
    FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
    CAST(n AS BIGINT) AS formatted_chars
FROM g
"""

#: host, path and verdict of each rule.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query
def op10_url_filter(spark, root):
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge(read(spark, root, "pages", "page_id", "url", "html"), rules)


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract({url}, '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}')"


def _sql_key(url: str) -> str:
    plain = f"split_part({url}, '#', 1)"
    site = f"regexp_extract({plain}, '^(?s:.*?)://[^/?]*')"
    return f"translate({site}, '{urls.UPPER}', '{urls.LOWER}') || substr({plain}, length({site}) + 1)"


ORACLES["op10_url_filter"] = f"""
WITH RECURSIVE rules(h, p, verdict) AS (VALUES {', '.join(map(str, URL_RULES))}),
raw AS (
    SELECT url, regexp_extract(t, 'href\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'i') AS t
    FROM (SELECT url, unnest(regexp_extract_all(html, '<link\\b[^>]*>', 0, 'i')) AS t FROM pages)
    WHERE regexp_matches(t, 'rel\\s*=\\s*["'']?canonical\\b', 'i')
    UNION ALL
    SELECT url, regexp_extract(t, 'url\\s*=\\s*''?([^"''\\s>;]+)', 1, 'i')
    FROM (SELECT url, unnest(regexp_extract_all(html, '<meta\\b[^>]*>', 0, 'i')) AS t FROM pages)
    WHERE regexp_matches(t, 'http-equiv\\s*=\\s*["'']?refresh\\b', 'i')),
targets AS (
    SELECT url, CASE WHEN instr(t, '://') > 0 THEN t
        WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t
        WHEN starts_with(t, '/') THEN split_part(url, '://', 1) || '://' || {_sql_host('url')} || t
        ELSE split_part(url, '://', 1) || '://' || {_sql_host('url')}
            || coalesce(nullif(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^(.*/)', 1), ''), '/') || t END AS t
    FROM raw WHERE t <> '' AND instr(url, '://') > 0),
keyed AS (SELECT DISTINCT {_sql_key('url')} AS a, {_sql_key('t')} AS b FROM targets),
edges AS (SELECT a, b FROM keyed WHERE a <> b UNION SELECT b, a FROM keyed WHERE a <> b),
ends AS (SELECT DISTINCT a AS url FROM edges),
reach AS (SELECT url AS a, url AS b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
addresses AS (
    SELECT url, {_sql_host('url')} AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT DISTINCT url FROM pages UNION SELECT url FROM ends)),
best AS (
    SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM addresses JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
tainted AS (SELECT DISTINCT a FROM reach JOIN best ON b = best.url WHERE verdict = 'block')
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
    coalesce(verdict, CASE WHEN a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN addresses USING (url) LEFT JOIN best USING (url)
LEFT JOIN tainted ON a = {_sql_key('pages.url')}
"""


@query
def op3_simhash(spark, root):
    found = simhash.groups(read(spark, root, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


END_ID = 2


@query
def op4_token_files(spark, root):
    documents = read(spark, root, "documents", "doc_id", "text")
    # Ids of this vocabulary are below 49,408, so 16 bits hold them until they are coded.
    ids = tokens.encode(documents, public_tokenizers.path("word_bpe_49k.json"), END_ID, packing="<u2", plain=False)
    place = f"{checkpoint_root(spark)}/token-files-{uuid.uuid4().hex}"
    ids.write.option("compression", "zstd").parquet(f"{place}/ids")
    rans.write(spark.read.schema(ids.schema).parquet(f"{place}/ids"), f"{place}/coded", packing="<u2")
    return rans.read(
        spark, f"{place}/coded", "ids_crc32 bigint", lambda ids: [zlib.crc32(ids.astype("<u4").tobytes())]
    )

TOXIC_FROM = 0.3


@query
def op1_toxicity(spark, root):
    documents = read(spark, root, "documents", "doc_id", "text")
    found = toxicity.score(documents, read(spark, root, "labels", "doc_id", "toxic"))
    return found.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


LANGUAGE_PIECES = "byte_bpe_multi_50k.tiktoken"


@query
def op5_language_id(spark, root):
    documents = read(spark, root, "documents", "doc_id", "text", "lang")
    return langid.identify(documents, public_tokenizers.path(LANGUAGE_PIECES))


@query
def op8_embedding_near(spark, root):
    return vectors.near(read(spark, root, "embeddings", "vec_id", "label", "embedding"))


ORACLES["op8_embedding_near"] = """
WITH RECURSIVE clean AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM clean UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
    coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON vec_id = counts.a LEFT JOIN least ON vec_id = least.a
"""


@query
def op9_line_dedup(spark, root):
    found = lines.dedup(read(spark, root, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


# crc32 of a list of bytes: a table made by rule, and one step a byte.
_CRC = """
crc_bits(i, k, v) AS (
    SELECT i, 0, i FROM (SELECT CAST(unnest(range(256)) AS UBIGINT) AS i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END
    FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_bits WHERE k = 8)"""


def _crc(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of ``text``; the query reads crc_table, too."""
    digits = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr({digits}, 2 * i + 1, 2) AS UBIGINT))"
    step = "xor(v >> 8, tab[CAST(xor(v, b) & 255 AS BIGINT) + 1])"
    start = "CAST(4294967295 AS UBIGINT)"
    return f"xor(list_reduce(list_prepend({start}, {bytes_}), lambda v, b: {step}), {start})"


@query
def op11_resampling(spark, root):
    documents = read(spark, root, "documents", "doc_id", "text")
    found = resample.resample(documents, read(spark, root, "benchmark", "text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op11_resampling"] = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
names AS (SELECT f, CAST({_crc('f')} % 10000 AS BIGINT) AS k FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table),
s AS (SELECT k, count(*) AS s FROM df JOIN names USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN names USING (f) GROUP BY k),
totals AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM df) AS s_all, (SELECT CAST(count(*) AS DOUBLE) FROM bf) AS t_all),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (k), totals),
sums AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN names USING (f) JOIN g USING (k) GROUP BY r),
scored AS (
    SELECT r, doc_id, len(w) >= 20 AS fit, coalesce(n, 0) AS n_features,
        coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
        CAST(CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) AS h
    FROM d LEFT JOIN sums USING (r)),
drawn AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST, n_features) AS place,
        25 * count(*) FILTER (fit) OVER () // 100 AS least FROM drawn)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
    CASE WHEN place <= least THEN place END AS rank
FROM ranked
"""


@query
def op13_manifest(spark, root):
    return manifest.digests(read(spark, root, "documents", *manifest.FIELDS))


def _sql_leaf(text: str) -> str:
    values = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in manifest.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


ORACLES["op13_manifest"] = f"""
WITH RECURSIVE {_CRC},
leaves AS (
    SELECT doc_id, lang, {_sql_leaf('text')} AS leaf,
        CASE WHEN {_crc("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 AND doc_id IS NOT NULL
            THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
            ELSE {_sql_leaf('text')} END AS tampered
    FROM documents, crc_table),
placed AS (
    SELECT row_number() OVER () AS r, *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(t, lvl, pos, d, n) AS (
    SELECT t, 0, pos, leaf, n FROM placed
    UNION ALL
    SELECT t, lvl + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 7) // 8)
    FROM nodes WHERE n > 1 GROUP BY t, lvl, pos // 8),
subroots AS (SELECT t AS pos, d, count(*) OVER () AS n FROM nodes WHERE n = 1),
top(lvl, pos, d, n) AS (
    SELECT 0, pos, d, n FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 7) // 8)
    FROM top WHERE n > 1 GROUP BY lvl, pos // 8),
siblings AS (
    SELECT r, lvl, s.pos, d FROM placed p JOIN nodes s ON s.t = p.t AND s.n > 1
        AND s.pos // 8 = p.pos >> (3 * lvl + 3) AND s.pos <> p.pos >> (3 * lvl)
    UNION ALL
    SELECT r, lvl + 1000, s.pos, d FROM placed p JOIN top s ON s.n > 1
        AND s.pos // 8 = p.t >> (3 * lvl + 3) AND s.pos <> p.t >> (3 * lvl)),
proofs AS (SELECT r, string_agg(d, '' ORDER BY lvl, pos) AS w FROM siblings GROUP BY r),
inner_fold(r, t, lvl, pos, d) AS (
    SELECT r, t, 0, pos, tampered FROM placed
    UNION ALL
    SELECT f.r, any_value(f.t), f.lvl + 1, f.pos // 8,
        sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.d ELSE s.d END, '' ORDER BY s.pos))
    FROM inner_fold f JOIN nodes s ON s.t = f.t AND s.lvl = f.lvl AND s.pos // 8 = f.pos // 8 AND s.n > 1
    GROUP BY f.r, f.lvl, f.pos // 8),
inner_ends AS (SELECT r, t, arg_max(d, lvl) AS d FROM inner_fold GROUP BY r, t),
outer_fold(r, lvl, pos, d) AS (
    SELECT r, 0, t, d FROM inner_ends
    UNION ALL
    SELECT f.r, f.lvl + 1, f.pos // 8, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.d ELSE s.d END, '' ORDER BY s.pos))
    FROM outer_fold f JOIN top s ON s.lvl = f.lvl AND s.pos // 8 = f.pos // 8 AND s.n > 1
    GROUP BY f.r, f.lvl, f.pos // 8),
ends AS (SELECT r, arg_max(d, lvl) AS folded_root FROM outer_fold GROUP BY r),
whole AS (SELECT d AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, s.d AS subroot, root, sha256(coalesce(w, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON s.pos = p.t JOIN ends USING (r) LEFT JOIN proofs USING (r), whole
"""


@query
def op12_html_text(spark, root):
    return extract.extract(read(spark, root, "pages", "page_id", "url", "html"))


# These pages mark their article, write it in headings and paragraphs with plain tags, and use four references.
ORACLES["op12_html_text"] = r"""
WITH parts AS (
    SELECT row_number() OVER () AS r, page_id, url,
        regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS found
    FROM pages),
blocks AS (SELECT r, unnest(found) AS block, unnest(range(len(found))) AS place FROM parts),
plain AS (
    SELECT r, place, trim(regexp_replace(regexp_replace(replace(replace(replace(
        replace(regexp_replace(block, '</?b>', '', 'g'), '<br>', ' '),
        '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line
    FROM blocks),
texts AS (SELECT r, string_agg(line, chr(10) ORDER BY place) AS text FROM plain WHERE line <> '' GROUP BY r)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM parts LEFT JOIN texts USING (r)
"""
