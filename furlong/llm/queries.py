"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import aliases, decontam, lexical, licenses, minhash, packing, quality, repeats, secret_scan, shuffling, tokens, whitening
from .work import table

N_SHARDS = 24
#: Fixed values of the query.
URL_RULES = [
    aliases.Rule("com", "/", "allow"), aliases.Rule("example.com", "/en/", "block"), aliases.Rule("www.example.com", "/en/", "allow"),
    aliases.Rule("net", "/es/", "block"), aliases.Rule("net", "/fr/", "block"),
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_planes(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    out = quality.apply_quality_rules(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = "coalesce(octet_length(text), 0) + 8"
    out = shuffling.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), N_SHARDS, size=size)
    return out.select(
        "doc_id", F.expr(size).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = "transform({}, x -> concat_ws(':', x.name, cast(x.start as string), cast(x.end as string)))"
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.expr(f"sha2(array_join({told.format('filter(secrets, s -> s.kind < 3)')}, ','), 256)").alias("base_sha256"),
        F.expr(f"array_join({told.format('secrets')}, ',')").alias("spans"),
    )


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), unit="word", window=50, k=8, earlier_only=True)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op7_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), unit="byte", window=400, k=64, earlier_only=False)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=0.85)


def op10_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_redirect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)


def op13_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_planes, op2_quality_rules, op3_external_shuffle, op4_license_diagonals, op5_entropy_secrets, op6_repeated_passages,
        op7_sum_of_squares, op8_repeated_bytes, op9_bbit_minhash, op10_benchmark_containment,
        op11_redirect_classes, op12_jacobi_whitening, op13_interval_search,
    )
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SHINGLES = (
    "unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) "
    "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g"
)

ORACLE_SQL = {
    "op8_repeated_bytes": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, b, substring(h, b * 1000 + 1, 1800) AS part, len(h) // 2 - 400 AS last FROM (SELECT doc_id, h, unnest(range(0, len(h) // 1000 + 1)) AS b FROM d)),
w AS (SELECT doc_id, b * 500 + i AS pos, hash(substring(part, 2 * i + 1, 800)) AS v FROM (SELECT *, unnest(range(0, least(500, last - b * 500 + 1))) AS i FROM c)),
g AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY v) AS n FROM w) WHERE n > 1),
s AS (SELECT doc_id, pos, sum(CASE WHEN pos <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM g)),
r AS (SELECT doc_id, min(pos) AS a, max(pos) + 400 AS e FROM s GROUP BY doc_id, run),
k AS (SELECT r.doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substring(h, 2 * gap + 1, 2 * (a - gap)), '' ORDER BY a) AS front, max(e) AS tail
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS gap FROM r) r JOIN d ON r.doc_id = d.doc_id GROUP BY r.doc_id)
SELECT d.doc_id, cast(len(h) // 2 AS bigint) AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, cast(coalesce(n_spans, 0) AS bigint) AS n_spans,
  sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE front || substring(h, 2 * tail + 1) END)) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op9_bbit_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT y, root FROM r JOIN l ON r.doc_id = x),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, cast(n AS bigint) AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id""",
    "op6_repeated_passages": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i+49], ' ')) AS first_doc FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM g WHERE first_doc < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(n_removed AS bigint) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op10_benchmark_containment": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, {_SHINGLES} FROM d), bs AS (SELECT DISTINCT item_id, {_SHINGLES} FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs ON ds.g = bs.g GROUP BY doc_id, item_id)
SELECT doc_id, x.item_id, n_shared, n_item, cast(n_shared AS double) / n_item AS containment
FROM x JOIN n ON x.item_id = n.item_id WHERE 10 * n_shared >= 8 * n_item""",
    "op11_redirect_classes": f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)}),
links AS (SELECT url, unnest(list_concat(regexp_extract_all(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1),
  regexp_extract_all(html, '(?i)<meta[^>]*http-equiv="refresh"[^>]*url=([^"]*)"', 1))) AS target FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT url FROM links UNION SELECT target FROM links),
a AS (SELECT url, CASE WHEN url LIKE '%://%' THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM urls),
b AS (SELECT url, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM a),
c AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS args, regexp_replace(host, ':(80|443)$', '') AS name FROM b),
d AS (SELECT *, CASE WHEN host <> '' THEN name || regexp_replace(path, '/+$', '') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS address FROM c),
f AS (SELECT d.url, max_by(h || p, len(h || p) * 1000 + len(h)) AS rule, max_by(v, len(h || p) * 1000 + len(h)) AS v FROM d JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY d.url),
j AS (SELECT d.*, rule, v FROM d LEFT JOIN f ON d.url IS NOT DISTINCT FROM f.url),
e AS (SELECT x.address AS x, y.address AS y FROM links JOIN j x ON links.url = x.url JOIN j y ON links.target = y.url),
r AS (SELECT DISTINCT address AS x, address AS y FROM j WHERE address IS NOT NULL UNION SELECT r.x, q.y FROM r JOIN (SELECT x, y FROM e UNION SELECT y, x FROM e) q ON r.y = q.x),
k AS (SELECT r.x AS address, bool_or(v = 'block') AND NOT bool_or(v = 'allow') AS blocked FROM r JOIN j ON r.y = j.address WHERE v IS NOT NULL GROUP BY r.x)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN v IS NOT NULL THEN 'rule' WHEN blocked THEN 'alias' ELSE 'none' END AS via
FROM pages JOIN j ON pages.url IS NOT DISTINCT FROM j.url LEFT JOIN k ON j.address = k.address""",
    "op13_interval_search": f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{lexical.TERM}')) AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{lexical.TERM}')) AS w FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), g AS (SELECT count(*) AS docs, cast(sum(n) AS bigint) AS terms FROM n),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t SEMI JOIN i ON t.w = i.w GROUP BY doc_id, w),
df AS (SELECT w, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS bigint) AS weight FROM tf, g GROUP BY w),
s AS (SELECT item_id, tf.doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS bigint) AS score
  FROM i JOIN tf ON i.w = tf.w JOIN df ON df.w = tf.w JOIN n ON n.doc_id = tf.doc_id, g GROUP BY item_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, cast(rank AS integer) AS rank, doc_id, score FROM r WHERE rank <= 10""",
}
