"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from providerfx.llm import blocks as B
from providerfx.llm import byte_spans, decontamination, near_duplicates, packing, quality, substrings, token_counts, token_file, toxicity, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    hit, items = decontamination.n_hit(), F.sort_array("found.items")
    return found.select("doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
sizes AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN wins USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(docs, shingle=4, percent=80, columns=["doc_id"]).select("doc_id", "n_shingles", "component_id", "kept")


OP2 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, array_to_string(w[p:p + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = B.new_path(spark, "token-file")
    token_file.write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_file.read_token_file(spark, path, digest=True)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs, window=35, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY win) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM twice),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept FROM each ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_spans.dedup_bytes(docs, size=50, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), held_out)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the table's own hosts: (entry, action, day).

    A quarter of the hosts and of their parent domains of three labels or more is added on some day, removed 40
    days later, and half of these are added again 90 days after the first time.
    """
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).filter("host is not null")
    parents = hosts.filter(F.size(F.split("host", r"\.")) > 2).select(F.regexp_replace("host", r"^[^.]*\.", "").alias("host"))
    names = hosts.union(parents).distinct().withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 300).cast("int"))
    first = names.filter("h % 4 = 0").select(F.col("host").alias("entry"), "h", day.alias("first"))
    event = F.expr("explode(array(struct('add' AS action, 0 AS after, 4 AS m), struct('remove' AS action, 40 AS after, 4 AS m), struct('add' AS action, 90 AS after, 8 AS m)))")
    return first.select("*", event.alias("e")).filter("h % e.m = 0").select("entry", "e.action", F.expr("date_add(first, e.after)").alias("day"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 131 % 366).cast("int"))
    out = url_filters.filter_urls(pages.withColumn("day", fetched), list_entries(pages))
    return out.select("page_id", "host", F.col("day").cast("string").alias("fetched"), "n_active", "blocked", "entry", F.col("since").cast("string").alias("since"))


OP10 = r"""
WITH p AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', ''), '') AS host,
  DATE '2024-01-01' + (page_id * 131 % 366)::INTEGER AS day FROM pages),
names AS (SELECT DISTINCT host FROM (SELECT host FROM p WHERE host IS NOT NULL UNION ALL SELECT regexp_replace(host, '^[^.]*\.', '') FROM p WHERE len(string_split(host, '.')) > 2)),
hashed AS (SELECT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM names),
events AS (SELECT host AS entry, action, DATE '2024-01-01' + (h % 300)::INTEGER + after AS day FROM hashed,
  (VALUES ('add', 0, 4), ('remove', 40, 4), ('add', 90, 8)) AS e(action, after, m) WHERE h % 4 = 0 AND h % m = 0),
held AS (SELECT * FROM (SELECT entry, action, day AS since, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until FROM (SELECT entry, day, max(action) AS action FROM events GROUP BY ALL)) WHERE action = 'add'),
hits AS (SELECT page_id, entry, since FROM p JOIN held ON (p.host = entry OR ends_with(p.host, '.' || entry)) AND contains(entry, '.') AND day >= since AND (until IS NULL OR day < until)),
best AS (SELECT page_id, count(*) AS n_active, arg_max(entry, len(entry)) AS entry, arg_max(since, len(entry)) AS since FROM hits GROUP BY page_id)
SELECT page_id, host, day::VARCHAR AS fetched, coalesce(n_active, 0)::BIGINT AS n_active, n_active IS NOT NULL AS blocked, entry, since::VARCHAR AS since
FROM p LEFT JOIN best USING (page_id)
"""

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_near_duplicates, op3_token_file, op4_substrings, op5_token_counts, op6_suffix_arrays, op7_toxicity, op8_packing, op9_quality, op10_url_filters)}
ORACLE_SQL = {"op1_decontamination": OP1, "op2_near_duplicates": OP2, "op4_substrings": OP4, "op10_url_filters": OP10}
