"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language, line_dedup, main_text, near_dedup, packing, pieces, quality, secrets, url_rules
from .common import table

#: Fixed by the contract of op2.
BASE_URL_RULES = [
    url_rules.host_rule("net/", "block"),
    url_rules.host_rule("example.net/en/", "allow"),
    url_rules.host_rule("example.com/de/", "block"),
    url_rules.host_rule("org/fr/", "allow"),
]
#: Words of hosts that carry no text worth keeping.
WORD_URL_RULES = [url_rules.word_rule(w, "block") for w in ("spam", "spam-farm", "adult", "adult-x", "casino", "porn", "xxx", "warez", "phishing", "malware")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, BASE_URL_RULES + WORD_URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = F.transform("kept_runs", lambda r: F.concat_ws("-", r["start"], r["start"] + r["length"] - 1))
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), F.array_join(runs, ",").alias("kept_runs"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).withColumnRenamed("id", "doc_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.fit_and_judge(docs, table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0))
    model = language.fit(docs.where(fold != 0))
    out = language.predict(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filters": op2_url_filters,
    "op3_html_extraction": op3_html_extraction,
    "op4_secret_scans": op4_secret_scans,
    "op5_line_dedup": op5_line_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": rf"""
        WITH u AS (
            SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r(pattern, verdict, h, p) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
            ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
        w AS (
            SELECT *, (SELECT max_by(struct_pack(pattern := pattern, verdict := verdict), length(pattern)) FROM r
                       WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)) AS won
            FROM u)
        SELECT page_id, host, path, won.pattern AS rule,
               coalesce(won.verdict, CASE WHEN regexp_matches(host, '(^|[.-])(spam|adult|casino|porn|xxx|warez|phishing|malware)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM w""",
    "op5_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM l),
        f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        j AS (SELECT k.*, (f.key IS NOT NULL AND k.doc_id > f.first_id) AS gone FROM k LEFT JOIN f USING (key)),
        b AS (SELECT doc_id, pos - 1 AS at, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM j WHERE NOT gone),
        r AS (SELECT doc_id, string_agg(a || '-' || z, ',' ORDER BY a) AS runs FROM (SELECT doc_id, min(at) AS a, max(at) AS z FROM b GROUP BY doc_id, run) GROUP BY doc_id),
        o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                     sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id)
        SELECT o.*, coalesce(r.runs, '') AS kept_runs FROM o LEFT JOIN r USING (doc_id)""",
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op7_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, len(g) AS n FROM s),
        x AS (SELECT doc_id, unnest(g) AS g FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id""",
}
