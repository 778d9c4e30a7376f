"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table and derives the columns that are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, quality_nbsvm
from .cover_tree import near_vectors
from .lm_difference import cross_entropy_difference
from .minhash_dedup import near_duplicates
from .order_minhash import edited_neighbours
from .packing import pack
from .perspectives import rotate_perspectives, span_text
from .url_filter import Rule, judge_urls
from .warc_revisit import header_text, resolve_revisits

try:  # the tokenizer files' folder; only a default, every operator takes a path
    import public_tokenizers

    BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
except ModuleNotFoundError:
    BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of two crawls, by a fixed rule: the table holds pages only.

    The first crawl fetches page p in full at time p.  The second asks again at time 10,000,000 + p
    and is told "not modified"; where p mod 17 = 0 it came before the first, at time p - 10,000,000.  The answer's validators: entity tag and date,
    where p mod 11 = 0 another tag, where p mod 13 = 0 the payload's digest alone."""
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), F.expr("cast(page_id % 365 as string)"))
    page = pages.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"), F.length("html").cast("long").alias("length"), etag.alias("etag"), modified.alias("modified"))
    first = page.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("captured"), F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), F.col("etag"), F.lit("Last-Modified"), F.col("modified"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        "digest", "length",
    )
    tag = F.when(F.expr("page_id % 11 = 0"), F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("etag")))
    full = F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), F.col("modified"), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Server"), F.lit("edge"))
    bare = F.create_map(F.lit("Date"), F.lit("later"), F.lit("Content-Type"), F.lit("text/plain"))
    second = page.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", F.expr("case when page_id % 17 = 0 then page_id - 10000000 else page_id + 10000000 end").alias("captured"), F.lit("revisit").alias("kind"),
        F.when(F.expr("page_id % 13 = 0"), bare).otherwise(full).alias("headers"), "digest", F.lit(0).cast("long").alias("length"),
    )
    return first.union(second)


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(captures(table(spark, sf_dir, "pages"))).withColumn("headers", header_text(F.col("headers")))


OP1_SQL = r"""
WITH page AS (
  SELECT page_id, md5(html) AS digest, CAST(length(html) AS bigint) AS length, '"' || substr(md5(html), 1, 16) || '"' AS etag, 'day ' || CAST(page_id % 365 AS varchar) AS modified,
         regexp_replace(trim(coalesce(url, ''), ' '), '#.*$', '') AS plain FROM pages),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(plain, '://([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^www\.', '')
            || regexp_replace(regexp_extract(plain, '://[^/?]*([^?]*)', 1), '/+$', '') AS hp,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))), '&') AS q
  FROM page),
named AS (SELECT *, CASE WHEN instr(plain, '://') = 0 THEN plain ELSE hp || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS url_key FROM keyed),
revisit AS (
  SELECT page_id, page_id * 2 + 1 AS record_id, url_key, digest, CASE WHEN page_id % 17 = 0 THEN page_id - 10000000 ELSE page_id + 10000000 END AS captured,
         page_id % 13 = 0 AS bare, CASE WHEN page_id % 11 = 0 THEN '"other"' ELSE etag END AS tag, CASE WHEN page_id % 11 = 0 THEN '"other"' ELSE 'W/' || etag END AS tag_text, modified
  FROM named),
ranked AS (
  SELECT r.record_id, r.url_key, r.captured, r.bare, r.tag, r.tag_text, r.modified, r.digest AS own,
         f.page_id AS fid, f.etag AS fetag, f.modified AS fmod, f.digest AS fdigest, f.length AS flength,
         row_number() OVER (PARTITION BY r.record_id ORDER BY f.page_id DESC NULLS LAST) AS k
  FROM revisit r LEFT JOIN named f ON f.url_key = r.url_key AND f.page_id < r.captured),
found AS (SELECT *, CASE WHEN fid IS NULL THEN 'no earlier response' WHEN (NOT bare AND tag <> fetag) OR (bare AND own <> fdigest) THEN 'validators differ' ELSE 'resolved' END AS status FROM ranked WHERE k = 1)
SELECT record_id, url_key, captured, status, CASE WHEN fid IS NULL THEN NULL WHEN bare THEN 'digest' ELSE 'etag' END AS checked_by,
       CASE WHEN status = 'resolved' THEN fid * 2 END AS refers_to, fid AS earlier_captured,
       CASE WHEN status = 'resolved' AND bare THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: later' || chr(10) || 'etag: ' || fetag || chr(10) || 'last-modified: ' || fmod
            WHEN status = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || tag_text || chr(10) || 'last-modified: ' || modified
            WHEN bare THEN 'content-type: text/plain' || chr(10) || 'date: later'
            ELSE 'cache-control: max-age=600' || chr(10) || 'etag: ' || tag_text || chr(10) || 'last-modified: ' || modified || chr(10) || 'server: edge' END AS headers,
       CASE WHEN status = 'resolved' THEN fdigest ELSE own END AS digest, CASE WHEN status = 'resolved' THEN flength END AS length
FROM found
"""


#: The target mix of the registered query and of the pipeline.
MIX = mixing.Weights(
    domain={"web": 0.5, "news": 0.3, "books": 0.2},
    lang={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    source={"src0": 2.0},
)


def domain_of(source: Column) -> Column:
    """Sources src0 to src9 are web, src10 to src14 news, all others books."""
    number = F.regexp_extract(source, "^src([0-9]{1,4})$", 1)
    return F.when(number == "", "books").when(number.cast("int") < 10, "web").when(number.cast("int") < 15, "news").otherwise("books")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_tokens(table(spark, sf_dir, "documents"), MIX, domain_of(F.col("source")), budget_share=1.0, max_epochs=3, seed=17)


OP2_SQL = """
WITH slim AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CASE WHEN NOT coalesce(regexp_matches(source, '^src[0-9]{1,4}$'), false) THEN 'books'
              WHEN CAST(substr(source, 4) AS int) < 10 THEN 'web'
              WHEN CAST(substr(source, 4) AS int) < 15 THEN 'news' ELSE 'books' END AS domain,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS double) AS tokens, 3.0 * CAST(sum(tokens) AS double) AS room,
         CASE domain WHEN 'web' THEN 0.5::double WHEN 'news' THEN 0.3::double WHEN 'books' THEN 0.2::double ELSE 1.0::double END AS w_domain,
         CASE lang WHEN 'en' THEN 0.55::double WHEN 'de' THEN 0.15::double WHEN 'fr' THEN 0.15::double WHEN 'es' THEN 0.15::double ELSE 1.0::double END AS w_lang,
         CASE source WHEN 'src0' THEN 2.0::double ELSE 1.0::double END AS w_source
  FROM slim GROUP BY ALL),
d1 AS (SELECT domain, w_domain AS w, sum(room) AS c FROM leaves GROUP BY ALL),
d2 AS (SELECT *, (SELECT floor(sum(tokens)) FROM leaves) AS b FROM d1),
d3 AS (SELECT *, (b - (sum(c) OVER o - c)) / (sum(w) OVER () - sum(w) OVER o + w) AS lv FROM d2 WINDOW o AS (ORDER BY c / w, domain ROWS UNBOUNDED PRECEDING)),
d4 AS (SELECT *, max(CASE WHEN c / w > lv THEN lv END) OVER () AS l FROM d3),
d5 AS (SELECT domain, CASE WHEN l IS NULL THEN c ELSE least(c, w * l) END AS b FROM d4),
l1 AS (SELECT domain, lang, w_lang AS w, sum(room) AS c FROM leaves GROUP BY ALL),
l3 AS (SELECT l1.*, (b - (sum(c) OVER o - c)) / (sum(w) OVER (PARTITION BY domain) - sum(w) OVER o + w) AS lv
       FROM l1 JOIN d5 USING (domain) WINDOW o AS (PARTITION BY domain ORDER BY c / w, lang ROWS UNBOUNDED PRECEDING)),
l4 AS (SELECT *, max(CASE WHEN c / w > lv THEN lv END) OVER (PARTITION BY domain) AS l FROM l3),
l5 AS (SELECT domain, lang, CASE WHEN l IS NULL THEN c ELSE least(c, w * l) END AS b FROM l4),
s1 AS (SELECT domain, lang, source, tokens, w_source AS w, room AS c FROM leaves),
s3 AS (SELECT s1.*, (b - (sum(c) OVER o - c)) / (sum(w) OVER (PARTITION BY domain, lang) - sum(w) OVER o + w) AS lv
       FROM s1 JOIN l5 USING (domain, lang) WINDOW o AS (PARTITION BY domain, lang ORDER BY c / w, source ROWS UNBOUNDED PRECEDING)),
s4 AS (SELECT *, max(CASE WHEN c / w > lv THEN lv END) OVER (PARTITION BY domain, lang) AS l FROM s3),
plan AS (SELECT domain, lang, source, CAST(tokens AS bigint) AS t,
                CAST(floor(round(CASE WHEN l IS NULL THEN c ELSE least(c, w * l) END, 3)) AS bigint) AS a FROM s4),
used AS (SELECT *, CASE WHEN t > 0 THEN a // t ELSE 0 END AS whole FROM plan WHERE a > 0),
rowz AS (SELECT slim.*, whole, a - whole * t AS rest FROM slim JOIN used USING (domain, lang, source)),
part AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source
                     ORDER BY md5('17:' || CAST(whole + 1 AS varchar) || ':' || CAST(doc_id AS varchar)), doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS before
         FROM rowz WHERE rest > 0)
SELECT doc_id, domain, lang, source, CAST(e AS int) AS epoch, tokens, tokens AS taken FROM (SELECT *, unnest(range(1, whole + 1)) AS e FROM rowz)
UNION ALL
SELECT doc_id, domain, lang, source, CAST(whole + 1 AS int), tokens, CAST(least(tokens, rest - before) AS bigint) FROM part WHERE before < rest
"""


URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


OP3_SQL = """
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT DISTINCT ON (host, path) host, path, rule, verdict FROM fits) f ON f.host = parts.host AND f.path = parts.path
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE, length=2048, end_id=1)


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations")).withColumn("spans", span_text(F.col("spans")))


OP5_SQL = """
WITH said AS (
  SELECT conv_id, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, 'unknown') || chr(31) || coalesce(text, ''))) - 1 AS place
  FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS speaker FROM said WHERE who <> 'system'),
lines AS (
  SELECT s.conv_id, p.speaker, place // 64 AS part, place, who = p.speaker AS mine,
         '<|im_start|>' || CASE WHEN who = p.speaker THEN 'assistant' WHEN who = 'system' THEN 'system'
                                ELSE 'user name=' || regexp_replace(who, '[^A-Za-z0-9_-]', '_', 'g') || CASE WHEN regexp_matches(who, '[^A-Za-z0-9_-]') THEN '-' || substr(md5(who), 1, 8) ELSE '' END END || chr(10) AS heading,
         replace(s.text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
ended AS (
  SELECT *, sum(length(heading) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place ROWS UNBOUNDED PRECEDING) AS e FROM lines),
parts AS (
  SELECT conv_id, speaker, CAST(part AS bigint) AS part, CAST(count(*) AS int) AS messages, string_agg(heading || body, '' ORDER BY place) AS dialogue,
         coalesce(string_agg(CAST(e - length(body) AS varchar) || '-' || CAST(e AS varchar), ' ' ORDER BY place) FILTER (WHERE mine), '') AS spans
  FROM ended GROUP BY conv_id, speaker, part)
SELECT conv_id, speaker, part, messages, dialogue, spans,
       CAST(sum(length(dialogue)) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS UNBOUNDED PRECEDING) - length(dialogue) AS bigint) AS start
FROM parts
"""


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_nbsvm.fit(documents, table(spark, sf_dir, "labels"), quality_nbsvm.not_held_out())
    scored = model.score(documents, keep=["doc_id"])
    held_out = F.coalesce(~quality_nbsvm.not_held_out(), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", quality_nbsvm.predicted(F.col("score")).alias("predicted"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: all documents labelled as good and not toxic; background: all documents."""
    targets = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), targets, BYTE_BPE)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_revisit": op1_warc_revisit,
        "op2_mixing": op2_mixing,
        "op3_url_filter": op3_url_filter,
        "op4_packing": op4_packing,
        "op5_perspectives": op5_perspectives,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_quality_nbsvm": op7_quality_nbsvm,
        "op8_cover_tree": op8_cover_tree,
        "op9_lm_difference": op9_lm_difference,
        "op10_order_minhash": op10_order_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisit": OP1_SQL, "op2_mixing": OP2_SQL, "op3_url_filter": OP3_SQL, "op5_perspectives": OP5_SQL}
