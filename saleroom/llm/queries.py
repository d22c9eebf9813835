"""The queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleroom.llm import align, language, leaks, licenses, lines, mixing, negatives, pages, quality, repeats, rules, simhash, urls
from saleroom.llm.tokens import is_held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    context = quality.context_table(docs)
    net = quality.learned(docs, table(spark, sf_dir, "labels"), context, allowed=~is_held_out(F.col("doc_id")))
    return quality.scored(docs, context, net).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), with_text=False).withColumnRenamed("kept", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learned_from(docs, allowed=language.training_rows())
    return language.identified(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.licences(docs, licenses.learned(docs))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


URL_RULES = (
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
)


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the same id: bad if toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("bad"))
    found = urls.judged(table(spark, sf_dir, "pages"), labels, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


TOKENIZERS = "/opt/tokenizers"


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    a, b = align.byte_level(f"{folder}/byte_bpe_50k.json"), align.piece_model(f"{folder}/piece_bpe_32k.model")
    return align.aligned(table(spark, sf_dir, "documents"), a, b, lists=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), every=100)


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = rf"""
WITH doc_words AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents),
item_words AS (SELECT item_id, {_WORDS.format('lower(text)')} AS w FROM benchmark),
doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM doc_words),
item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM item_words),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM item_shingles JOIN doc_shingles USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id)
WHERE 10 * n_shared >= 8 * n_shingles
"""

_PLACE = r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {})"

# The priors' strengths are fitted as in the operator; suffixes and domains of these hosts are their last one and two labels or an address.
OP11_SQL = rf"""
WITH places AS (
  SELECT page_id, translate(coalesce({_PLACE.format(1)}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce({_PLACE.format(2)}, '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
different AS (SELECT DISTINCT host, path FROM places),
ruled AS (
  SELECT host, path, max_by(rule_host || rule_path, len(rule_host || rule_path)) AS rule, max_by(rule_verdict, len(rule_host || rule_path)) AS rule_verdict
  FROM different JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path),
told AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT DISTINCT page_id, host, bad FROM places JOIN told ON page_id = doc_id),
counted AS (SELECT host, count(*) AS n, sum(bad) AS k FROM labelled GROUP BY host),
hosts AS (
  SELECT host, coalesce(n, 0)::BIGINT AS n, coalesce(k, 0)::BIGINT AS k, regexp_replace(regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g'), '\.$', '') AS bare
  FROM (SELECT DISTINCT host FROM places) LEFT JOIN counted USING (host)),
named AS (
  SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN bare ELSE regexp_extract(bare, '[^.]*$') END AS suffix,
         CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN bare ELSE regexp_extract(bare, '([^.]*\.)?[^.]*$') END AS domain
  FROM hosts),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, (sum(sum(k)) OVER () + 1) / (sum(sum(n)) OVER () + 2) AS m FROM named GROUP BY suffix),
suffix_rho AS (
  SELECT greatest(1 / 1001.0, least(0.5, coalesce((sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) AS rho
  FROM suffixes),
suffix_share AS (SELECT suffix, (k + (1 / rho - 1) * m) / (n + 1 / rho - 1) AS m FROM suffixes, suffix_rho),
domains AS (
  SELECT domain, n, k, m FROM (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM named GROUP BY suffix, domain) JOIN suffix_share USING (suffix)),
domain_rho AS (
  SELECT greatest(1 / 1001.0, least(0.5, coalesce((sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) AS rho
  FROM domains),
domain_share AS (SELECT domain, (k + (1 / rho - 1) * m) / (n + 1 / rho - 1) AS m FROM domains, domain_rho),
children AS (SELECT host, n, k, m FROM named JOIN domain_share USING (domain)),
host_rho AS (
  SELECT greatest(1 / 1001.0, least(0.5, coalesce((sum((k - n * m) * (k - n * m)) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) AS rho
  FROM children),
posterior AS (
  SELECT host, n, k, k + (1 / rho - 1) * m AS bad, n - k + (1 / rho - 1) * (1 - m) AS good FROM children, host_rho)
SELECT page_id, p.host, p.path, rule,
       coalesce(rule_verdict, CASE WHEN 1 / (1 + exp(1.645 * sqrt(1 / bad + 1 / good) - ln(bad / good))) > 0.3 THEN 'block' ELSE 'allow' END) AS verdict,
       n::BIGINT AS n_labelled, k::BIGINT AS n_bad
FROM places p JOIN posterior q ON p.host = q.host LEFT JOIN ruled r ON p.host = r.host AND p.path = r.path
"""

OP13_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
 AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scans": op8_license_scans,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_url_filters": op11_url_filters,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL = {"op1_decontamination": OP1_SQL, "op11_url_filters": OP11_SQL, "op13_hard_negatives": OP13_SQL}
