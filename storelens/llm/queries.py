"""The registered queries of this subpackage, with production parameters, and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    kneser_ney,
    langid,
    maxent,
    mixing,
    negatives,
    nn_descent,
    packing,
    quality_rules,
    secrets,
    sharding,
    simhash,
    url_rules,
    whitening,
)
from .common import table

#: Where the vocabulary of the packing query lies; only a path, the file is never copied.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def judge_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


def group_by_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def group_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def apply_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", "rule_text")


def whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(whitening.whiten(table(spark, sf_dir, "embeddings")))


def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size, digest = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), digest.alias("text_crc32"))
    return sharding.shard(rows).withColumn("grown_shard", F.lit(None).cast("int"))


def mine_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    mined = negatives.mine(vectors, F.col("vec_id") % 100 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES = {
    "op1_mix_sources": mix_sources,
    "op2_score_text": score_text,
    "op3_pack_documents": pack_documents,
    "op4_scan_secrets": scan_secrets,
    "op5_identify_language": identify_language,
    "op6_judge_perplexity": judge_perplexity,
    "op7_filter_urls": filter_urls,
    "op8_group_by_simhash": group_by_simhash,
    "op9_group_embeddings": group_embeddings,
    "op10_quality_rules": apply_quality_rules,
    "op11_whiten_embeddings": whiten_embeddings,
    "op12_shard_documents": shard_documents,
    "op13_mine_hard_negatives": mine_hard_negatives,
}

_URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(h, p, action) AS (
  VALUES %s
)
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(action, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM split
""" % ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in url_rules.RULES)

_MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim,
    (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), targets AS (
  SELECT source, source_size, least(lim, weight * max(level) OVER ()) AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS wanted,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, wanted - before)) + greatest(0, least(size, wanted - source_size - before)))::BIGINT AS taken
FROM placed
"""

_NEGATIVES_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: coalesce(NOT isfinite(c), true))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""


def _shard_sql() -> str:
    """The permutation's rounds as nested selects; a recursive query walks the cycles."""
    step = "SELECT number, n, high, low, v FROM walk WHERE first OR v >= n"
    for r, key in enumerate(sharding.round_keys(sharding.SEED)):
        a, b = ("high", "low") if r % 2 == 0 else ("low", "high")
        mixed = f"(xor(v & ((1::HUGEINT << {b}) - 1), {key}) * {sharding.MULTIPLY[0]}) & {sharding.WORD}"
        step = f"SELECT *, {mixed} AS h FROM ({step})"
        step = f"SELECT *, (xor(h, h >> {sharding.SHIFTS[0]}) * {sharding.MULTIPLY[1]}) & {sharding.WORD} AS g FROM ({step})"
        turned = f"xor(v >> {b}, xor(g, g >> {sharding.SHIFTS[1]}) & ((1::HUGEINT << {a}) - 1))"
        step = f"SELECT number, n, high, low, ((v & ((1::HUGEINT << {b}) - 1)) << {a}) | {turned} AS v FROM ({step})"
    return f"""
WITH RECURSIVE table256 AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents
), hashed AS (
  SELECT doc_id, len(bytes)::BIGINT + 1 AS size, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS number,
    xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM texts, table256
), widths AS (
  SELECT n, bits - bits // 2 AS high, bits // 2 AS low
  FROM (SELECT count(*) AS n, greatest(2, length(ltrim(bin(greatest(count(*) - 1, 0)), '0'))) AS bits FROM documents)
), walk(number, n, high, low, v, first) AS (
  SELECT number, n::HUGEINT, high::INTEGER, low::INTEGER, number::HUGEINT, true FROM hashed, widths
  UNION ALL
  SELECT number, n, high, low, v, false FROM ({step})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {sharding.SHARDS})::INTEGER AS shard, (v // {sharding.SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM hashed JOIN walk USING (number) WHERE NOT first AND v < n
"""


ORACLE = {"op12_shard_documents": _shard_sql(), "op13_mine_hard_negatives": _NEGATIVES_SQL, "op1_mix_sources": _MIX_SQL, "op7_filter_urls": _URL_SQL}

