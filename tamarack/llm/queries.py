"""The registered query of each training-data operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, langid, line_dedup, media, mixing, packing, secret_scan, sharding, simhash, substring_dedup


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that are within one edit of an earlier line."""
    cleaned = line_dedup.dedup_lines(common.documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_kept", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents that an earlier document has too."""
    return substring_dedup.repeated_spans(common.documents(spark, sf_dir))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    groups = simhash.simhash_groups(common.documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards all documents over 16 shards; the law that holds is `key`."""
    placed = sharding.shard_documents(common.documents(spark, sf_dir), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack"
    )


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents so that a source's bytes follow the square root of what it has."""
    mixed = mixing.mix_sources(common.documents(spark, sf_dir))
    return mixed.select(*common.DOCUMENT_COLUMNS, "copy", "position")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1024 tokens."""
    return packing.pack_documents(common.documents(spark, sf_dir))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as image tiles, stored, read back and described."""
    return media.media_features(media.store_media(common.documents(spark, sf_dir)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents; the largest doc_id stays."""
    groups = exact_dedup.exact_groups(common.documents(spark, sf_dir), keep="largest")
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.scan_secrets(common.documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a classifier that never saw the held-out fifth."""
    docs = common.documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_hash_tree_sharding": op4_hash_tree_sharding,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_media_columns": op7_media_columns,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
}



def _crc32_sql(text: str) -> str:
    """CRC-32 in SQL: folded over the text's bytes, half a byte at a time, with a table of 16 made by the polynomial's rule."""
    table = list(range(16))
    for _ in range(4):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    entries = "[" + ", ".join(f"{c}::BIGINT" for c in table) + "]"

    def folded(crc: str, half: str) -> str:
        return f"xor({crc} >> 4, {entries}[1 + (xor({crc}, {half}) & 15)])"

    codes = f"[('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode({text})), '..')]"
    whole = f"list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {folded(folded('c', 'b'), 'b >> 4')})"
    return f"xor(4294967295::BIGINT, {whole})"


def _draw_sql(kind: str, number: str, weight: float) -> str:
    bits = f"('0x' || substr(md5('{kind}-0-' || {number} || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT"
    return f"(-ln(({bits} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / {weight}::DOUBLE)"


# Regions 0 and 1 are full and are descended one level at a time. Region 2 has shard 16 alone, of racks 4 and 5.
_SHARDS = f"""
regions AS (
  SELECT row, doc_id, arg_min(region, draw) AS region, min(draw) AS draw
  FROM (SELECT row, doc_id, region, {_draw_sql("region", "region", 8)} AS draw FROM rows, range(0, 2) t(region)) GROUP BY ALL),
racks AS (
  SELECT row, doc_id, region, arg_min(rack, draw) AS rack
  FROM (SELECT row, doc_id, region, region * 2 + i AS rack, {_draw_sql("rack", "(region * 2 + i)", 4)} AS draw FROM regions, range(0, 2) t(i)) GROUP BY ALL),
shards AS (
  SELECT row, region, rack, arg_min(shard, draw) AS shard
  FROM (SELECT row, doc_id, region, rack, rack * 4 + i AS shard, {_draw_sql("shard", "(rack * 4 + i)", 1)} AS draw FROM racks, range(0, 4) t(i)) GROUP BY ALL),
new_racks AS (SELECT row, min(draw) AS least, min(draw) FILTER (i = 4) AS own FROM (SELECT row, i, {_draw_sql("rack", "i", 4)} AS draw FROM rows, range(4, 6) t(i)) GROUP BY row),
new_shards AS (SELECT row, min(draw) AS least, min(draw) FILTER (i = 16) AS own FROM (SELECT row, i, {_draw_sql("shard", "i", 1)} AS draw FROM rows, range(16, 20) t(i)) GROUP BY row),
placed AS (
  SELECT s.row, s.region, s.rack, s.shard,
    CASE WHEN {_draw_sql("region", "2", 8)} + ((k.own - k.least + n.own) - n.least) < r.draw THEN 16 ELSE s.shard END AS grown_shard
  FROM shards s JOIN regions r USING (row) JOIN new_racks k USING (row) JOIN new_shards n USING (row))
"""

ORACLES: dict[str, str] = {
    # Lines within one edit share their first or their last half of the shorter length.
    "op1_line_dedup": r"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS MATERIALIZED (
  SELECT row, doc_id, line_no, raw, trim(raw, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT row, doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS line_no FROM texts)),
firsts AS MATERIALIZED (
  SELECT line, length(line) AS n, min((doc_id, line_no)) AS at FROM lines WHERE line != '' GROUP BY line),
long AS MATERIALIZED (SELECT * FROM firsts WHERE n >= 20),
pairs AS (
  SELECT a.line AS a_line, a.at AS a_at, b.line AS b_line, b.at AS b_at
  FROM long a JOIN long b ON a.n = b.n AND left(a.line, a.n // 2) = left(b.line, a.n // 2) AND a.at < b.at
  UNION ALL
  SELECT a.line, a.at, b.line, b.at FROM long a JOIN long b ON a.n = b.n AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) AND a.at < b.at
  UNION ALL
  SELECT a.line, a.at, b.line, b.at FROM long a JOIN long b ON b.n = a.n + 1 AND left(a.line, a.n // 2) = left(b.line, b.n // 2 - (b.n % 2 = 0)::INT)
  UNION ALL
  SELECT a.line, a.at, b.line, b.at FROM long a JOIN long b ON b.n = a.n + 1 AND right(a.line, a.n - a.n // 2) = right(b.line, b.n - b.n // 2 - (b.n % 2 = 1)::INT)),
gone AS (
  SELECT DISTINCT CASE WHEN a_at < b_at THEN b_line ELSE a_line END AS line
  FROM pairs WHERE levenshtein(a_line, b_line) <= 1),
held AS (
  SELECT l.*, l.line = '' OR (f.at = (l.doc_id, l.line_no) AND g.line IS NULL) AS keep
  FROM lines l LEFT JOIN firsts f USING (line) LEFT JOIN gone g USING (line))
SELECT doc_id, count(*) FILTER (line != '') AS n_lines, count(*) FILTER (line != '' AND keep) AS n_kept,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (keep), '')) AS kept_sha256
FROM held GROUP BY row, doc_id
""",
    "op4_hash_tree_sharding": f"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
sums AS MATERIALIZED (SELECT row, doc_id, strlen(text)::BIGINT + 1 AS size, {_crc32_sql("text")} AS text_crc32 FROM rows),
{_SHARDS}
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5('slot:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), doc_id, text_crc32, size) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard, region::INTEGER AS region, rack::INTEGER AS rack
FROM sums JOIN placed USING (row)
""",
    "op5_poisson_mixing": """
WITH sized AS (SELECT source, count(*) AS n, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS b FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(b) * ((SELECT sum(b) FROM sized) / (SELECT sum(sqrt(b)) FROM sized)) / b AS rate FROM sized),
parted AS (SELECT source, greatest(1, ceil(rate / 32))::INTEGER AS parts, rate / greatest(1, ceil(rate / 32)) AS mean FROM rates),
chances AS (
  SELECT source, parts, i AS k,
    sum(exp(i * ln(mean) - mean - lgamma(i + 1))) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS cdf
  FROM parted, range(0, 100) t(i) WHERE i <= (mean + 12 * sqrt(mean) + 30)::INTEGER),
tables AS (SELECT source, parts, list(cdf ORDER BY k) AS cdf FROM chances GROUP BY source, parts),
drawn AS (
  SELECT d.*, t.cdf, unnest(range(1, t.parts + 1)) AS part
  FROM (SELECT row_number() OVER () AS row, md5(coalesce(text, '')) AS digest, * FROM documents) d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
numbers AS (
  SELECT row, doc_id, digest, text, lang, source, n_chars,
    sum(len(list_filter(cdf, lambda c: c < (('0x' || substr(md5('copies-20:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || part), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE))) AS n
  FROM drawn GROUP BY ALL),
copies AS (SELECT doc_id, digest, text, lang, source, n_chars, unnest(range(1, n::BIGINT + 1))::INTEGER AS copy FROM numbers)
SELECT doc_id, text, lang, source, n_chars, copy,
  row_number() OVER (ORDER BY md5('order-20:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || copy), doc_id, copy) - 1 AS position
FROM copies
""",
    "op8_exact_dedup": """
WITH n AS (SELECT row_number() OVER () AS row, doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, row) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
""",
}
