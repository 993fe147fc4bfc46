"""The operators over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import license_scan as licenses
from blockloom.llm import sql
from blockloom.llm.ann import nearest
from blockloom.llm.langid import held_out, train_and_identify
from blockloom.llm.line_dedup import apply_bitmaps, line_dedup
from blockloom.llm.mixing import mix
from blockloom.llm.packing import pack
from blockloom.llm.pii import pseudonymize
from blockloom.llm.simhash import simhash_groups
from blockloom.llm.sketch import edited_fingerprints
from blockloom.llm.suffix_dedup import suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return apply_bitmaps(docs, line_dedup(docs, min_docs=10, min_chars=1), digest=True)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), length=400, digest=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), words=3, distance=2).select("doc_id", "fingerprint", "component_id")


def tokenizer_json(path: str | None = None) -> str:
    """The content of a tokenizer file; the public word tokenizer by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_json(), with_ids=False, near_col="lang")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = train_and_identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.array_join("languages.lang", ",").alias("lang_set"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


#: The key of the pseudonyms in the registered query; a deployment passes its own.
PII_KEY = "blockloom example key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

OP9_SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::BIGINT AS w FROM g),
r AS (SELECT *, row_number() OVER o AS k,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (2 * coalesce(sum(source_size) OVER b, 0))::DOUBLE AS rest,
             ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0))::DOUBLE AS over_w
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / w, source IS NULL, encode(source)),
                    b AS (ORDER BY source_size::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT k AS ak, rest AS arest, over_w AS aover FROM r WHERE rest / over_w * w <= 2 * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN k >= ak THEN arest / aover * w ELSE (2 * source_size)::DOUBLE END AS target FROM r, a),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS draw
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(rate) + (draw < rate - floor(rate))::INT, 2) * size)::BIGINT AS taken FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_nearest": op4_nearest,
    "op5_license_scan": op5_license_scan,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_suffix_dedup": sql.repeats(400),
    "op3_simhash": sql.simhash(3, 2),
    "op4_nearest": sql.nearest(50, 5),
    "op5_license_scan": licenses.oracle_sql(),
    "op9_mixing": OP9_SQL,
    "op10_fingerprints": sql.sketches(128, 5),
}
