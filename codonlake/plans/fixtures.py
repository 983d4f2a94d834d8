"""Stand-ins for the workbooks, which are not public: transcripts and coding sequences derived from the documents table,
predictions from lineitem. Each has a Spark form and the SQL that derives the same rows in DuckDB.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions.features import FEATURES
from codonlake.sources.store import snapshot

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAPPED = "GCATGCATGCATGCATGCATGCATGCCGTACGTACGTACGTACGTACGTACG"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A small input can be one file with one row group, and so one task; deal it out. Larger inputs stay as they are."""
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


_BASES = bytes.maketrans(LETTERS.encode(), MAPPED.encode())
_OTHERS = bytes(b for b in range(256) if b not in LETTERS.encode())


def _mapped(text: pa.Array) -> pa.Array:
    """Letters as bases, all other characters dropped: bytes of other characters are never those of letters."""
    return pa.array([None if t is None else t.translate(_BASES, _OTHERS) for t in text.cast(pa.large_binary()).to_pylist()], pa.binary()).cast(pa.string())


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = F.arrow_udf(_mapped, "string")("text")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", mapped.alias("s"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_id, tx_sequence, utr5_size, cds_size, fold, te; with null sequences, sizes and targets, lower case and U."""
    rows = _letters(spark, sf_dir).withColumn("len", F.length("s"))
    return rows.selectExpr(
        "doc_id AS gene_id",
        "CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN lower(s) WHEN doc_id % 3 = 2 THEN replace(s, 'T', 'U') ELSE s END AS tx_sequence",
        "CASE WHEN doc_id % 89 = 0 THEN NULL ELSE CAST((len * 15 - (len * 15) % 100) / 100 AS INT) END AS utr5_size",
        "CASE WHEN doc_id % 79 = 0 THEN NULL ELSE CAST((len - len % 6) / 6 AS INT) * 3 END AS cds_size",
        "CAST(doc_id % 10 AS INT) AS fold",
        "CASE WHEN doc_id % 83 = 0 THEN NULL ELSE ln(1 + len) / 10 + (doc_id % 17) / 17.0E0 END AS te",
    )


def source(spark: SparkSession, sf_dir: str) -> str:
    """A snapshot of the files that transcripts come from, so that a stored matrix is found and named without reading them."""
    return snapshot(spark, f"{sf_dir}/documents.parquet", "transcripts")


def cds_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, header, seq; sound coding sequences and each kind of fault."""
    body = F.array_join(F.filter(F.regexp_extract_all("s", F.lit("(.{3})"), F.lit(1)), lambda c: ~c.isin("TAA", "TAG", "TGA")), "")
    return _letters(spark, sf_dir).select("doc_id", body.alias("body")).selectExpr(
        "doc_id AS rec_id",
        """concat('lcl|rec', CAST(doc_id AS STRING), ' [gene=', CASE WHEN doc_id % 5 = 0 THEN concat('RPL', CAST(doc_id % 40 AS STRING))
           WHEN doc_id % 5 = 1 THEN concat('Rps', CAST(doc_id % 30 AS STRING)) WHEN doc_id % 5 = 2 THEN 'RPLX' ELSE concat('GENE', CAST(doc_id AS STRING)) END, '] [protein=p]') AS header""",
        """CASE WHEN doc_id % 11 = 0 THEN concat('CTG', body, 'TAA') WHEN doc_id % 13 = 0 THEN concat('ATG', body, 'TAGTAA') WHEN doc_id % 17 = 0 THEN concat('ATG', body, 'NNN', 'TGA')
           WHEN doc_id % 19 = 0 THEN concat('ATG', body, 'A') WHEN doc_id % 23 = 0 THEN concat('ATG', body) ELSE concat('ATG', body, 'TGA') END AS seq""",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, fold, id, y, y_hat; one fold of one row, a constant target and a constant prediction among them."""
    line = table(spark, sf_dir, "lineitem").selectExpr(
        "'base' AS model", "CAST(l_orderkey % 10 AS INT) AS fold", "l_orderkey * 10 + l_linenumber AS id", "CAST(l_extendedprice AS DOUBLE) AS y", "CAST(l_quantity AS DOUBLE) * 1500 AS y_hat"
    )
    odd = spark.sql("SELECT * FROM VALUES ('odd', 0, 1L, 1.5D, 2.0D), ('odd', 3, 2L, 2.0D, 1.0D), ('odd', 3, 3L, 2.0D, 3.0D), ('odd', 7, 4L, 1.0D, 5.0D), ('odd', 7, 5L, 4.0D, 5.0D), ('odd', 9, 6L, 1.0D, 1.0D), ('odd', 9, 7L, 1.0D, 1.0D) AS t(model, fold, id, y, y_hat)")
    return line.unionByName(odd)


#: Lines of a tRNA FASTA file by document: headers with one or two names, isotypes that do not count, and sequence lines.
_ANTI = "CASE WHEN doc_id % 3 = 1 THEN lower(substr(s, 1 + doc_id % 50, 3)) WHEN doc_id % 3 = 2 THEN replace(substr(s, 1 + doc_id % 50, 3), 'T', 'U') ELSE substr(s, 1 + doc_id % 50, 3) END"
_TYPE = "CASE doc_id % 5 WHEN 0 THEN 'Ala' WHEN 1 THEN 'Cys' WHEN 2 THEN 'iMet' WHEN 3 THEN 'SeC' ELSE 'gly' END"
TRNA_LINE = f"""CASE WHEN doc_id % 4 = 3 THEN concat('tRNA-Ala-AGC-', substr(s, 1, 40)) ELSE concat('>Homo_sapiens_tRNA-', {_TYPE}, '-', {_ANTI}, '-', CAST(doc_id % 9 + 1 AS STRING), '-1',
  CASE WHEN doc_id % 7 = 0 THEN concat(' tRNA-Gly-', substr(s, 5, 3), '-3-1') ELSE '' END) END"""
#: Anticodon counts as users write them: padded, lower case, RNA letters, of wrong length, repeated.
RAW_ANTICODON = f"CASE WHEN doc_id % 11 = 0 THEN concat(' ', {_ANTI}, ' ') WHEN doc_id % 13 = 0 THEN substr(s, 1, 4) WHEN doc_id % 17 = 0 THEN 'NNN' ELSE {_ANTI} END"


def trna_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).selectExpr(f"{TRNA_LINE} AS line")


def trna_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).selectExpr(f"{RAW_ANTICODON} AS anticodon", "CAST(doc_id % 13 + 1 AS INT) AS gene_copy_number")


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, feature_idx, feature, importance, signed_coef by features; ties, zeros and a model of zeros among them."""
    names = F.array(*[F.lit(n) for n in FEATURES])
    line = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_linenumber % 3 WHEN 0 THEN 'Lasso' WHEN 1 THEN 'RandomForest' ELSE 'SVR' END AS model", "CAST(l_partkey % 326 AS INT) AS feature_idx", "CAST(l_quantity AS BIGINT) - 25 AS q"
    )
    sums = line.groupBy("model", "feature_idx").agg((F.sum("q") / 100).alias("v"))
    value = F.when(F.col("model") == "SVR", 0.0).otherwise(F.abs("v"))
    return sums.select("model", "feature_idx", F.get(names, F.col("feature_idx")).alias("feature"), value.alias("importance"), F.when(F.col("model") == "Lasso", F.col("v")).alias("signed_coef"))


_DUCK_LETTERS = f"SELECT doc_id, regexp_replace(translate(text, '{LETTERS}', '{MAPPED}'), '[^ACGT]', '', 'g') AS s FROM documents"

#: Common table expressions for DuckDB; `t` has the regions.
DUCK_TRANSCRIPTS = f"""
l0 AS (SELECT doc_id, s, CAST(length(s) AS INT) AS len FROM ({_DUCK_LETTERS})),
transcripts AS (SELECT doc_id AS gene_id,
  CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN lower(s) WHEN doc_id % 3 = 2 THEN replace(s, 'T', 'U') ELSE s END AS tx_sequence,
  CASE WHEN doc_id % 89 = 0 THEN NULL ELSE CAST((len * 15 - (len * 15) % 100) / 100 AS INT) END AS utr5_size,
  CASE WHEN doc_id % 79 = 0 THEN NULL ELSE CAST((len - len % 6) / 6 AS INT) * 3 END AS cds_size,
  CAST(doc_id % 10 AS INT) AS fold, CASE WHEN doc_id % 83 = 0 THEN NULL ELSE ln(1 + len) / 10 + (doc_id % 17) / 17.0E0 END AS te FROM l0)"""
DUCK_REGIONS = (
    DUCK_TRANSCRIPTS
    + """,
n0 AS (SELECT *, replace(upper(tx_sequence), 'U', 'T') AS q, coalesce(utr5_size, 0) AS u, coalesce(cds_size, 0) AS c FROM transcripts WHERE tx_sequence IS NOT NULL),
t AS (SELECT gene_id, fold, te, q[1:u] AS utr5, q[u + 1:u + c] AS cds, q[u + c + 1:] AS utr3, q AS tx FROM n0)"""
)
DUCK_CDS = f"""
b0 AS (SELECT doc_id, array_to_string(list_filter(regexp_extract_all(s, '...'), lambda c: c NOT IN ('TAA', 'TAG', 'TGA')), '') AS body FROM ({_DUCK_LETTERS})),
r AS (SELECT doc_id AS rec_id, 'lcl|rec' || doc_id || ' [gene=' || CASE WHEN doc_id % 5 = 0 THEN 'RPL' || (doc_id % 40) WHEN doc_id % 5 = 1 THEN 'Rps' || (doc_id % 30) WHEN doc_id % 5 = 2 THEN 'RPLX' ELSE 'GENE' || doc_id END || '] [protein=p]' AS header,
  CASE WHEN doc_id % 11 = 0 THEN 'CTG' || body || 'TAA' WHEN doc_id % 13 = 0 THEN 'ATG' || body || 'TAGTAA' WHEN doc_id % 17 = 0 THEN 'ATG' || body || 'NNNTGA'
       WHEN doc_id % 19 = 0 THEN 'ATG' || body || 'A' WHEN doc_id % 23 = 0 THEN 'ATG' || body ELSE 'ATG' || body || 'TGA' END AS seq FROM b0)"""
DUCK_PREDICTIONS = """
p AS (SELECT 'base' AS model, CAST(l_orderkey % 10 AS INT) AS fold, l_orderkey * 10 + l_linenumber AS id, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) * 1500 AS y_hat FROM lineitem
  UNION ALL SELECT * FROM (VALUES ('odd', 0, 1, 1.5, 2.0), ('odd', 3, 2, 2.0, 1.0), ('odd', 3, 3, 2.0, 3.0), ('odd', 7, 4, 1.0, 5.0), ('odd', 7, 5, 4.0, 5.0), ('odd', 9, 6, 1.0, 1.0), ('odd', 9, 7, 1.0, 1.0)))"""
DUCK_HEADERS = f"h AS (SELECT {TRNA_LINE} AS line FROM ({_DUCK_LETTERS}))"
DUCK_COUNTS = f"a0 AS (SELECT {RAW_ANTICODON} AS anticodon, CAST(doc_id % 13 + 1 AS INT) AS gene_copy_number FROM ({_DUCK_LETTERS}))"
DUCK_IMPORTANCES = f"""i AS (SELECT model, feature_idx, {list(FEATURES)}[feature_idx + 1] AS feature, CASE WHEN model = 'SVR' THEN 0.0 ELSE abs(v) END AS importance, CASE WHEN model = 'Lasso' THEN v END AS signed_coef
  FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'Lasso' WHEN 1 THEN 'RandomForest' ELSE 'SVR' END AS model, CAST(l_partkey % 326 AS INT) AS feature_idx, sum(CAST(l_quantity AS BIGINT) - 25)::DOUBLE / 100 AS v FROM lineitem GROUP BY 1, 2))"""
