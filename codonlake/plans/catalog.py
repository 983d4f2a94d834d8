"""All registered queries of the sequence engine and the SQL that each is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions import features, metrics, sequence as S
from codonlake.functions.codons import CAI, CODONS, AMINO_OF, SENSE, STOPS, TAI
from codonlake.operators import ablation, embedding, ranking, weights
from codonlake.plans import fixtures as X
from codonlake.sources import readers, store, workbook
from codonlake.sources.store import shared_root
from codonlake.sources.vectors import VectorCache

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_DIM = ", ".join(f"({i}, '{c}', '{AMINO_OF[c]}')" for i, c in enumerate(CODONS))
DUCK_DIM = f"dim(ord, codon, aa) AS (VALUES {_DIM})"
DUCK_WEIGHTS = "w(codon, cai_h, cai_m, tai_h, tai_m) AS (VALUES " + ", ".join(
    f"('{c}', {CAI['human'][c]}::DOUBLE, {CAI['mouse'][c]}::DOUBLE, {TAI['human'].get(c, 'NULL')}::DOUBLE, {TAI['mouse'].get(c, 'NULL')}::DOUBLE)" for c in SENSE
) + ")"
_STOPS = ", ".join(f"'{c}'" for c in STOPS)


def _hits(seq: str, piece: str) -> str:
    return f"len(regexp_extract_all({seq}, '{piece}'))"


def _kmer_sql(k: int, places: int = 9) -> str:
    return ", ".join(f"round(CASE WHEN length({r}) >= {k} THEN {_hits(r, m)} / (length({r}) - {k - 1}.0) END, {places}) AS {r}_{m}" for r in S.REGIONS for m in S.kmers(k))


_LENGTH_SQL = ", ".join(f"round(ln(1 + length({r})), 9) AS log_{r}" for r in (*S.REGIONS, "tx"))
_GC_SQL = ", ".join(f"round(len(regexp_extract_all({r}, '[GC]')) / nullif(length({r}), 0), 9) AS gc_{n}" for n, r in (("utr5", "utr5"), ("cds", "cds"), ("utr3", "utr3"), ("full", "tx")))
_KOZAK_SQL = "round(CASE WHEN length(utr5) >= 6 AND length(cds) >= 4 THEN (" + " + ".join(f"CAST(substr(utr5[-6:] || cds[:4], {p}, 1) IN ({b}) AS INT)" for p, b in ((1, "'G'"), (2, "'C'"), (3, "'C'"), (4, "'A', 'G'"), (5, "'C'"), (6, "'C'"), (10, "'G'"))) + ") / 7.0 END, 9)"
_CODON_CTE = f"""
k0 AS (SELECT gene_id, unnest(regexp_extract_all(cds, '...')) AS codon FROM t),
{DUCK_WEIGHTS},
k1 AS (SELECT gene_id, k0.codon, count(*) AS n FROM k0 JOIN w USING (codon) GROUP BY gene_id, k0.codon),
k2 AS (SELECT gene_id, sum(n) AS total FROM k1 GROUP BY gene_id),
ca AS (SELECT gene_id, exp(sum(n * ln(cai_h)) / sum(n)) AS cai FROM k1 JOIN w USING (codon) GROUP BY gene_id),
ta AS (SELECT gene_id, exp(sum(n * ln(tai_h)) / sum(n)) AS tai FROM k1 JOIN w USING (codon) WHERE tai_h IS NOT NULL GROUP BY gene_id)"""
_USAGE_SQL = ", ".join(f"round(CASE WHEN k2.total > 0 THEN coalesce(max(n) FILTER (k1.codon = '{c}'), 0) / any_value(k2.total) END, 9) AS codon_{c}" for c in SENSE)
_T = f"WITH {X.DUCK_REGIONS}"
_TX = f"WITH {X.DUCK_TRANSCRIPTS}"


def _group_query(groups: list[str]):
    return lambda spark, sf: rounded(features.matrix(X.transcripts(spark, sf), groups=groups), 9)


# ---- sources and rows
register("q_scan_transcripts", f"{_TX} SELECT gene_id, tx_sequence, utr5_size, cds_size, fold, round(te, 6) AS te FROM transcripts")(lambda spark, sf: rounded(X.transcripts(spark, sf)))
register("q_dropna", f"{_TX} SELECT gene_id, fold, round(te, 6) AS te FROM transcripts WHERE te IS NOT NULL AND tx_sequence IS NOT NULL")(lambda spark, sf: rounded(ablation.usable(X.transcripts(spark, sf)).select("gene_id", "fold", "te")))
register("q_head_n", f"{_TX} SELECT gene_id, fold FROM transcripts WHERE te IS NOT NULL AND tx_sequence IS NOT NULL ORDER BY gene_id LIMIT 20")(lambda spark, sf: ablation.usable(X.transcripts(spark, sf), most=20).select("gene_id", "fold"))
register("q_fold_distribution", f"{_TX} SELECT fold, count(*) AS n FROM transcripts WHERE te IS NOT NULL AND tx_sequence IS NOT NULL GROUP BY fold")(lambda spark, sf: ablation.usable(X.transcripts(spark, sf)).groupBy("fold").agg(F.count("*").alias("n")))
def _splits(spark: SparkSession, sf: str) -> DataFrame:
    from codonlake.operators.validation import split_sizes

    return split_sizes(ablation.usable(X.transcripts(spark, sf)))


QUERIES["q_cv_splits"] = _splits
ORACLES["q_cv_splits"] = f"{_TX}, u AS (SELECT * FROM transcripts WHERE te IS NOT NULL AND tx_sequence IS NOT NULL), f AS (SELECT DISTINCT fold FROM u) SELECT f.fold, count(*) FILTER (u.fold = f.fold) AS n_test, count(*) FILTER (u.fold <> f.fold) AS n_train FROM f, u GROUP BY f.fold"


@register("q_feature_cache_roundtrip", f"{_T} SELECT gene_id, {_GC_SQL} FROM t")
def _cache(spark, sf):
    return rounded(store.feature_cache(X.transcripts(spark, sf), groups=["gc"], source=X.source(spark, sf)), 9)


@register("q_workbook_scan", f"{_TX} SELECT gene_id, tx_sequence, utr5_size, cds_size, fold, round(te, 6) AS te FROM transcripts")
def _workbook(spark, sf):
    """Transcripts as workbooks, read again with the types that they show."""
    path = f"{shared_root(spark)}/workbook-{abs(hash(sf)) % 10**9}"
    workbook.register(spark)
    X.transcripts(spark, sf).write.format("workbook").mode("overwrite").save(path)
    read = spark.read.format("workbook").load(path)
    return rounded(read.select(*[F.col(c).cast("int") if c in ("utr5_size", "cds_size", "fold") else F.col(c) for c in read.columns]))


_CHECKED_SQL = f"""{X.DUCK_CDS}, q AS (SELECT rec_id, seq, nullif(regexp_extract(header, '\\[gene=([^\\]]+)\\]', 1), '') AS gene, regexp_extract_all(seq, '...') AS cs FROM r),
v AS (SELECT *, length(seq) >= 6 AND length(seq) % 3 = 0 AND starts_with(seq, 'ATG') AND regexp_full_match(seq, '[ACGT]*') AND cs[-1] IN ({_STOPS}) AND NOT list_has_any(cs[:-2], [{_STOPS}]) AS valid FROM q),
c AS (SELECT *, valid AND coalesce(regexp_matches(gene, '(?i)^RP[LS][0-9]'), false) AS reference FROM v)"""
_RSCU_SQL = f"""WITH {_CHECKED_SQL}, {DUCK_DIM}, n AS (SELECT codon, count(*) AS n FROM (SELECT unnest(cs[:-2]) AS codon FROM c WHERE reference) GROUP BY codon),
m AS (SELECT dim.codon, aa, coalesce(n, 0) AS count FROM dim LEFT JOIN n USING (codon) WHERE aa <> '*'),
f AS (SELECT aa, avg(count) AS mean FROM m GROUP BY aa), u AS (SELECT codon, aa, count, coalesce(count / nullif(mean, 0), 0) AS rscu FROM m JOIN f USING (aa))
SELECT codon, aa AS amino_acid, count, round(rscu, 4) AS rscu, round(coalesce(rscu / nullif(max(rscu) OVER (PARTITION BY aa), 0), 0), 4) AS cai_weight FROM u"""

@register("q_codon_weights", f"""WITH {X.DUCK_CDS}, {DUCK_WEIGHTS}, n AS (SELECT codon, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq, '...')) AS codon FROM r) GROUP BY codon)
SELECT codon, cai_h AS cai_weight_human, cai_m AS cai_weight_mouse, tai_h AS tai_weight_human, tai_m AS tai_weight_mouse, coalesce(n, 0) AS n FROM w LEFT JOIN n USING (codon)""")
def _weights(spark, sf):
    """The built-in tables as combined CSV files, read again as a user's own, with how often coding sequences hold each codon."""
    out = X.cds_records(spark, sf).select(F.explode(S.codons(F.col("seq"))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    for kind, table in (("cai", CAI), ("tai", TAI)):
        names = [f"{kind}_weight_{s}" for s in ("human", "mouse")]
        rows = spark.createDataFrame([(c, AMINO_OF[c], table["human"].get(c), table["mouse"].get(c)) for c in SENSE], f"codon string, amino_acid string, {names[0]} double, {names[1]} double")
        path = store.write_csv(rows, f"{store.shared_root(spark)}/weights-{kind}.csv", order=["codon"])
        out = out.join(readers.table(spark, path, readers.CAI_TABLES if kind == "cai" else readers.TAI_TABLES).select("codon", *names), "codon", "right")
    return out.select("codon", *[f"{k}_weight_{s}" for k in ("cai", "tai") for s in ("human", "mouse")], F.coalesce("n", F.lit(0)).alias("n"))


@register("q_weight_csv", f"SELECT codon, amino_acid, cai_weight FROM ({_RSCU_SQL})")
def _weight_csv(spark, sf):
    """CAI weights of coding sequences as a report, one file, and read again."""
    path = store.write_csv(weights.cai_weights(X.cds_records(spark, sf)).select("codon", "amino_acid", "cai_weight"), f"{shared_root(spark)}/cai-{uuid.uuid4().hex}.csv", order=["codon"])
    return readers.table(spark, path, readers.CAI_SPECIES)


# ---- scalar operators
register("q_normalise", f"{_TX} SELECT gene_id, replace(upper(tx_sequence), 'U', 'T') AS seq FROM transcripts")(lambda spark, sf: X.transcripts(spark, sf).select("gene_id", S.normalised(F.col("tx_sequence")).alias("seq")))
register("q_regions", f"{_T} SELECT gene_id, length(utr5) AS n_utr5, length(cds) AS n_cds, length(utr3) AS n_utr3, md5(utr5 || '|' || cds || '|' || utr3) AS digest FROM t")(
    lambda spark, sf: features.with_regions(X.transcripts(spark, sf)).select("gene_id", *[F.length(r).cast("long").alias(f"n_{r}") for r in S.REGIONS], F.md5(F.concat_ws("|", *S.REGIONS).cast("binary")).alias("digest"))
)
register("q_start_window", f"{_T} SELECT gene_id, right(utr5, 30) || left(cds, 30) AS win FROM t")(lambda spark, sf: features.with_regions(X.transcripts(spark, sf)).select("gene_id", S.start_window(F.col("utr5"), F.col("cds")).alias("win")))
register("q_length", f"{_T} SELECT gene_id, {_LENGTH_SQL} FROM t")(_group_query(["length"]))
register("q_gc", f"{_T} SELECT gene_id, {_GC_SQL} FROM t")(_group_query(["gc"]))
register("q_mono", f"{_T} SELECT gene_id, {_kmer_sql(1)} FROM t")(_group_query(["mono"]))
register("q_di", f"{_T} SELECT gene_id, {_kmer_sql(2)} FROM t")(_group_query(["di"]))
register("q_kmer3", f"{_T} SELECT gene_id, {_kmer_sql(3)} FROM t")(_group_query(["kmer3"]))
register("q_uaug", f"{_T} SELECT gene_id, CAST({_hits('utr5', 'ATG')} AS DOUBLE) AS \"uAUG_count\" FROM t")(_group_query(["uaug"]))
register("q_kozak", f"{_T} SELECT gene_id, {_KOZAK_SQL} AS kozak_score FROM t")(_group_query(["kozak"]))
register("q_codon_usage", f"{_T}, {_CODON_CTE} SELECT t.gene_id, {_USAGE_SQL} FROM t LEFT JOIN k1 USING (gene_id) LEFT JOIN k2 USING (gene_id) GROUP BY t.gene_id, k2.total")(_group_query(["codon"]))
register("q_cai", f"{_T}, {_CODON_CTE} SELECT gene_id, round(cai, 6) AS cai FROM t LEFT JOIN ca USING (gene_id)")(lambda spark, sf: rounded(features.matrix(X.transcripts(spark, sf), groups=["cai"])))
register("q_tai", f"{_T}, {_CODON_CTE} SELECT gene_id, round(tai, 6) AS tai FROM t LEFT JOIN ta USING (gene_id)")(lambda spark, sf: rounded(features.matrix(X.transcripts(spark, sf), groups=["tai"])))
register("q_mfe")(lambda spark, sf: features.matrix(X.transcripts(spark, sf), groups=["mfe"]))
_ALL_SQL = f"""{_T}, {_CODON_CTE}, cu AS (SELECT t.gene_id, {_USAGE_SQL} FROM t LEFT JOIN k1 USING (gene_id) LEFT JOIN k2 USING (gene_id) GROUP BY t.gene_id, k2.total)
SELECT t.gene_id, t.fold, {_LENGTH_SQL}, {_GC_SQL}, {_kmer_sql(1)}, {_kmer_sql(2)}, {_kmer_sql(3)}, cu.* EXCLUDE (gene_id), CAST({_hits("utr5", "ATG")} AS DOUBLE) AS "uAUG_count", {_KOZAK_SQL} AS kozak_score, round(cai, 6) AS cai, round(tai, 6) AS tai
FROM t LEFT JOIN cu USING (gene_id) LEFT JOIN ca USING (gene_id) LEFT JOIN ta USING (gene_id)"""


def _matrix(groups: list[str] | None):
    """Frequencies at 9 places, where ratios of counts do not tie; the weighted means, sums of logarithms, at 6."""
    def run(spark, sf):
        rows = features.matrix(X.transcripts(spark, sf), groups=groups, keep=("gene_id", "fold"))
        return rows.select(*[F.round(c, 6 if c in ("cai", "tai") else 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])

    return run


register("q_feature_matrix")(_matrix(None))
#: The columns that SQL can express: all but mfe.
register("q_feature_matrix_sql", _ALL_SQL)(_matrix([g for g in features.GROUPS if g != "mfe"]))
register("q_feature_subset", f"{_T} SELECT gene_id, {_GC_SQL}, CAST({_hits('utr5', 'ATG')} AS DOUBLE) AS \"uAUG_count\" FROM t")(_group_query(["uaug", "gc"]))
register("q_impute0", f"{_T} SELECT gene_id, coalesce({_KOZAK_SQL}, 0) AS kozak_score, " + ", ".join(f"coalesce(round(len(regexp_extract_all({r}, '[GC]')) / nullif(length({r}), 0), 9), 0) AS gc_{n}" for n, r in (("utr5", "utr5"), ("cds", "cds"), ("utr3", "utr3"), ("full", "tx"))) + " FROM t")(
    lambda spark, sf: rounded(ablation.imputed(features.matrix(X.transcripts(spark, sf), groups=["gc", "kozak"]), ["kozak_score", "gc_utr5", "gc_cds", "gc_utr3", "gc_full"]), 9)
)
register("q_revcomp", f"{_TX} SELECT gene_id, reverse(translate(replace(upper(tx_sequence), 'U', 'T'), 'ACGT', 'TGCA')) AS revcomp FROM transcripts")(
    lambda spark, sf: X.transcripts(spark, sf).select("gene_id", S.reverse_complement(S.normalised(F.col("tx_sequence"))).alias("revcomp"))
)


@register("q_codon_enum", f"""WITH {X.DUCK_CDS}, b(i, x) AS (VALUES (0, 'T'), (1, 'C'), (2, 'A'), (3, 'G')), e AS (SELECT a.i * 16 + b.i * 4 + c.i AS ord, a.x || b.x || c.x AS codon FROM b a, b b, b c),
n AS (SELECT codon, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq, '...')) AS codon FROM r) GROUP BY codon) SELECT ord, codon, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (codon)""")
def _enumerated(spark, sf):
    """All 64 codons in order, with how often coding sequences hold each."""
    counts = X.cds_records(spark, sf).select(F.explode(S.codons(F.col("seq"))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    return weights.codon_dimension(spark).join(counts, "codon", "left").select("ord", "codon", F.coalesce("n", F.lit(0)).alias("n"))


register("q_gene_tag", f"WITH {X.DUCK_CDS} SELECT rec_id, nullif(regexp_extract(header, '\\[gene=([^\\]]+)\\]', 1), '') AS gene FROM r")(lambda spark, sf: X.cds_records(spark, sf).select("rec_id", S.gene_tag(F.col("header")).alias("gene")))
register("q_seq_hash", f"{_TX} SELECT gene_id, sha1('mean|1022|' || tx_sequence) AS rnafm_key, sha1('model|mean|1000|' || tx_sequence) AS nt_key FROM transcripts WHERE tx_sequence IS NOT NULL")(
    lambda spark, sf: X.transcripts(spark, sf).filter("tx_sequence IS NOT NULL").select("gene_id", embedding.rnafm_key(F.col("tx_sequence")).alias("rnafm_key"), embedding.nt_key(F.col("tx_sequence"), "model").alias("nt_key"))
)
register("q_rnafm_prep", f"{_TX} SELECT gene_id, left(replace(upper(tx_sequence), 'T', 'U'), 1022) AS seq FROM transcripts")(lambda spark, sf: X.transcripts(spark, sf).select("gene_id", embedding.rnafm_input(F.col("tx_sequence")).alias("seq")))
register("q_nt_prep", f"{_TX} SELECT gene_id, replace(upper(tx_sequence), 'U', 'T') AS seq FROM transcripts")(lambda spark, sf: X.transcripts(spark, sf).select("gene_id", embedding.nt_input(F.col("tx_sequence")).alias("seq")))

# ---- dictionary and ablations
#: Groups whose columns are counted, long: a row for each column of the stored matrix, with how many genes have a value.
_COUNTED = ["length", "gc", "mono", "uaug", "kozak", "cai"]
_COUNTED_SQL = f"""{X.DUCK_REGIONS}, {_CODON_CTE}, wide AS (SELECT {_LENGTH_SQL}, {_GC_SQL}, {_kmer_sql(1)}, CAST({_hits("utr5", "ATG")} AS DOUBLE) AS "uAUG_count", {_KOZAK_SQL} AS kozak_score, cai, 1.0 AS mystery, 1.0 AS "utr5_AAAA"
  FROM t LEFT JOIN ca USING (gene_id)), n AS (SELECT name, count(value) AS n_values FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM wide) ON COLUMNS(*) INTO NAME name VALUE value) GROUP BY name)"""
_GROUP_SQL = """CASE WHEN name IN ('cai', 'tai') THEN name WHEN name = 'kozak_score' THEN 'kozak' WHEN name = 'mfe_start' THEN 'mfe' WHEN name = 'uAUG_count' THEN 'uaug'
  WHEN name LIKE 'log\\_%' ESCAPE '\\' THEN 'length' WHEN name LIKE 'gc\\_%' ESCAPE '\\' THEN 'gc' WHEN name LIKE 'codon\\_%' ESCAPE '\\' THEN 'codon'
  WHEN regexp_matches(name, '^(utr5|cds|utr3)_.$') THEN 'mono' WHEN regexp_matches(name, '^(utr5|cds|utr3)_..$') THEN 'di' WHEN regexp_matches(name, '^(utr5|cds|utr3)_...$') THEN 'kmer3' ELSE 'unknown' END"""
_REGION_SQL = """CASE WHEN name IN ('cai', 'tai') OR name LIKE 'codon\\_%' ESCAPE '\\' THEN 'cds' WHEN name IN ('kozak_score', 'mfe_start') THEN 'window' WHEN name IN ('log_tx', 'gc_full') THEN 'full' WHEN name = 'uAUG_count' THEN 'utr5'
  WHEN regexp_matches(name, '^(log|gc)_') THEN regexp_extract(name, '_(.*)$', 1) WHEN regexp_matches(name, '^(utr5|cds|utr3)_') THEN regexp_extract(name, '^([a-z0-9]+)_', 1) ELSE 'unknown' END"""


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    """(name, n_values) of the columns of a stored matrix, and of two that no group has."""
    rows = store.feature_cache(X.transcripts(spark, sf), groups=_COUNTED, source=X.source(spark, sf)).drop("gene_id").withColumns({"mystery": F.lit(1.0), "utr5_AAAA": F.lit(1.0)})
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    return counts.unpivot([], counts.columns, "name", "n_values")


@register("q_classify_columns", f"WITH {_COUNTED_SQL} SELECT name, n_values, {_GROUP_SQL} AS grp, {_REGION_SQL} AS region FROM n")
def _classify(spark, sf):
    group, region = features.classified(F.col("name"))
    return _counted(spark, sf).select("name", "n_values", group.alias("grp"), region.alias("region"))


_SPECS_SQL = "s(id, grps, regions) AS (VALUES " + ", ".join(f"('{i}', {list(s.groups)}, {'NULL' if s.regions is None else list(s.regions)})" for i, s in ablation.ABLATIONS.items()) + ")"


@register("q_ablation_columns", f"WITH {_COUNTED_SQL}, d AS (SELECT name, n_values, {_GROUP_SQL} AS grp, {_REGION_SQL} AS region FROM n), {_SPECS_SQL} SELECT id, name, n_values FROM s JOIN d ON list_contains(grps, grp) AND (regions IS NULL OR list_contains(regions, region))")
def _ablation(spark, sf):
    """The columns of a stored matrix that each ablation selects, with how many genes have a value."""
    picked = spark.createDataFrame([(i, n) for i, s in ablation.ABLATIONS.items() for n in ablation.columns(s)], "id string, name string")
    return _counted(spark, sf).join(picked, "name").select("id", "name", "n_values")


# ---- weight tables
register("q_cds_qc", f"WITH {_CHECKED_SQL} SELECT rec_id, valid FROM c")(lambda spark, sf: weights.checked(X.cds_records(spark, sf)).select("rec_id", "valid"))
register("q_reference_set", f"WITH {_CHECKED_SQL} SELECT rec_id, gene, length(seq) AS length_nt FROM c WHERE reference")(lambda spark, sf: weights.checked(X.cds_records(spark, sf)).filter("reference").select("rec_id", "gene", F.length("seq").cast("long").alias("length_nt")))
register("q_cds_counters", f"WITH {_CHECKED_SQL} SELECT count(*) AS n_total, count(*) FILTER (valid) AS n_valid, count(*) FILTER (reference) AS n_ref FROM c")(lambda spark, sf: weights.counters(weights.checked(X.cds_records(spark, sf))))
@register("q_codon_families", f"WITH {_CHECKED_SQL}, {DUCK_DIM}, n AS (SELECT codon, count(*) AS n FROM (SELECT unnest(cs[:-2]) AS codon FROM c WHERE reference) GROUP BY codon) SELECT aa, count(*) AS n_codons, string_agg(codon, ',' ORDER BY codon) AS codons, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM dim LEFT JOIN n USING (codon) WHERE aa <> '*' GROUP BY aa")
def _families(spark, sf):
    """Synonymous families, with how often the reference genes use each."""
    totals = weights.codon_totals(weights.checked(X.cds_records(spark, sf))).join(weights.codon_dimension(spark).select("codon", "aa"), "codon").groupBy("aa").agg(F.sum("count").alias("total"))
    return weights.families(spark).join(totals, "aa", "left").withColumn("total", F.coalesce("total", F.lit(0)))


register("q_codon_counts", f"WITH {_CHECKED_SQL} SELECT codon, count(*) AS count FROM (SELECT unnest(cs[:-2]) AS codon FROM c WHERE reference) GROUP BY codon")(lambda spark, sf: weights.codon_totals(weights.checked(X.cds_records(spark, sf))))
register("q_rscu", f"SELECT codon, amino_acid, count, rscu FROM ({_RSCU_SQL})")(lambda spark, sf: weights.cai_weights(X.cds_records(spark, sf)).drop("cai_weight"))
register("q_cai_weights", f"SELECT codon, amino_acid, cai_weight FROM ({_RSCU_SQL})")(lambda spark, sf: weights.cai_weights(X.cds_records(spark, sf)).select("codon", "amino_acid", "cai_weight"))
@register("q_anticodon_counts", f"WITH {X.DUCK_HEADERS} SELECT replace(upper(a), 'U', 'T') AS anticodon, count(*) AS gene_copy_number FROM (SELECT unnest(regexp_extract_all(line, '(?i)tRNA-[A-Za-z]{{3}}-([ACGTU]{{3}})', 1)) AS a FROM h WHERE starts_with(line, '>')) GROUP BY 1")
def _anticodons(spark, sf):
    """Lines of a tRNA file derived from documents, as a text file read again."""
    path = f"{shared_root(spark)}/trna-{abs(hash(sf)) % 10**9}"
    X.trna_lines(spark, sf).write.mode("overwrite").text(path)
    return weights.anticodons_of(readers.lines(spark, path))


_CLEAN_SQL = f"{X.DUCK_COUNTS}, a1 AS (SELECT replace(upper(trim(anticodon)), 'U', 'T') AS anticodon, sum(gene_copy_number)::BIGINT AS gene_copy_number FROM a0 WHERE regexp_full_match(replace(upper(trim(anticodon)), 'U', 'T'), '[ACGT]{{3}}') GROUP BY 1)"
register("q_anticodon_clean", f"WITH {_CLEAN_SQL} SELECT * FROM a1")(lambda spark, sf: weights.cleaned_anticodons(X.trna_counts(spark, sf)))
_TAI_SQL = f"""WITH {_CLEAN_SQL}, {DUCK_DIM}, o AS (SELECT codon, aa, codon[:2] AS box, codon[3] AS b, coalesce(gene_copy_number, 0)::DOUBLE AS t FROM dim LEFT JOIN a1 ON a1.anticodon = reverse(translate(codon, 'ACGT', 'TGCA'))),
x AS (SELECT codon, aa, CASE b WHEN 'T' THEN t + 0.59 * (SELECT p.t FROM o p WHERE p.box = o.box AND p.b = 'C') WHEN 'C' THEN t + 0.72 * (SELECT p.t FROM o p WHERE p.box = o.box AND p.b = 'T')
  WHEN 'A' THEN t + 0.0001 * (SELECT p.t FROM o p WHERE p.box = o.box AND p.b = 'T') ELSE t + 0.32 * (SELECT p.t FROM o p WHERE p.box = o.box AND p.b = 'A') END AS w FROM o),
y AS (SELECT codon, aa, w / (SELECT max(w) FROM x WHERE aa <> '*' AND codon <> 'ATG') AS rel FROM x WHERE aa <> '*' AND codon <> 'ATG')
SELECT codon, aa AS amino_acid, round(CASE WHEN rel > 0 THEN rel ELSE (SELECT exp(avg(ln(rel))) FROM y WHERE rel > 0) END, 4) AS tai_weight FROM y"""
register("q_tai_weights", _TAI_SQL)(lambda spark, sf: weights.tai_weights(weights.cleaned_anticodons(X.trna_counts(spark, sf))))


@register("q_merge_weights", f"WITH a AS ({_TAI_SQL}), {DUCK_WEIGHTS} SELECT codon, coalesce(a.tai_weight, 0) AS tai_weight_human, coalesce(w.tai_m, 0) AS tai_weight_mouse FROM a FULL JOIN (SELECT * FROM w WHERE tai_m IS NOT NULL AND codon NOT LIKE 'A%') w USING (codon)")
def _merge(spark, sf):
    human = weights.tai_weights(weights.cleaned_anticodons(X.trna_counts(spark, sf)))
    mouse = spark.createDataFrame([(c, v) for c, v in TAI["mouse"].items() if c[0] != "A"], "codon string, tai_weight double")
    return weights.merged({"human": human, "mouse": mouse}, "tai").drop("amino_acid")


# ---- metrics
_SCORE_SQL = """CASE WHEN n < 2 THEN NULL WHEN yy <= 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / yy END AS r2, mae, sqrt(sse / n) AS rmse,
  CASE WHEN n >= 2 AND yy > 0 AND pp > 0 THEN yp / (sqrt(yy) * sqrt(pp)) END AS pearson_r, CASE WHEN n >= 2 AND ryy > 0 AND rpp > 0 THEN ryp / (sqrt(ryy) * sqrt(rpp)) END AS spearman_r"""


def _scores_sql(keys: str, source: str) -> str:
    part = f"PARTITION BY {keys}"
    return f"""(SELECT {keys}, {_SCORE_SQL} FROM (SELECT {keys}, count(*) AS n, sum((y - y_hat) ** 2) AS sse, avg(abs(y - y_hat)) AS mae, var_pop(y) * count(*) AS yy, var_pop(y_hat) * count(*) AS pp, covar_pop(y, y_hat) * count(*) AS yp,
      var_pop(ry) * count(*) AS ryy, var_pop(rp) * count(*) AS rpp, covar_pop(ry, rp) * count(*) AS ryp
      FROM (SELECT *, rank() OVER ({part} ORDER BY y) + (count(*) OVER ({part}, y) - 1) / 2.0 AS ry, rank() OVER ({part} ORDER BY y_hat) + (count(*) OVER ({part}, y_hat) - 1) / 2.0 AS rp FROM {source}) GROUP BY {keys}))"""


_METRIC_LIST = ", ".join(f"round({c}, 6) AS {c}" for c in metrics.NAMES)
_FOLDED_SQL = f"WITH {X.DUCK_PREDICTIONS}, o AS (SELECT model, y, y_hat, dense_rank() OVER (PARTITION BY model ORDER BY fold) - 1 AS fold FROM p), e AS (SELECT * FROM {_scores_sql('model, fold', 'o')}), z AS (SELECT * FROM {_scores_sql('model', 'p')})"
register("q_metrics_fold", f"{_FOLDED_SQL} SELECT model, fold, {_METRIC_LIST} FROM e")(lambda spark, sf: rounded(metrics.scores(metrics.fold_ordinal(X.predictions(spark, sf), ["model"]), ["model", "fold"])))
register("q_metrics_oof", f"{_FOLDED_SQL} SELECT model, {_METRIC_LIST} FROM z")(lambda spark, sf: rounded(metrics.scores(X.predictions(spark, sf), ["model"])))
register("q_pearson", f"{_FOLDED_SQL} SELECT model, fold, round(pearson_r, 6) AS pearson_r FROM e")(lambda spark, sf: rounded(metrics.scores(metrics.fold_ordinal(X.predictions(spark, sf), ["model"]), ["model", "fold"]).select("model", "fold", "pearson_r")))
register("q_spearman", f"{_FOLDED_SQL} SELECT model, fold, round(spearman_r, 6) AS spearman_r FROM e")(lambda spark, sf: rounded(metrics.scores(metrics.fold_ordinal(X.predictions(spark, sf), ["model"]), ["model", "fold"]).select("model", "fold", "spearman_r")))
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in metrics.NAMES)
_STDS = ", ".join(f"round(stddev_pop({c}), 6) AS {c}" for c in metrics.NAMES)
register("q_metric_summary", f"{_FOLDED_SQL} SELECT model, CAST(fold AS VARCHAR) AS fold, {_METRIC_LIST} FROM e UNION ALL SELECT model, 'mean', {_MEANS} FROM e GROUP BY model UNION ALL SELECT model, 'std', {_STDS} FROM e GROUP BY model UNION ALL SELECT model, 'oof', {_METRIC_LIST} FROM z")(
    lambda spark, sf: rounded(metrics.summary(X.predictions(spark, sf), ["model"], strict=False))
)
register("q_r2_summary", f"{_FOLDED_SQL} SELECT model, CAST(fold AS VARCHAR) AS fold, round(r2, 6) AS r2 FROM e UNION ALL SELECT model, 'mean', CASE WHEN count(r2) = count(*) THEN round(avg(r2), 6) END FROM e GROUP BY model UNION ALL SELECT model, 'std', CASE WHEN count(r2) = count(*) THEN round(stddev_pop(r2), 6) END FROM e GROUP BY model UNION ALL SELECT model, 'oof', round(r2, 6) FROM z")(
    lambda spark, sf: rounded(metrics.summary(X.predictions(spark, sf), ["model"], strict=True))
)
def _scaled(spark, sf):
    from codonlake.operators.linear import scaled

    rows = features.with_regions(X.transcripts(spark, sf)).select("gene_id", F.length("utr5").cast("double").alias("a"), F.length("cds").cast("double").alias("b"), F.lit(7.0).alias("c"))
    return rounded(scaled(rows, ["a", "b", "c"]))


QUERIES["q_standard_scale"] = _scaled
ORACLES["q_standard_scale"] = f"{_T}, g AS (SELECT gene_id, length(utr5)::DOUBLE AS a, length(cds)::DOUBLE AS b FROM t) SELECT gene_id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS a, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS b, 0.0::DOUBLE AS c FROM g"

# ---- rankings
_RANK_SQL = f"WITH {X.DUCK_IMPORTANCES}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature_idx) AS rank FROM i)"
register("q_top_features", f"{_RANK_SQL} SELECT model, rank, feature, importance, signed_coef FROM k WHERE rank <= 50")(lambda spark, sf: ranking.top_features(X.importances(spark, sf)))
register("q_bar_data", f"{_RANK_SQL} SELECT model, rank, feature, importance, signed_coef, CASE WHEN signed_coef IS NULL THEN NULL WHEN signed_coef > 0 THEN 'positive' ELSE 'negative' END AS sign FROM k WHERE rank <= 30")(lambda spark, sf: ranking.bars(X.importances(spark, sf)))
register("q_heatmap", f"{_RANK_SQL}, c AS (SELECT * FROM k WHERE rank <= 25), g AS (SELECT f.feature, m.model, coalesce(c.importance, 0) AS v FROM (SELECT DISTINCT feature FROM c) f CROSS JOIN (SELECT DISTINCT model FROM i) m LEFT JOIN c ON c.feature = f.feature AND c.model = m.model) SELECT feature, model, round(v / nullif(max(v) OVER (PARTITION BY model), 0), 6) AS value FROM g")(
    lambda spark, sf: rounded(ranking.heatmap(X.importances(spark, sf)))
)

# ---- embeddings
def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "embeddings")


for _pool, _f in (("mean", "avg"), ("max", "max")):
    register(f"q_embed_pool_{_pool}", f"SELECT grp, pos, round({_f}(x::DOUBLE), 6) AS value FROM (SELECT vec_id % 10 AS grp, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY grp, pos")(
        lambda spark, sf, p=_pool: rounded(embedding.pooled_vectors(_emb(spark, sf).withColumn("grp", F.col("vec_id") % 10), ["grp"], p))
    )
register("q_embed_columns", "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS nt_{i}" for i in range(64)) + " FROM embeddings")(lambda spark, sf: embedding.unstacked(_emb(spark, sf).drop("label"), "nt", 64))


@register("q_embed_cache_lookup", "SELECT vec_id, sha1('k|' || vec_id) AS seq_hash FROM embeddings WHERE vec_id % 3 <> 0")
def _lookup(spark, sf):
    """The keys that a cache holding a third of them lacks."""
    rows = _emb(spark, sf).select("vec_id", S.content_key(F.col("vec_id").cast("string"), "k").alias("seq_hash"), "embedding")
    cache = VectorCache(spark, f"{shared_root(spark)}/vectors-{uuid.uuid4().hex}")
    cache.append(rows.filter("vec_id % 3 = 0").select("seq_hash", "embedding"), "third")
    return cache.missing(rows.select("vec_id", "seq_hash"))


@register("q_embed_cache_found", "SELECT vec_id, sha1('k|' || vec_id) AS seq_hash, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS size FROM embeddings WHERE vec_id % 3 = 0")
def _found(spark, sf):
    """The vectors that a cache filled by two batches holds, by key."""
    rows = _emb(spark, sf).select("vec_id", S.content_key(F.col("vec_id").cast("string"), "k").alias("seq_hash"), "embedding")
    cache = VectorCache(spark, f"{shared_root(spark)}/vectors-{uuid.uuid4().hex}")
    for batch, some in (("a", "vec_id % 6 = 0"), ("b", "vec_id % 3 = 0")):
        cache.append(rows.filter(some).select("seq_hash", "embedding"), batch)
    size = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 4)
    return cache.found(rows.select("vec_id", "seq_hash")).select("vec_id", "seq_hash", F.size("embedding").cast("long").alias("width"), size.alias("size"))


@register("q_combined_features", f"{_T} SELECT gene_id, {_GC_SQL}, embedding[1] AS nt_0, embedding[2] AS nt_1 FROM t JOIN embeddings ON vec_id = gene_id")
def _combined(spark, sf):
    ids = _emb(spark, sf).select(F.col("vec_id").alias("gene_id"), "embedding")
    rows = X.transcripts(spark, sf).join(ids.select("gene_id"), "gene_id", "left_semi").filter("tx_sequence IS NOT NULL")
    vectors = embedding.unstacked(ids, "nt", 2).join(rows.select("gene_id"), "gene_id", "left_semi")
    return rounded(embedding.combined(features.matrix(rows, groups=["gc"]), vectors), 9)


register("q_length_batches", f"{_TX}, s AS (SELECT gene_id, row_number() OVER (ORDER BY coalesce(length(tx_sequence), 0) DESC, gene_id) AS r FROM transcripts) SELECT gene_id, CAST((r - 1) // 8 AS BIGINT) AS batch FROM s")(
    lambda spark, sf: embedding.batches(X.transcripts(spark, sf).select("gene_id", F.col("tx_sequence").alias("seq"))).select("gene_id", "batch")
)


# ---- models: rows only, no SQL form
def _model_rows(spark: SparkSession, sf: str, spec: str = "A1") -> tuple[DataFrame, list[str]]:
    from codonlake.plans.pipeline import prepared

    return prepared(X.transcripts(spark, sf), spec, source=X.source(spark, sf))


def _oof(models: list[str], spec: str, scale: float):
    def run(spark, sf):
        from codonlake.operators.validation import out_of_fold

        return out_of_fold(*_model_rows(spark, sf, spec), models, scale)

    return run


for _name, _models, _spec, _scale in (
    ("q_lasso", ["Lasso"], "A5", 1.0), ("q_elasticnet", ["ElasticNet"], "A5", 1.0), ("q_random_forest", ["RandomForest"], "A1", 1.0), ("q_gbt_leafwise", ["LightGBM"], "A1", 1.0),
    ("q_gbt_depthwise", ["XGBoost"], "A1", 1.0), ("q_svr_rbf", ["SVR"], "A1", 1.0), ("q_linear_svr", ["LinearSVM"], "A1", 1.0), ("q_oof", ["Lasso", "LinearSVM"], "C1", 1.0),
):
    register(_name)(_oof(_models, _spec, _scale))


@register("q_importances")
def _importances(spark, sf):
    from codonlake.operators.validation import importances

    return importances(*_model_rows(spark, sf, "C1"), ["Lasso", "LinearSVM", "RandomForest"], 1.0)


@register("q_permutation_importance")
def _permutation(spark, sf):
    from codonlake.operators.validation import importances

    return importances(*_model_rows(spark, sf, "C1"), ["SVR"], 1.0)


_LINEAR_ROWS = f"{_T}, u AS (SELECT * FROM t WHERE te IS NOT NULL)"


def _optimality(model: str):
    def run(spark, sf):
        from codonlake.operators.validation import violations

        return violations(*_model_rows(spark, sf, "A5"), model).select("model", "fold", "feature", (F.col("violation") <= 1e-4).alias("optimal"))

    return run


#: Each fold's coefficients meet the optimality conditions of their penalty, computed from the rows themselves.
for _name, _model in (("q_lasso_optimality", "Lasso"), ("q_elasticnet_optimality", "ElasticNet")):
    _columns = ", ".join(f"('{c}')" for c in ablation.columns("A5"))
    register(_name, f"{_LINEAR_ROWS} SELECT '{_model}' AS model, fold, feature, true AS optimal FROM (SELECT DISTINCT fold FROM u), (VALUES {_columns}) AS v(feature)")(_optimality(_model))


@register("q_fasta_parse", f"WITH {X.DUCK_CDS} SELECT header, seq FROM r")
def _fasta(spark, sf):
    """Coding records as FASTA text and read again."""
    path = f"{shared_root(spark)}/fasta-{abs(hash(sf)) % 10**9}"
    X.cds_records(spark, sf).select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))).write.mode("overwrite").text(path)
    return readers.fasta(spark, path)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled and per-fold metrics of cross-validated Lasso on the columns of ablation A5."""
    from codonlake.plans.pipeline import evaluate

    return rounded(evaluate(X.transcripts(spark, sf_dir), "A5", ["Lasso"]))
