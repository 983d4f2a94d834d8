"""Mixing sources to target weights by weighted fair queueing; DataFrame operations only.

Every document, in an order shuffled by a hash, gets a virtual finish time: the cumulative words of its source up to and
with it, divided by its source's target. A source whose target exceeds its size is read again from the start, up to
`most_repeats` times, each reading's times following the last one's. All readings are then ordered by finish time, over
ranges of it, and cut where the total budget is reached.

Prefix sums never gather a source: rows are dealt into ranges of the hash (of about `range_rows` rows), the ranges are
summed, the sums are accumulated over (source, range), and the rest is a window inside a range. The global cut is found
the same way over ranges of the finish time, and only the one range that holds it is ordered row by row.

Defined results: null and empty texts have size 0 and are taken 0 words; a null source is a source, and the last one;
rows that repeat an id are rows of their own, ordered by text; with no words at all every target is 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonlake.llm.common import written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
RANGE_ROWS = 4096
FINISH_RANGES = 4096


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) of sized(source, size): shares of all words by weight, none above its bound.

    Water filling: sources ordered by bound / weight; those before the level get their bound, the others their weight's
    share of what is left. One row a source, so the windows are as small as the list of sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sums.withColumn("weight", weight).withColumn("bound", F.col("source_size") * float(most_repeats))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(whole)).withColumn("spent", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
    rows = rows.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("spent")) / F.col("weights")
    rows = rows.withColumn("level", level).withColumn("full", F.col("bound") <= level * F.col("weight"))
    rows = rows.withColumn("open", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))  # of the first source below its bound; later ones are lower
    return rows.select("source", "source_size", F.when(F.col("open").isNull() | F.col("full"), F.col("bound")).otherwise(F.least("bound", F.col("open") * F.col("weight"))).alias("target"))


def queued(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, range_rows: int = RANGE_ROWS, seed: int = 17) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, before): before is the source's words ahead of the row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    text_hash = F.xxhash64(text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), text_hash.cast("string")))  # null ids are dealt out by their texts
    own = F.md5(F.concat_ws("|", F.lit(str(seed)), name).cast("binary"))
    turn = F.conv(F.substring(own, 1, 15), 16, 10).cast("long")  # 60 bits of a hash
    rows = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash.alias("text_hash"), F.col(source_col).alias("source"), size.alias("size"), turn.alias("turn")), "sizes"
    )
    count = rows.count()
    bits = max(0, (max(1, -(-count // range_rows)) - 1).bit_length())
    rows = rows.withColumn("range", F.shiftright("turn", 60 - bits) if bits else F.lit(0).cast("long"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("held"))
    offsets = sums.withColumn("offset", F.sum("held").over(Window.partitionBy("source").orderBy("range")) - F.col("held")).drop("held")
    goals = targets(rows.select("source", "size"), weights, most_repeats)
    inside = Window.partitionBy("source", "range").orderBy("turn", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    ahead = rows.withColumn("ahead", F.sum("size").over(inside) - F.col("size"))
    out = ahead.alias("r").join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.range") == F.col("o.range")))
    out = out.select("r.doc_id", "r.text_hash", "r.source", "r.size", (F.col("offset") + F.col("ahead")).alias("before"))
    out = out.alias("q").join(goals.alias("g"), F.col("q.source").eqNullSafe(F.col("g.source")))
    return out.select("q.doc_id", "q.text_hash", "q.source", "q.size", "source_size", "target", "before")


def readings(rows: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row for each reading of a row that its source's bound allows: reading from 0, and its finish time."""
    times = F.array(*[(F.lit(e) * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("target") for e in range(most_repeats)])
    return rows.filter("size > 0 AND target > 0").select("*", F.posexplode(times).alias("reading", "finish"))


def last_finish(read: DataFrame, budget: int, ordered_rows: int = 50_000) -> float:
    """The largest finish time up to which all readings together hold at most `budget` words; equal times go together.

    FINISH_RANGES sums a pass; the range that holds the cut is cut into ranges again until `ordered_rows` are left.
    """
    inside, low, width, spent = read.select("size", "finish"), 0.0, 4.0, 0
    while True:
        at = F.floor((F.col("finish") - F.lit(low)) / F.lit(width / FINISH_RANGES))
        ranged = inside.withColumn("range", F.greatest(F.lit(0), F.least(at, F.lit(FINISH_RANGES - 1))).cast("int"))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("held"), F.count("*").alias("rows"))  # FINISH_RANGES rows at most
        run = sums.withColumn("upto", F.sum("held").over(Window.orderBy("range")) + F.lit(spent))
        cut = run.filter(F.col("upto") > budget).agg(F.min(F.struct("range", (F.col("upto") - F.col("held")).alias("spent"), "rows"))).first()[0]
        if cut is None:
            return float("inf")
        inside, spent = ranged.filter(F.col("range") == cut["range"]).drop("range"), cut["spent"]
        low, width = low + cut["range"] * width / FINISH_RANGES, width / FINISH_RANGES
        if cut["rows"] <= ordered_rows or width < 1e-12:
            break
    run = inside.groupBy("finish").agg(F.sum("size").alias("held")).withColumn("upto", F.sum("held").over(Window.orderBy("finish")) + F.lit(spent))
    best, least = run.agg(F.max(F.when(F.col("upto") <= budget, F.col("finish"))), F.min("finish")).first()
    return float(np.nextafter(least, 0.0)) if best is None else best


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, budget: int | None = None) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, before, taken): taken counts the words of all readings taken."""
    rows = written(queued(docs, id_col, text_col, source_col, weights, most_repeats), "queue")
    if budget is None:
        budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    last = last_finish(readings(rows, most_repeats), budget)
    taken = sum(
        (F.when((F.col("target") > 0) & ((F.lit(e) * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("target") <= F.lit(last)), F.col("size")).otherwise(F.lit(0)) for e in range(most_repeats)),
        F.lit(0),
    )
    return rows.withColumn("taken", taken.cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
  CAST(('0x' || substr(md5('17|' || CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS w FROM d GROUP BY source),
f(step, left_over, weights, level) AS (
  SELECT 0, CAST((SELECT sum(source_size) FROM s) AS DOUBLE), (SELECT sum(w) FROM s), (SELECT sum(source_size) / sum(w) FROM s)
  UNION ALL
  SELECT step + 1, l, w, l / w FROM (SELECT step, (SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(3.0 * source_size), 0) FROM s WHERE 3.0 * source_size <= level * s.w) AS l,
    (SELECT sum(s.w) FROM s WHERE 3.0 * source_size > level * s.w) AS w FROM f WHERE step < 60) WHERE w > 0),
t AS (SELECT source, source_size, CASE WHEN (SELECT arg_max(level, step) FROM f) IS NULL THEN 3.0 * source_size ELSE least(3.0 * source_size, (SELECT arg_max(level, step) FROM f) * w) END AS target FROM s),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CAST(e * source_size + upto AS DOUBLE) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND target > 0),
c AS (SELECT max(finish) AS last FROM (SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS upto FROM r GROUP BY finish) WHERE upto <= (SELECT sum(size) FROM d)),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r, c WHERE finish <= last GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k USING (doc_id)
"""
