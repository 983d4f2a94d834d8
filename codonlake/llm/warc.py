"""Resolution of not-modified revisit records: an as-of join by canonical URL to the latest earlier full response.

A revisit takes the body of the latest response of its canonical URL that is strictly earlier; it is accepted when the
validators agree, and the headers that a not-modified answer may renew (RENEWED) replace the response's. Validators: where
both sides have an entity tag, the tags decide, compared weakly (`W/` left out); where one side or both have none, the
modification date does, which must not be after the response's. Header names are lower-cased (A-Z) first.

The join is a running maximum over times, ids and validators; bodies and headers stay out of it and are joined once, by
the response that was found, for resolved revisits only. A URL may hold a third of all records, so records are dealt by
URL and time range (about RANGE_ROWS rows of all URLs each): the latest response inside a range is a window over (URL,
range), and that of the ranges before is a window over one row for each (URL, range). A response that many revisits name
is broadcast or split by `skew_lookup`.

Defined results: a null URL or time resolves to nothing; of responses at the same time the one with the largest id
counts, of those with equal ids the largest validators, then headers, then payload; of headers whose names differ in case alone
the largest value; a revisit never meets a response of
its own time; repeated records are records of their own; missing headers count as none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonlake.llm.common import LOWER, UPPER, skew_lookup, written

#: Fields that a 304 response may carry to renew a stored response.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
RANGE_ROWS = 20_000
#: Most time ranges, found in two steps of its square root; beyond RANGE_ROWS times this many rows the ranges grow.
MOST_RANGES = 4096


def canonical(url: Column) -> Column:
    """Host and path of a URL without scheme, www., default port, fragment, tracking parameters, index.html and last slash."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.translate(F.regexp_extract(bare, r"^([A-Za-z]+://[^/?]*)", 1), UPPER, LOWER)
    rest = F.regexp_replace(bare, r"^[A-Za-z]+://[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"^[a-z]+://", ""), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(rest, r"\?.*$", "")
    asked = F.when(F.instr(rest, "?") > 0, F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    short = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", ""), r"/+$", "")
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, short, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def range_of(at: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are not above `at`: first among every 64th, then between two of those."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[::step]
    fine = F.array(*[F.array(*[F.lit(c) for c in cuts[i + 1 : i + step]] or [F.lit(None).cast("long")]) for i in range(0, len(cuts), step)])
    upto = F.size(F.filter(F.array(*[F.lit(c) for c in coarse]), lambda c: c <= at))
    return F.when(upto > 0, (upto - 1) * step + 1 + F.size(F.filter(F.get(fine, upto - 1), lambda c: c <= at))).otherwise(F.lit(0))


def latest_before(records: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """records (url_key, at, id, answer) with `found`: the largest (at, id, answer) of an earlier time whose answer is not null."""
    ranges = min(MOST_RANGES, -(-records.count() // range_rows))
    cuts = records.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else None
    placed = F.col("at").isNotNull() & F.col("url_key").isNotNull()
    rows = records.filter(placed).withColumn("range", range_of(F.col("at"), sorted(set(cuts or ()))))
    nowhere = records.filter(~placed)  # they find nothing, and would all meet under one key
    entry = F.when(F.col("answer").isNotNull(), F.struct("at", "id", "answer"))
    inside = Window.partitionBy("url_key", "range").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max(entry).over(inside))
    last = rows.groupBy("url_key", "range").agg(F.max(entry).alias("entry"))
    ahead = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("url_key").alias("far_key"), F.col("range").alias("far_range"), F.max("entry").over(ahead).alias("far"))
    out = rows.join(carried, (F.col("url_key") == F.col("far_key")) & (F.col("range") == F.col("far_range")), "left")
    out = out.withColumn("found", F.coalesce("near", "far")).drop("near", "far", "range", "far_key", "far_range")
    return out.unionByName(nowhere.withColumn("found", F.lit(None).cast(out.schema["found"].dataType)))


def lower_names(headers: Column) -> Column:
    """Headers by lower-cased name; of those that then share a name the largest value."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.translate(e["key"], UPPER, LOWER).alias("key"), e["value"].alias("value"))))
    own = F.transform(F.array(entries), lambda s: F.filter(s, lambda e, i: ~F.coalesce(F.get(s, i + 1)["key"] == e["key"], F.lit(False))))
    return F.map_from_entries(F.element_at(own, 1))


def strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def answer_key(url_key: Column, at: Column, id_: Column, etag: Column, modified: Column) -> Column:
    return F.md5(F.to_json(F.struct(url_key.alias("u"), at.alias("a"), id_.alias("i"), etag.alias("e"), modified.alias("m"))).cast("binary"))


def resolve(records: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """records (id, url, at, kind response or revisit, etag, modified, headers map, payload) with url_key, target_id,
    status (response, resolved, validator_mismatch, no_earlier_response), merged headers and body.
    """
    kept = records.select("id", "url", "at", "kind", "etag", "modified", lower_names(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers"), "payload", canonical(F.col("url")).alias("url_key"))
    kept = written(kept.drop("url"), "captures")
    answers = (F.col("kind") == "response") & F.col("at").isNotNull() & F.col("url_key").isNotNull()
    slim = kept.withColumn("answer", F.when(answers, F.struct("etag", "modified")))
    rows = latest_before(slim, range_rows)
    a = F.col("found.answer")
    tags = F.col("etag").isNotNull() & a["etag"].isNotNull()
    agree = F.when(tags, strong(F.col("etag")) == strong(a["etag"])).otherwise(F.coalesce(F.col("modified") <= a["modified"], F.lit(False)))
    revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    rows = rows.withColumn("status", F.when(~revisit, "response").when(F.col("found").isNull(), "no_earlier_response").when(agree, "resolved").otherwise("validator_mismatch"))
    resolved = F.col("status") == "resolved"
    rows = rows.withColumn("wanted", F.when(resolved, answer_key(F.col("url_key"), F.col("found.at"), F.col("found.id"), a["etag"], a["modified"])))
    target = F.when(revisit, F.when(resolved, F.col("found.id"))).otherwise(F.col("id"))
    rows = written(rows.select("id", "url_key", "at", "kind", "headers", "payload", "status", "wanted", target.alias("target_id")), "matched")
    # bodies of the responses that revisits resolve to; maps cannot be compared, entries sorted by name can
    asked = rows.filter("wanted IS NOT NULL").groupBy("wanted").agg(F.count("*").alias("revisits"))
    bodies = kept.filter(answers).withColumn("wanted", answer_key(*(F.col(c) for c in ("url_key", "at", "id", "etag", "modified"))))
    best = F.max(F.struct(F.array_sort(F.map_entries("headers")).alias("headers"), "payload"))
    bodies = bodies.join(asked, "wanted").groupBy("wanted").agg(best.alias("stored"), F.first("revisits").alias("revisits"))
    out = skew_lookup(rows, bodies, "wanted", "revisits", rows.count(), "id")
    renewing = F.map_filter("headers", lambda k, v: k.isin(*RENEWED))
    stored = F.filter(F.col("stored.headers"), lambda e: ~F.map_contains_key(renewing, e["key"]))
    merged = F.when(resolved, F.map_concat(F.map_from_entries(stored), renewing)).otherwise(F.col("headers"))
    body = F.when(revisit, F.when(resolved, F.col("stored.payload"))).otherwise(F.col("payload"))
    return out.select("id", "url_key", "at", "kind", "target_id", "status", merged.alias("merged"), body.alias("body"))


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records of pages, which hold none themselves: of each page a response; a not-modified answer before it
    (every third page), after it under a tracked URL, and later under another host name and scheme; and between the last
    two, for every second page, a changed response. Every fifth page has no entity tags, only modification dates.
    """
    p, url = F.col("page_id"), F.col("url")
    tag = lambda n: F.when(p % 5 != 0, F.concat(F.substring(F.md5(canonical(url).cast("binary")), 1, 8), F.lit(f"-{n}")))
    html = F.coalesce("html", F.lit(""))
    tracked = F.concat(url, F.when(F.instr(url, "?") > 0, "&").otherwise("?"), F.lit("utm_source=feed"))
    moved = F.regexp_replace(url, "^https?://", "http://www.")
    none = F.lit(None).cast("string")

    def slot(n: int, kind: str, after: int, where: Column, etag: Column, modified: Column, payload: Column, when: Column | None = None) -> Column:
        one = F.struct(F.lit(n).alias("slot"), F.lit(kind).alias("kind"), (p * 10 + after).alias("at"), where.alias("url"), etag.alias("etag"), modified.alias("modified"), payload.alias("payload"))
        return one if when is None else F.when(when, one)

    slots = F.array(
        slot(0, "revisit", -1, url, tag(1), p, none, p % 3 == 0),
        slot(1, "response", 0, url, tag(1), p, F.md5(html.cast("binary"))),
        slot(2, "revisit", 3, tracked, tag(1), p, none),
        slot(3, "response", 5, url, tag(2), p + 1, F.md5(F.concat(F.lit("2|"), html).cast("binary")), p % 2 == 0),
        slot(4, "revisit", 7, moved, tag(1), F.when(p % 10 == 0, p + 2).otherwise(p), none),
    )
    rows = pages.select("page_id", F.explode(slots).alias("s")).filter("s IS NOT NULL").select("page_id", "s.*")
    common = [F.lit("date"), F.concat(F.lit("t"), F.col("at").cast("string"))]
    full = F.create_map(*common, F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("no-cache"))
    short = F.create_map(*common, F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-type"), F.lit("text/plain"))
    return rows.select((p * 5 + F.col("slot")).alias("id"), "url", "at", "kind", "etag", "modified", F.when(F.col("kind") == "revisit", short).otherwise(full).alias("headers"), "payload")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    out = resolve(records_of(pages))
    return out.select(F.floor(F.col("id") / 5).alias("page_id"), F.col("id").alias("record_id"), "url_key", "kind", "target_id", "status", lines.alias("headers"), "body")


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
v AS (
  SELECT page_id, 0 AS slot, 'revisit' AS kind, -1 AS after, url, 1 AS version, page_id AS modified, NULL AS payload FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 1, 'response', 0, url, 1, page_id, md5(html) FROM p
  UNION ALL SELECT page_id, 2, 'revisit', 3, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=feed', 1, page_id, NULL FROM p
  UNION ALL SELECT page_id, 3, 'response', 5, url, 2, page_id + 1, md5('2|' || html) FROM p WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, 4, 'revisit', 7, regexp_replace(url, '^https?://', 'http://www.'), 1, CASE WHEN page_id % 10 = 0 THEN page_id + 2 ELSE page_id END, NULL FROM p),
u AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM v),
h AS (SELECT *, translate(regexp_extract(bare, '^([A-Za-z]+://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS head, regexp_replace(bare, '^[A-Za-z]+://[^/?]*', '') AS rest FROM u),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN regexp_replace(rest, '^[^?]*\?', '') ELSE '' END, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS asked FROM h),
k AS (SELECT page_id, slot, kind, page_id * 10 + after AS moment, version, modified, payload, regexp_replace(regexp_replace(regexp_replace(head, '^[a-z]+://', ''), '^www\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_replace(regexp_replace(rest, '\?.*$', ''), '/index\.html?$', ''), '/+$', '') || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS url_key FROM q),
r AS (SELECT *, page_id * 5 + slot AS id, CASE WHEN page_id % 5 <> 0 THEN substr(md5(url_key), 1, 8) || '-' || version END AS etag FROM k),
f AS (SELECT a.*, b.id AS found, b.etag AS b_etag, b.modified AS b_modified, b.payload AS b_payload
      FROM r a ASOF LEFT JOIN (SELECT * FROM r WHERE kind = 'response') b ON a.url_key = b.url_key AND a.moment > b.moment),
s AS (SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN found IS NULL THEN 'no_earlier_response'
        WHEN CASE WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN etag = b_etag ELSE modified <= b_modified END THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM f)
SELECT page_id, id AS record_id, url_key, kind, CASE WHEN kind = 'response' THEN id WHEN status = 'resolved' THEN found END AS target_id, status,
  'cache-control: ' || CASE WHEN kind = 'revisit' THEN 'max-age=60' ELSE 'no-cache' END || '; content-type: ' || CASE WHEN kind = 'revisit' AND status <> 'resolved' THEN 'text/plain' ELSE 'text/html' END || '; date: t' || CAST(moment AS VARCHAR) AS headers,
  CASE WHEN kind = 'response' THEN payload WHEN status = 'resolved' THEN b_payload END AS body
FROM s
"""
