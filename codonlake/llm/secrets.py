"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control. SQL functions only.

Fixed patterns: assign, access and hex (see PATTERNS). Candidates of the battery are runs of at least MIN_TOKEN symbols
of the base64 alphabets. The encoding is inferred from the symbols that occur (hexadecimal, base32, letters and digits,
base64), which fixes the alphabet's size A. What is tested is that a token is ordinary: an identifier, a path, a word. With n
symbols, counts c, symbol values v, and the encoding's ordinary figures (ORDINARY: shares of squared and cubed symbol
frequencies k2 and k3, rate q of changes between kinds of symbols, correlation r of neighbours):
  uniformity  chi2 = A / n * sum(c^2) - n is (n - 1) (A k2 - 1) + A - 1 for ordinary tokens, and lower for random ones
  runs        the runs of digits, capitals, small letters and others change (n - 1) q times in ordinary tokens, more in random ones
  serial      the correlation of neighbouring values is r in ordinary tokens, about 0 in random ones
Each test gives the distance z from the ordinary expectation in standard deviations, towards random. The three are added
and divided by sqrt(3 + 6 * TOGETHER), their deviation when each two correlate by TOGETHER, and the tail beyond that
combined z, bounded by exp(-z^2 / 2) / (z sqrt(2 pi)), is the one p-value of the token; longer tokens reach smaller ones.
Within each class of length the Benjamini-Hochberg rule at level FDR sees the p-values of all candidates and sets the
largest that is accepted. It is found on counts in BINS steps of -ln p, a table of fixed size.

Defined results: null counts as empty; a text without findings has empty spans; rows that repeat an id are rows of
their own; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.llm.common import written

#: Name, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"()(AKIA[A-Z0-9]+)", 2, 20),
    ("hex", r"()([0-9a-f]{24,})", 2, 24),
)
MIN_TOKEN = 20
TOKEN = r"()([A-Za-z0-9+/_-]{20,})"
KINDS = ("assign", "access", "hex", "random")
BINS = 400
BIN_STEPS = 4.0
FDR = 0.02
LENGTH_CLASSES = (32, 48, 64)
#: Ordinary figures by encoding: k2, k3, q, r.
ORDINARY = {"hex": (0.11, 0.0145, 0.2, 0.3), "base32": (0.066, 0.0056, 0.1, 0.3), "alphanumeric": (0.066, 0.0056, 0.35, 0.3), "base64": (0.066, 0.0056, 0.35, 0.3)}
#: Symbols by encoding, in the order of their values.
LETTERS_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SYMBOLS = {"hex": "0123456789abcdef", "base32": "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ", "alphanumeric": LETTERS_DIGITS, "base64": "+/-_" + LETTERS_DIGITS}
#: Sizes of the alphabets; the two base64 alphabets differ in two symbols.
SIZES = {"hex": 16, "base32": 32, "alphanumeric": 62, "base64": 64}
KIND_RUNS = "[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+"
TOGETHER = 0.1

SPAN = "array<struct<start:int,end:int,kind:int>>"
TOKENS = "array<struct<start:int,end:int,kind:int,token:string>>"
#: Running sums add up 2 ** DOUBLINGS neighbours: more matches than a string of 2 ** 31 bytes can hold.
DOUBLINGS = 29


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it stands in use."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def summed(values: Column) -> Column:
    """Running sums of an array: of 1, 2, 4, ... neighbours, so that the work grows with n log n."""

    def added(v: Column, far: int) -> Column:
        return F.when(F.size(v) > far, F.transform(v, lambda x, i: F.when(i >= far, x + F.get(v, i - far)).otherwise(x))).otherwise(v)

    for step in range(DOUBLINGS):
        values = bound(values, partial(added, far=1 << step))
    return values


def found(text: Column, pattern: str, kind: int, least: int, with_token: bool = False) -> Column:
    """Spans, in code points, of the pattern's matches whose second group has at least `least` symbols; with its text or not.

    The texts between matches and the matches themselves, put side by side, give the places.
    """
    empty = F.array().cast(TOKENS if with_token else SPAN)
    lengths = lambda strings: F.transform(strings, lambda s: F.length(s))
    pieces, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    matches = F.struct(lengths(pieces).alias("gaps"), lengths(whole).alias("n"), lengths(value).alias("held"), *([value.alias("value")] if with_token else []))

    def spans(m: Column) -> Column:
        def one(end: Column, i: Column) -> Column:
            own = F.struct((end - F.get(m["n"], i)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), *([F.get(m["value"], i).alias("token")] if with_token else []))
            return F.when(F.get(m["held"], i) >= least, own)

        ends = summed(F.transform(m["n"], lambda n, i: n + F.get(m["gaps"], i)))
        return F.filter(F.transform(ends, one), lambda s: s.isNotNull())

    return F.when(F.rlike(text, F.lit(pattern)), bound(matches, spans)).otherwise(empty)


def encoding(token: Column) -> Column:
    """The narrowest encoding that has all symbols of the token."""
    return (
        F.when(F.rlike(token, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), "hex")
        .when(F.rlike(token, F.lit("^[A-Z2-7]+$")), "base32")
        .when(F.rlike(token, F.lit("^[A-Za-z0-9]+$")), "alphanumeric")
        .otherwise("base64")
    )


def battery(token: Column) -> Column:
    """Struct (n, encoding, z, minus_ln_p) of a token."""

    def of(table: dict, kind: Column) -> Column:
        out = None
        for name, value in table.items():
            out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
        return out

    def with_values(h: Column) -> Column:
        shown = F.when(h["kind"] == "hex", F.lower(h["token"])).otherwise(h["token"])
        code = of({k: F.lit(v) for k, v in SYMBOLS.items()}, h["kind"])
        changes = F.when(h["kind"] == "hex", F.regexp_count(h["token"], F.lit("[0-9]+|[A-Za-z]+"))).otherwise(F.regexp_count(h["token"], F.lit(KIND_RUNS))) - 1
        squares = F.aggregate(F.split(code, ""), F.lit(0.0), lambda a, c: a + F.pow((F.length(shown) - F.length(F.replace(shown, c, F.lit("")))).cast("double"), F.lit(2.0)))
        values = F.transform(F.split(shown, ""), lambda c: F.instr(code, c).cast("double"))
        figures = [of({k: F.lit(float(v[i])) for k, v in ORDINARY.items()}, h["kind"]).alias(name) for i, name in enumerate(("k2", "k3", "q", "r"))]
        return F.struct(F.length(h["token"]).cast("double").alias("n"), h["kind"].alias("kind"), of({k: F.lit(float(v)) for k, v in SIZES.items()}, h["kind"]).alias("a"), squares.alias("sq"), values.alias("v"), changes.cast("double").alias("changes"), *figures)

    def tests(t: Column) -> Column:
        n, a, v = t["n"], t["a"], t["v"]
        expected = (n - 1) * (a * t["k2"] - 1) + (a - 1)
        z_chi = (expected - (a / n * t["sq"] - n)) / F.sqrt(2 * (a - 1) + 4 * n * a * a * (t["k3"] - t["k2"] * t["k2"]))
        z_runs = (t["changes"] - (n - 1) * t["q"]) / F.sqrt((n - 1) * t["q"] * (1 - t["q"]))
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        spread = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda x, y: (x - mean) * (y - mean))
        serial = F.when(spread > 0, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(spread, F.lit(1e-9))).otherwise(F.lit(1.0))
        z_serial = (t["r"] - serial) * F.sqrt(n) / F.sqrt(1 - t["r"] * t["r"])
        z = (z_chi + z_runs + z_serial) / math.sqrt(3 + 6 * TOGETHER)
        return F.struct(n.cast("int").alias("n"), t["kind"].alias("kind"), z.alias("z"), F.when(z > 1, z * z / 2 + F.ln(F.greatest(z, F.lit(1.0)) * math.sqrt(2 * math.pi))).otherwise(0.0).alias("minus_ln_p"))

    head = F.struct(token.alias("token"), encoding(token).alias("kind"))
    return F.element_at(F.transform(F.transform(F.array(head), with_values), tests), 1)


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for bound in LENGTH_CLASSES:
        out = out + (n >= bound).cast("int")
    return out


def accepted(tokens: DataFrame, level: float = FDR) -> dict[int, int]:
    """For each class of length the smallest step of -ln p that the Benjamini-Hochberg rule accepts; of (class, step)."""
    counts: dict[int, dict[int, int]] = {}
    for r in tokens.groupBy("class", "step").count().collect():  # at most BINS + 1 steps in each of four classes
        counts.setdefault(r["class"], {})[r["step"]] = r["count"]
    out = {}
    for c, by_step in counts.items():
        total, above = sum(by_step.values()), 0
        for step in range(BINS, -1, -1):
            above += by_step.get(step, 0)
            if above and total * math.exp(-step / BIN_STEPS) <= level * above:
                out[c] = step
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = FDR) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, end, kind) by start and kind; kind is an index of KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*[found(text, p, i, least) for i, (_, p, _, least) in enumerate(PATTERNS)]))
    tokens = found(text, TOKEN, 3, MIN_TOKEN, with_token=True)
    tested = F.transform(F.col("tokens"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["token"]).alias("b")))
    slim = F.transform("tested", lambda t: F.struct(t["start"], t["end"], length_class(t["b"]["n"]).alias("class"), F.least(F.floor(t["b"]["minus_ln_p"] * BIN_STEPS), F.lit(BINS)).cast("int").alias("step")))
    rows = docs.select(F.col(id_col).alias("doc_id"), base.alias("base"), tokens.alias("tokens"))
    rows = rows.withColumn("tested", F.when(F.size("tokens") > 0, tested)).select("doc_id", "base", slim.alias("tested"))
    rows = written(rows, "tokens")
    steps = accepted(rows.select(F.explode("tested").alias("t")).select("t.class", "t.step"), level)
    bound = F.create_map(*[F.lit(x) for c in range(len(LENGTH_CLASSES) + 1) for x in (c, steps.get(c, BINS + 1))])
    more = F.transform(F.filter("tested", lambda t: t["step"] >= bound[t["class"]]), lambda t: F.struct(t["start"], t["end"], F.lit(3).alias("kind")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce(more, F.array().cast(SPAN)))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return rows.select("doc_id", count(0), count(1), count(2), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _oracle() -> str:
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")  # (?i) would fold beyond A-Z here
    value = PATTERNS[0][1].partition(")[\"']?\\x20*")[2]
    patterns = [(f"({either})[\"']?\\x20*{value}", PATTERNS[0][3]), *[(p, least) for _, p, _, least in PATTERNS[1:]], (TOKEN, MIN_TOKEN)]
    quoted = [("'" + p.replace("'", "''") + "'", least) for p, least in patterns]
    places = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, {least} AS least, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, 2) AS v FROM d WHERE regexp_matches(t, {p})"
        for k, (p, least) in enumerate(quoted)
    )
    figures = ", ".join(f"('{k}', '{SYMBOLS[k]}', CAST({SIZES[k]} AS DOUBLE), " + ", ".join(f"CAST({x} AS DOUBLE)" for x in ORDINARY[k]) + ")" for k in SYMBOLS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({places}),
u AS (SELECT doc_id, k, least, unnest(range(len(w))) AS i, unnest(w) AS token, unnest(list_transform(w, lambda x: length(x))) AS n,
      unnest(list_transform(gaps[1:len(w)], lambda x: length(x))) AS gap, unnest(list_transform(v, lambda x: length(x))) AS vn FROM m),
p AS (SELECT *, z - n AS a FROM (SELECT doc_id, k, least, token, n, vn, sum(gap + n) OVER (PARTITION BY doc_id, k ORDER BY i) AS z FROM u)),
f(enc, symbols, size, k2, k3, q, r) AS (VALUES {figures}),
e AS (SELECT doc_id, a, z, token, CAST(n AS DOUBLE) AS n, CASE WHEN regexp_full_match(token, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(token, '[A-Z2-7]+') THEN 'base32'
      WHEN regexp_full_match(token, '[A-Za-z0-9]+') THEN 'alphanumeric' ELSE 'base64' END AS enc FROM p WHERE k = 3),
x AS (SELECT e.*, f.* EXCLUDE (enc), CASE WHEN enc = 'hex' THEN lower(token) ELSE token END AS shown,
      len(CASE WHEN enc = 'hex' THEN regexp_extract_all(token, '[0-9]+|[A-Za-z]+') ELSE regexp_extract_all(token, '{KIND_RUNS}') END) - 1 AS changes FROM e JOIN f USING (enc)),
c AS (SELECT *, list_sum(v) / n AS mean FROM (SELECT *, list_transform(string_split(shown, ''), lambda s: CAST(instr(symbols, s) AS DOUBLE)) AS v,
      list_sum(list_transform(string_split(symbols, ''), lambda s: pow(CAST(length(shown) - length(replace(shown, s, '')) AS DOUBLE), 2))) AS squares FROM x)),
s AS (SELECT *, list_sum(list_transform(v, lambda y: (y - mean) * (y - mean))) AS spread,
      list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - mean) * (v[i + 1] - mean))) AS together FROM c),
b AS (SELECT doc_id, a, z, n, ((((n - 1) * (size * k2 - 1) + size - 1) - (size / n * squares - n)) / sqrt(2 * (size - 1) + 4 * n * size * size * (k3 - k2 * k2))
      + (changes - (n - 1) * q) / sqrt((n - 1) * q * (1 - q))
      + (r - CASE WHEN spread > 0 THEN together / greatest(spread, 1e-9) ELSE 1 END) * sqrt(n) / sqrt(1 - r * r)) / {math.sqrt(3 + 6 * TOGETHER)!r} AS score FROM s),
g AS (SELECT doc_id, a, z, {" + ".join(f"CAST(n >= {x} AS INT)" for x in LENGTH_CLASSES)} AS class,
      CAST(least(floor({BIN_STEPS} * CASE WHEN score > 1 THEN score * score / 2 + ln(score * {math.sqrt(2 * math.pi)!r}) ELSE 0 END), {BINS}) AS INT) AS step FROM b),
h AS (SELECT class, step, sum(n) OVER (PARTITION BY class) AS total, sum(n) OVER (PARTITION BY class ORDER BY step DESC) AS above FROM (SELECT class, step, count(*) AS n FROM g GROUP BY class, step)),
o AS (SELECT class, min(step) AS bound FROM h WHERE total * exp(-step / CAST({BIN_STEPS} AS DOUBLE)) <= CAST({FDR} AS DOUBLE) * above GROUP BY class),
y AS (SELECT doc_id, k, a, z FROM p WHERE k < 3 AND vn >= least UNION ALL SELECT doc_id, 3, a, z FROM g JOIN o USING (class) WHERE step >= bound),
l AS (SELECT doc_id, k, a, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || a || ':' || z AS one FROM y)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(one, ',' ORDER BY a, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(one, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id
"""


ORACLE = _oracle()
