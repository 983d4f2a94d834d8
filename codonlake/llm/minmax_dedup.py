"""Near-duplicate detection by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum, so 64 evaluations
give 128 values; both collide with probability equal to the Jaccard similarity. The values are banded, documents that
share a band are candidates, and every candidate link is confirmed on the two complete shingle sets.

Shape of the work: documents with the same sequence of words are one node, told by a digest of its bytes; equal sets of
different sequences are linked like other near copies. In each bucket (documents that share a band) every
node is compared with one node, the one that shares most bands with others. That links groups of near copies with
comparisons in proportion to their size. In buckets that still hold several components, the nodes outside the largest
one are queries against the others, in blocks of bounded size, by size and signature first; so no link between different
texts that share a band is lost. With 32 bands of 4 values, each of
another permutation, a link at similarity 0.75 exactly shares no band with probability 5e-6, at 0.8 with 5e-8; less for
small sets (1.4e-6 at 3 common shingles of 4, 2.8e-6 at 6 of 8). Candidates of which fewer than 70 of 128
signature bytes agree are not read in full (at 0.75 that happens with probability 1e-7).

Defined results: null and empty texts, and texts without words, have the empty set and are linked with nothing; fewer
than `k` words are one shingle; rows that repeat a text are members of one node whatever their ids; doc_id null is
never a component id unless all of a component's ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm import kernels as K
from codonlake.llm.common import by_place, skew_lookup, small_batches, written
from codonlake.llm.components import components

K_WORDS = 5
PERMUTATIONS = 64
BAND_ROWS = 4
NUMERATOR, DENOMINATOR = 75, 100
LEAST_AGREEING = 70
#: Nodes of a bucket, asking and asked, that meet in one cell.
BLOCK = 2048

_RNG = np.random.default_rng(5)
_ODD = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.int64).astype(K.U) * K.U(2) + K.U(1)
_XOR = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.int64).astype(K.U)

SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
SIGNED_DDL = "doc_id long, text_hash long, node binary, n_shingles long, bands array<long>, sig binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes, sorted within each document, and the bounds of the documents."""
    starts, ends, first = K.words(data, offsets, K.SPACED)
    hashes = K.word_hashes(data, starts, ends)
    all_grams = K.grams(hashes, k)
    parts, bounds = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.unique(all_grams[a : b - k + 1])
        elif b > a:
            own = K.grams(hashes[a:b], b - a)
        else:
            own = hashes[:0]
        parts.append(own)
        bounds.append(bounds[-1] + len(own))
    return np.concatenate(parts) if parts else hashes[:0], np.array(bounds)


def minmax(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS) signature values of the sets that are not empty: minima, then maxima."""
    at = bounds[:-1]
    out = np.empty((len(at), 2 * PERMUTATIONS), K.U)
    with np.errstate(over="ignore"):
        for p in range(PERMUTATIONS):
            v = (sets ^ _XOR[p]) * _ODD[p]
            out[:, p] = np.minimum.reduceat(v, at)
            out[:, PERMUTATIONS + p] = np.maximum.reduceat(v, at)
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    n = sig.shape[1] // BAND_ROWS
    minima, maxima = np.split(sig, 2, axis=1)
    dealt = np.concatenate([minima, np.roll(maxima, -(n // 2), axis=1)], axis=1)  # a band takes values of BAND_ROWS different permutations
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(1, n + 1, dtype=K.U), (len(sig), 1))
        for i in range(BAND_ROWS):
            out = K.mix(out + dealt[:, i * n : (i + 1) * n])
    return out.view(np.int64)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in K.text_steps(b.column(2)):
                sets, bounds = shingle_sets(K.LOWERED[data], offsets, k)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                sig = minmax(sets, np.append(bounds[:-1][full], bounds[-1])) if len(full) else np.zeros((0, 2 * PERMUTATIONS), K.U)
                band = bands_of(sig)
                small = (K.mix(sig) >> K.U(56)).astype(np.uint8)
                nodes: list = [None] * (hi - lo)
                sigs: list = [None] * (hi - lo)
                counts = np.zeros(hi - lo, np.int32)
                counts[full] = band.shape[1]
                lowered = K.LOWERED[data]
                for i, row in enumerate(full.tolist()):
                    sequence = b" ".join(lowered[offsets[row] : offsets[row + 1]].tobytes().split())
                    nodes[row] = hashlib.blake2b(sequence, digest_size=16).digest()
                    sigs[row] = small[i].tobytes()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(band.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(nodes, pa.binary()), pa.array(sizes.astype(np.int64)), lists, pa.array(sigs, pa.binary())], schema=SIGNED)

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b, sig_a, sig_b) whose signatures agree often enough."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
        keep = pa.array((x == y).sum(1) >= LEAST_AGREEING)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])


def _short(k: int):
    """(node, text) to (node, short): 16 bits of each shingle's hash, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in K.text_steps(b.column(1)):
                sets, bounds = shingle_sets(K.LOWERED[data], offsets, k)
                short = (sets >> K.U(48)).astype(np.uint16)  # stays sorted
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([short[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["node", "short"])

    return run


def _numbered(short: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Short hashes of several nodes with how often the value stood before in its node: equal ones pair off one to one."""
    fresh = np.ones(len(short), bool)
    fresh[1:] = short[1:] != short[:-1]
    fresh[bounds[:-1]] = True
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(short)), 0))
    return short.astype(np.int64) | (np.arange(len(short)) - begin) << 16


def _met(numerator: int, denominator: int):
    """Rows (band, row, ask, asks, node, root, n_shingles, sig, short) of whole cells: pairs of an asking node and another
    that lie in different components and whose sizes, signatures and short hashes allow a link. Equal shingles have equal
    short hashes, so the number of those that pair off is never below the true intersection."""

    def pairs(cell: list) -> set:
        roots = np.unique([x[5] for x in cell], return_inverse=True)[1]
        size = np.array([x[6] for x in cell])
        sig = np.frombuffer(b"".join(x[7] for x in cell), np.uint8).reshape(len(cell), -1)
        asking = np.array([x[3] for x in cell])
        rest = np.flatnonzero(~asking)
        bounds = np.concatenate([[0], np.cumsum(size)])
        keys = _numbered(np.frombuffer(b"".join(x[8] for x in cell), np.uint16), bounds)
        table = np.zeros(int(keys.max()) + 1 if len(keys) else 0, bool)
        out = set()
        for q in np.flatnonzero(asking).tolist():
            fits = rest[(roots[rest] != roots[q]) & (np.minimum(size[rest], size[q]) * denominator >= np.maximum(size[rest], size[q]) * numerator)]
            fits = fits[(sig[fits] == sig[q]).sum(1) >= LEAST_AGREEING]
            if not len(fits):
                continue
            own = keys[bounds[q] : bounds[q + 1]]
            table[own] = True
            n = size[fits]
            starts = np.cumsum(n) - n
            both = np.add.reduceat(table[keys[np.repeat(bounds[fits] - starts, n) + np.arange(n.sum())]], starts, dtype=np.int64)
            table[own] = False
            for r in fits[both * denominator >= numerator * (n + size[q] - both)].tolist():
                out.add((min(cell[q][4], cell[r][4]), max(cell[q][4], cell[r][4])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells():
            held: list = []
            for b in batches:
                for x in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                    if held and x[:3] != held[-1][:3]:
                        yield held
                        held = []
                    held.append(x)
            if held:
                yield held

        found: set = set()
        for cell in cells():
            found |= pairs(cell)
            if len(found) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])
                found = set()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return run


def word_set(text: str | None, k: int) -> set:
    words = (text or "").encode().lower().split()
    if len(words) >= k:
        return set(zip(*(words[i:] for i in range(k)), strict=False))
    return {tuple(words)} if words else set()


def _confirm(k: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in batches:
            ok = []
            for key, left, right in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key != last:
                    last, held = key, word_set(left, k)
                other = word_set(right, k)
                both = len(held & other)
                ok.append(denominator * both >= numerator * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """(a, b, linked) of pairs(a, b); each side's text comes by a shuffle join that adaptive execution can split."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_confirm(k, numerator, denominator), "a binary, b binary, linked boolean")


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row of docs."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(_sign(k), SIGNED_DDL), "signatures")
    total = signed.count()
    classes = written(
        signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("least"), F.count("*").alias("members"), F.first("n_shingles").alias("size")),
        "classes",
    )
    # buckets: nodes that share a band; the node that shares the most is nearest to what its bucket has in common
    reps = signed.join(classes.select("node", "one"), "node").filter("struct(doc_id, text_hash) <=> one").dropDuplicates(["node"]).select("node", "n_shingles", "bands", "sig")
    banded = reps.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("held")).filter("held > 1").withColumn("shared", F.col("held"))
    inside = written(skew_lookup(banded, buckets, "band", "held", total * 2 * PERMUTATIONS // BAND_ROWS, "node").filter("shared IS NOT NULL"), "buckets")
    ranked = inside.join(inside.groupBy("node").agg(F.sum("shared").alias("popular")), "node")
    centers = ranked.groupBy("band").agg(F.max(F.struct("popular", "node")).alias("best")).select("band", F.col("best.node").alias("a"))
    slim = written(reps.select("node", "n_shingles", "sig").join(inside.select("node").distinct(), "node", "left_semi"), "slim")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the threshold and whose signatures agree."""
        sides = [slim.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b")]
        sized = pairs.join(sides[1], "b").join(sides[0], "a").filter(F.least("n_a", "n_b") * denominator >= F.greatest("n_a", "n_b") * numerator)
        return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing, "a binary, b binary")

    stars = inside.select("band", F.col("node").alias("b")).join(centers, "band").filter("a <> b").select("a", "b").distinct()
    first = written(likely(stars), "candidates")
    wanted = classes.join(slim.select("node"), "node", "left_semi").select("node", "one.doc_id", "one.text_hash")
    texts = written(
        rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_hash"] == wanted["text_hash"])).select("node", "text").dropDuplicates(["node"]), "texts"
    )
    seen = written(_compared(first, texts, k, numerator, denominator), "compared")
    links = seen.filter("linked").select("a", "b")
    roots = written(components(links), "roots")
    # buckets that still hold several components: what is outside the largest meets the rest, in blocks
    placed = inside.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    main = placed.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("kinds"))
    main = main.filter("kinds > 1").select("band", F.col("most.root").alias("main"), "all", (F.col("all") - F.col("most.n")).alias("apart"))
    unsettled = placed.join(main, "band")
    short = texts.join(unsettled.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_short(k), "node binary, short binary")
    mixed = unsettled.join(slim, "node").join(short, "node")
    asks = F.col("root") != F.col("main")
    n_rows, n_asks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("all", "apart"))
    own_row, own_ask = F.pmod(F.xxhash64("node"), n_rows).cast("int"), F.pmod(F.xxhash64("node"), n_asks).cast("int")
    grid = mixed.withColumn("grid", F.array_union(
        F.transform(F.sequence(F.lit(0), n_asks - 1), lambda a: F.struct(own_row.alias("row"), a.alias("ask"), F.lit(False).alias("asks"))),
        F.when(asks, F.transform(F.sequence(F.lit(0), n_rows - 1), lambda r: F.struct(r.alias("row"), own_ask.alias("ask"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<row:int,ask:int,asks:boolean>>")),
    ))
    cells = grid.select("band", "node", "root", "n_shingles", "sig", "short", F.inline("grid")).repartition("band", "row", "ask").sortWithinPartitions("band", "row", "ask")
    near = cells.select("band", "row", "ask", "asks", "node", "root", "n_shingles", "sig", "short").mapInArrow(_met(numerator, denominator), "a binary, b binary").distinct()
    near = near.join(seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = written(_compared(written(near, "candidates-more"), texts, k, numerator, denominator).filter("linked").select("a", "b"), "links-more")
    if not more.isEmpty():
        roots = written(components(links.union(more)), "roots")
    # each class's component: the smallest id among all its classes
    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    table = placed.filter("members > 1").select("node", "members", "root").unionByName(placed.filter("members = 1").join(roots.select("node"), "node", "left_semi").select("node", "members", "root"))
    table = skew_lookup(table, lowest, "root", "nodes", total, "node").select("node", "members", "component_id")
    out = skew_lookup(signed.select("doc_id", "text_hash", "node", "n_shingles"), table, "node", "members", total, "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; columns as they were."""
    gone = label(docs, id_col, text_col).filter("NOT (doc_id <=> component_id)").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    plain, place = by_place(docs)
    same = F.col(place[id_col]).cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(place[text_col]) == F.col("gone_text"))
    return plain.join(gone, same, "left_anti").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = label(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c),
f AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.rep AS a, b.rep AS b FROM (SELECT * FROM e SEMI JOIN f USING (g)) a JOIN (SELECT * FROM e SEMI JOIN f USING (g)) b ON a.g = b.g AND a.rep < b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, seen) AS (SELECT rep, rep FROM c UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
m AS (SELECT node, min(seen) AS comp FROM r GROUP BY node),
k AS (SELECT s.doc_id, len(s.sh) AS n, c.rep FROM s LEFT JOIN c ON c.sh = list_sort(s.sh))
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.comp, k.doc_id) AS component_id, k.doc_id = coalesce(m.comp, k.doc_id) AS kept
FROM k LEFT JOIN m ON m.node = k.rep
"""
