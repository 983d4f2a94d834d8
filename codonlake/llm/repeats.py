"""Removal of long repeated byte strings with positional Burrows-Wheeler transforms.

A byte goes when it is covered by a string of `length` bytes that also starts earlier (smaller id, or the same document
further left). One index of the whole corpus would be one task, so the corpus is cut into neighbourhoods that can be
indexed apart and still hold every such pair of strings:

1. Anchors. The hashes of GRAM-byte strings are winnowed so that every string of `length` bytes holds an anchor, at the
   same place in each of its occurrences. An anchor's context is all that a string of `length` bytes around it can reach.
2. Contexts meet by the hash of their anchor. Anchors that stand once are done. Of equal contexts of an anchor only the
   first is indexed; the others repeat it whole; 128-bit digests of their bytes tell. (This is what makes copies of documents cheap, in any number.)
3. The different contexts of an anchor are lined up at it and indexed by a run-compressed positional Burrows-Wheeler
   transform: at each column the contexts are ordered by what they read backwards from there, and the column's symbols in
   that order are stored as runs: where a run begins, where it goes in the next column's order, and the contexts at its
   two ends (the sampled run ends). All contexts are then streamed through the stored runs. Inside a run a context keeps
   its predecessor, so its matching statistic, the length that it shares with the predecessor, grows by one without
   being touched; only at a run's sampled beginning is it found anew, against the sampled end of the run before.
   Contexts that share at least `length` symbols up to a column stand next to each other and hold one string; all but
   the earliest are marked. One block holds many anchors.
4. An anchor with more than `most_contexts` different contexts does not fit a block. Its strings of `length` bytes
   are told apart by 128-bit hashes and meet in an aggregation with partial minima, so no group is gathered.

Defined results: null counts as empty; texts shorter than `length` keep all; ids are ordered with null first; rows that
repeat an id are ordered by text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonlake.llm import kernels as K
from codonlake.llm.common import small_batches, written

LENGTH = 100
GRAM = 16
MOST_CONTEXTS = 60_000
BLOCK_BYTES = 1 << 20


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive bytes."""
    if len(data) < k:
        return np.zeros(0, K.U)
    with np.errstate(over="ignore"):
        h, span, full = K.BYTE[data], 1, None
        done = 0
        while True:
            if k & span:  # the parts of k's binary form, from small to large
                full = h[: len(data) - k + 1] if full is None else full * K.U(0xA24BAED4963EE407 + 2 * span) + h[done : done + len(data) - k + 1]
                done += span
            if span * 2 > k:
                break
            h = h[:-span] * K.U(0x9E3779B97F4A7C15 + 2 * span) + h[span:]
            span *= 2
        return K.mix(full)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, position in it, anchor hash, context start, context end in data) of all anchors whose context can hold a string."""
    h = gram_hashes(data, k)
    at = K.winnow(h, length - k + 1)
    doc = np.searchsorted(offsets, at, "right") - 1
    lo = np.maximum(offsets[doc], at - (length - k))
    hi = np.minimum(offsets[doc + 1], at + length)
    ok = (at + k <= offsets[doc + 1]) & (hi - lo >= length)
    at, doc, lo, hi = at[ok], doc[ok], lo[ok], hi[ok]
    return doc, at - offsets[doc], h[at], lo, hi


def context_digests(data: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit digest of each context's bytes; equal contexts also have their anchor at the same place."""
    whole, digest = memoryview(data.tobytes()), hashlib.blake2b
    both = b"".join([digest(whole[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    own, rest = np.frombuffer(both, K.U).reshape(-1, 2).T
    with np.errstate(over="ignore"):
        return own ^ K.mix(place.astype(K.U) * K.BASE), rest


def _anchored(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in K.text_steps(b.column(1)):
                ids = b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                doc, at, h, first, last = anchors(data, offsets, length, k)
                own, rest = context_digests(data, first, last, at + offsets[doc] - first)
                # of equal contexts in one step all but the first are copies; they need not meet the others, so no task
                # gets all rows of a passage that stands everywhere
                order = np.lexsort((at, ids[doc], rest, own, h))
                copy = np.zeros(len(h), bool)
                copy[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (own[order[1:]] == own[order[:-1]]) & (rest[order[1:]] == rest[order[:-1]])
                with np.errstate(over="ignore"):
                    h = np.where(copy, K.mix(own + ids[doc].astype(K.U) * K.BASE + at.astype(K.U)), h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(ids[doc]), pa.array(at.astype(np.int32)), pa.array(copy)], names=["h", "c", "d", "id", "at", "copy"])

    return run


def _contexts(length: int, k: int):
    """(id, zipped text, anchors [(h, at)]) to (h, id, at, start, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            h, at = flat.field("h"), flat.field("at").to_numpy()
            ids = np.repeat(b.column(0).to_numpy(), counts)
            starts = np.maximum(at - (length - k), 0)
            bodies, i = [], 0
            for packed, n in zip(b.column(1).to_pylist(), counts.tolist(), strict=True):
                text = zlib.decompress(packed)
                bodies += [text[lo:hi] for lo, hi in zip(starts[i : i + n].tolist(), (at[i : i + n] + length).tolist(), strict=True)]
                i += n
            for s in range(0, len(bodies), 20_000):
                e = s + 20_000
                yield pa.RecordBatch.from_arrays([h[s:e], pa.array(ids[s:e], pa.int64()), pa.array(at[s:e], pa.int32()), pa.array(starts[s:e], pa.int32()), pa.array(bodies[s:e], pa.binary())], names=["h", "id", "at", "start", "body"])

    return run


class RunIndex:
    """Run-compressed positional transform of groups of strings that are lined up in columns.

    symbols: (strings, columns), 0 where a string has no symbol; group: of each string, ascending. Of each column the
    index keeps its runs, in the order of the strings by group and by what they read backwards before the column: first
    row, row that the run's first string has in the next column's order, symbol, and the strings at both ends.
    """

    def __init__(self, symbols: np.ndarray, group: np.ndarray) -> None:
        self.symbols, n = symbols, len(group)
        self.runs: list[tuple[np.ndarray, ...]] = []
        own_group = group.astype(np.int64) << 8  # groups keep their rows in every column
        apart = group[1:] != group[:-1]
        order = np.arange(n)
        for column in np.ascontiguousarray(symbols.T):
            here = column[order]
            starts = np.concatenate([[0], np.flatnonzero((here[1:] != here[:-1]) | apart) + 1])
            turn = np.argsort(own_group[starts] | here[starts], kind="stable")
            sizes = np.diff(np.append(starts, n))
            goes = np.empty(len(starts), np.int64)
            goes[turn] = np.cumsum(sizes[turn]) - sizes[turn]
            self.runs.append((starts, goes, here[starts], order[starts], order[starts + sizes - 1]))
            order = self.moved(order, starts, goes, turn)

    @staticmethod
    def moved(order: np.ndarray, starts: np.ndarray, goes: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The order of the next column: whole runs change places, their strings stay side by side."""
        shift = (starts - goes)[turn]
        return order[np.arange(len(order)) + np.repeat(shift, np.diff(np.append(goes[turn], len(order))))]

    def statistics(self, group: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, order after it, statistic of each string): how many symbols up to the column a string shares with the
        one before it in that order, 0 for the first of its group or symbol; counted up to `most` where a run begins.
        """
        order = np.arange(len(group))
        since = np.zeros(len(group), np.int64)  # the statistic after a column is column + 1 - since
        for column, (starts, goes, symbol, first, last) in enumerate(self.runs):
            turn = np.argsort(goes)
            a, b = first[turn], last[turn[:-1]]
            kind = symbol[turn]
            same = (kind[1:] == kind[:-1]) & (group[a[1:]] == group[b]) & (kind[1:] != 0)
            since[a] = column + 1
            left = np.flatnonzero(same)
            since[a[left + 1]] -= self._shared(a[left + 1], b[left], column + 1, most)
            if not symbol.all():  # what has no symbol here shares none
                since[order[np.repeat(symbol == 0, np.diff(np.append(starts, len(order))))]] = column + 1
            order = self.moved(order, starts, goes, turn)
            yield column, order, column + 1 - since

    def _shared(self, a: np.ndarray, b: np.ndarray, end: int, most: int) -> np.ndarray:
        """Symbols that a and b share backwards from the end."""
        out = np.zeros(len(a), np.int64)
        left = np.arange(len(a))
        for size in (8, most):
            if not len(left):
                break
            lo = max(0, end - size)
            x = self.symbols[a[left], lo:end]
            differ = ((x != self.symbols[b[left], lo:end]) | (x == 0))[:, ::-1]
            shared = differ.argmax(1)
            shared[~differ.any(1)] = end - lo
            out[left] = shared
            left = left[(shared == end - lo) & (lo > 0)]
        return out


def later_matches(bodies: list[bytes], group: np.ndarray, ids: np.ndarray, ats: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(id, from, to) of maximal runs of bytes covered by strings of `length` bytes around an anchor that start earlier too.

    bodies: contexts, grouped by anchor; ats and starts: places of the anchor and of the context in the document.
    """
    width, before = 2 * length - k, length - k
    sizes = np.array([len(x) for x in bodies])
    first = before - (ats - starts)
    symbols = np.zeros((len(bodies), width), np.uint8)
    begin = np.cumsum(sizes) - sizes
    flat = np.repeat(np.arange(len(bodies)) * width + first - begin, sizes) + np.arange(sizes.sum())
    symbols.reshape(-1)[flat] = np.frombuffer(b"".join(bodies), np.uint8) + np.uint8(1)  # UTF-8 has no byte 0xFF
    when = np.empty(len(bodies), np.int64)
    when[np.lexsort((ats, ids))] = np.arange(len(bodies))
    marked = np.zeros((before + 1, len(bodies)), bool)
    for column, order, shared in RunIndex(symbols, group).statistics(group, length):
        if column < length - 1:
            continue
        fresh = shared[order] < length
        if fresh.all():
            continue
        heads = np.flatnonzero(fresh)
        own = when[order]
        least = np.minimum.reduceat(own, heads)
        marked[column - length + 1, order] = own > np.repeat(least, np.diff(np.append(heads, len(own))))
    row, at = np.nonzero(marked.T)
    if not len(row):
        return ids[:0], starts[:0], starts[:0]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length)
    opening = np.flatnonzero(fresh)
    closing = np.append(opening[1:] - 1, len(row) - 1)
    shift = ats - before
    return ids[row[opening]], shift[row[opening]] + at[opening], shift[row[closing]] + at[closing] + length


MARKS = "id long, lo int, hi int"


def _indexed(length: int, k: int, block_bytes: int):
    """Rows (h, id, at, start, body), ordered by h: marks."""

    def marks(part: list) -> pa.RecordBatch:
        h, ids, ats, starts, bodies = zip(*part, strict=True)
        h = np.array(h, np.int64)
        group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        out = later_matches(bodies, group, np.array(ids, np.int64), np.array(ats, np.int64), np.array(starts, np.int64), length, k)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= block_bytes and row[0] != held[-1][0]:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield marks(held)

    return run


def _strings(length: int):
    """Rows (h, id, start, body): every string of `length` bytes as (digest, id, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, i, start, body in zip(*(b.column(x).to_pylist() for x in range(4)), strict=True):
                n = len(body) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(body[j : j + length], digest_size=16).digest() for j in range(n)], pa.binary()), pa.array([i] * n, pa.int64()), pa.array(range(start, start + n), pa.int32())], names=["digest", "id", "lo"]
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, zipped text, marks [(lo, hi)]) to the result's columns."""
    for b in batches:
        lists = b.column(2)
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        lows, highs = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
        n_bytes, removed, spans, digests, i = [], [], [], [], 0
        for packed, n in zip(b.column(1).to_pylist(), counts.tolist(), strict=True):
            text = zlib.decompress(packed)
            digest, upto, gone, runs = hashlib.sha256(), 0, 0, 0
            if n:
                order = np.argsort(lows[i : i + n], kind="stable")
                lo, reach = lows[i : i + n][order], np.maximum.accumulate(np.minimum(highs[i : i + n][order], len(text)))
                fresh = np.concatenate([[0], np.flatnonzero(lo[1:] > reach[:-1]) + 1])
                for a, z in zip(lo[fresh].tolist(), reach[np.append(fresh[1:], n) - 1].tolist(), strict=True):
                    digest.update(text[upto:a])
                    gone, runs, upto = gone + z - a, runs + 1, z
                i += n
            digest.update(text[upto:])
            n_bytes.append(len(text))
            removed.append(gone)
            spans.append(runs)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress((x or "").encode(), 1) for x in b.column(1).to_pylist()], pa.binary())], names=["id", "packed"])


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM, most_contexts: int = MOST_CONTEXTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, marks) of every row."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not rows.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        ordered = rows.orderBy(F.col("id").asc_nulls_first(), "text").withColumn("row", F.monotonically_increasing_id())
        numbered = written(ordered, "numbered")  # ids that say the order of rows that share one
        found = _strip(numbered.select(F.col("row").alias("id"), "text"), length, k, most_contexts, block_bytes)
        return found.join(numbered.select(F.col("row").alias("id"), F.col("id").alias("doc_id")), "id").drop("id")
    return _strip(rows, length, k, most_contexts, block_bytes).withColumnRenamed("id", "doc_id")


def _strip(rows: DataFrame, length: int, k: int, most_contexts: int, block_bytes: int) -> DataFrame:
    found = rows.mapInArrow(_anchored(length, k), "h long, c long, d long, id long, at int, copy boolean").repartition("h")
    order = Window.partitionBy("h").orderBy("copy", "c", "d", "id", "at")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    content = F.struct("c", "d")
    own = F.when(~F.col("copy"), content)
    seen = found.select("h", content.alias("c"), "id", "at", "copy", F.lag(content).over(order).alias("above"), F.min(own).over(whole).alias("c0"), F.max(own).over(whole).alias("c1"))
    seen = seen.withColumn("first", ~F.col("copy") & (F.col("above").isNull() | (F.col("above") != F.col("c"))))
    several = seen.filter("NOT first OR c0 <> c1").withColumn("kinds", F.sum(F.col("first").cast("int")).over(Window.partitionBy("h")))
    repeated = written(several.select("h", "id", "at", "first", "kinds"), "anchors")
    packed = rows.mapInArrow(_zip, "id long, packed binary").filter("id IS NOT NULL")  # as an inner join does it: both joins read one exchange
    wanted = repeated.filter("first AND kinds > 1").select("id", "h", "at").repartition("id").groupBy("id").agg(F.collect_list(F.struct("h", "at")).alias("wanted"))  # at most one a byte of a document; rows travel lighter than short lists
    contexts = packed.join(wanted, "id").select("id", "packed", "wanted").mapInArrow(_contexts(length, k), "h long, id long, at int, start int, body binary")
    large = repeated.filter(F.col("kinds") > most_contexts).select("h").distinct()
    marks = None
    if large.isEmpty():
        small = contexts
    else:
        contexts = written(contexts, "contexts")
        small = contexts.join(large, "h", "left_anti")
        strings = contexts.join(large, "h", "left_semi").select("h", "id", "start", "body").mapInArrow(_strings(length), "digest binary, id long, lo int")
        strings = written(strings, "strings")
        least = strings.groupBy("digest").agg(F.min(F.struct("id", "lo")).alias("least"))
        marks = strings.join(least, "digest").filter("struct(id, lo) > least").select("id", "lo", (F.col("lo") + length).alias("hi"))
    indexed = small.repartition("h").sortWithinPartitions("h").select("h", "id", "at", "start", "body").mapInArrow(_indexed(length, k, block_bytes), MARKS)
    copies = repeated.filter("NOT first").select("id", F.greatest(F.col("at") - (length - k), F.lit(0)).alias("lo"), (F.col("at") + length).alias("hi"))
    marks = indexed.unionByName(copies) if marks is None else indexed.unionByName(copies).unionByName(marks)
    per_doc = marks.repartition("id").groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    joined = packed.join(per_doc, "id", "left").select("id", "packed", "marks")
    return joined.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return strip(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Strings of LENGTH bytes as 2 * LENGTH hexadecimal digits; a run ends where the next repeated string begins beyond it.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, p, substr(x, 2 * p + 1, {2 * LENGTH}) AS g FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - {LENGTH - 1})) AS p FROM d WHERE len(x) >= {2 * LENGTH})),
m AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM s) WHERE n > 1),
f AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM m),
r AS (SELECT doc_id, min(p) AS lo, max(p) + {LENGTH} AS hi FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM f) GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS upto FROM r),
a AS (SELECT k.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * upto + 1, 2 * (lo - upto)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
