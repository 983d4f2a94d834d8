"""Benchmark decontamination by winnowing.

The k-gram hash that is the smallest of each sliding window of WINDOW - k + 1 k-grams is kept, in documents and in
benchmark items; equal fingerprints are hits, and each hit is extended word by word in both directions. Every span of
WINDOW words that a document and an item share holds one kept fingerprint of both, so none is missed. An item of fewer
than WINDOW words is one window of its own length, and so is its fingerprint: documents are winnowed for each such
length with a window of one gram.

The benchmark's fingerprints go to the executors by broadcast while the benchmark has at most `broadcast_words` words;
a larger one is joined with the documents' fingerprints by a shuffle, and only the texts of documents with an equal
fingerprint meet the items that share it. Both ways winnow alike and extend hits with the same code.

Defined results: null and empty texts have no words; an item without words has no window; repeated items count as often
as they stand in the benchmark, but an item_id counts once; an item whose id is null marks words and is not counted;
an empty benchmark marks nothing; no documents, no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm import kernels as K
from codonlake.llm.common import by_place, small_batches, written

WINDOW = 13
GRAM = 5
BROADCAST_WORDS = 2_000_000

_TABLE = bytes(32 if not K.ALNUM[i] else i for i in K.LOWERED)


def split(text: str | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"""
    return (text or "").encode().translate(_TABLE).split()


def hashed(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, K.U)
    ends = np.cumsum([len(w) for w in words])
    return K.word_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


class Items:
    """The benchmark, or a part of it, with its fingerprints sorted by hash."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, k: int = GRAM) -> None:
        self.window, self.k, self.ids, self.words = window, k, [], []
        found: dict[int, list] = defaultdict(list)  # gram length -> (hash, item, position)
        for item_id, text in items:
            words = split(text)
            if not words:
                continue
            n = len(self.words)
            self.ids.append(item_id)
            self.words.append(words)
            for size, at, h in fingerprints(hashed(words), len(words), window, k):
                found[size].append((h, np.full(len(h), n), at))
        self.prints = {}
        self.short_of_k = any(len(w) == k for w in self.words)  # items of k words have no window to winnow in
        for size, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.prints[size] = (h[order], item[order], at[order])

    def hits(self, words: list[bytes], found: dict[int, np.ndarray], grams: dict[int, np.ndarray]) -> tuple[np.ndarray, set]:
        """Which words of a document lie inside an occurrence of a window, and the items with occurring windows."""
        marked = np.zeros(len(words) + 1, np.int64)
        items, done = set(), set()
        for size, positions in found.items():
            prints, item_of, place_of = self.prints[size]
            for i, h in zip(positions.tolist(), grams[size].tolist(), strict=True):
                e = int(np.searchsorted(prints, K.U(h)))
                while e < len(prints) and prints[e] == K.U(h):
                    item, j = int(item_of[e]), int(place_of[e])
                    e += 1
                    own = self.words[item]
                    if size != self.k or len(own) < self.window:
                        if words[i : i + size] == own:
                            marked[i] += 1
                            marked[i + size] -= 1
                            items.add(item)
                        continue
                    if (item, i - j, i) in done:  # inside a run that was extended before
                        continue
                    if words[i : i + size] != own[j : j + size]:
                        continue
                    lo, hi = 0, size
                    while i - lo > 0 and j - lo > 0 and words[i - lo - 1] == own[j - lo - 1]:
                        lo += 1
                    while i + hi < len(words) and j + hi < len(own) and words[i + hi] == own[j + hi]:
                        hi += 1
                    done.update((item, i - j, x) for x in range(i - lo, i + hi))
                    if lo + hi >= self.window:
                        marked[i - lo] += 1
                        marked[i + hi] -= 1
                        items.add(item)
        return np.cumsum(marked[:-1]) > 0, items

    def in_words(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """The same for one document, whose grams are winnowed here."""
        found, grams, h = {}, {}, hashed(words)
        for size in self.prints:
            g = K.grams(h, size)
            at = K.winnow(g, self.window - self.k + 1) if size == self.k and not self.short_of_k else np.arange(len(g))
            found[size], grams[size] = at, g[at]
        return self.hits(words, found, grams)


def fingerprints(h: np.ndarray, n: int, window: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(gram length, positions, hashes) that an item keeps."""
    if n >= window:
        g = K.grams(h, k)
        at = K.winnow(g, window - k + 1)
        yield k, at, g[at]
    elif n:
        yield n, np.zeros(1, np.int64), K.grams(h, n)


MARKED = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.string()), ("items_sha256", pa.string())])
MARKED_DDL = "n_words long, n_hit long, n_items long, items string, items_sha256 string"


def _listed(items: Items, which: set) -> tuple[int, str, str]:
    ids = sorted({items.ids[i] for i in which} - {None}, key=lambda x: x.encode())
    joined = ",".join(ids)
    return len(ids), joined, hashlib.sha256(joined.encode()).hexdigest()


def _scan(batches: Iterator[pa.RecordBatch], items: Items, text_at: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Marks the text column at text_at; the other columns go through."""
    window, k = items.window, items.k
    for b in batches:
        for lo, hi, raw, offsets in K.text_steps(b.column(text_at)):
            data = K.LOWERED[raw]
            starts, ends, first = K.words(data, offsets, K.ALNUM)
            hashes = K.word_hashes(data, starts, ends)
            out = [[int(n), 0, 0, "", hashlib.sha256(b"").hexdigest()] for n in np.diff(first)]
            per_doc: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
            for size, (prints, _, _) in items.prints.items():
                g = K.grams(hashes, size)
                # grams that cross documents may take part: they add positions and hide none that lies inside one document
                at = np.arange(len(g))
                if size == k:
                    inside = np.zeros(len(g), bool)
                    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                        if z - a >= k:
                            inside[a + K.winnow(g[a : z - k + 1], window - k + 1)] = True
                    if items.short_of_k:
                        inside[:] = True
                    at = np.flatnonzero(inside)
                place = np.searchsorted(prints, g[at])
                place[place == len(prints)] = 0
                at = at[prints[place] == g[at]]
                doc = np.searchsorted(first, at, "right") - 1
                for d, i, h in zip(doc.tolist(), at.tolist(), g[at].tolist(), strict=True):
                    if i + size <= first[d + 1]:
                        per_doc[d][size].append((i - int(first[d]), h))
            for d, found in per_doc.items():
                a, z = int(first[d]), int(first[d + 1])
                words = [data[s:e].tobytes() for s, e in zip(starts[a:z].tolist(), ends[a:z].tolist(), strict=True)]
                hit, which = items.hits(words, {s: np.array([x[0] for x in v]) for s, v in found.items()}, {s: np.array([x[1] for x in v], K.U) for s, v in found.items()})
                out[d][1:] = [int(hit.sum()), *_listed(items, which)]
            own = [pa.array([x[i] for x in out], MARKED.field(i).type) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(b.num_columns) if i != text_at), *own], schema=schema)


def _prints_of(window: int, k: int, sizes: list[int]):
    """(key columns, gram length, hash) of winnowed rows; sizes: lengths of the short items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lens, out = [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                h = hashed(split(text))
                g = K.grams(h, k)
                parts = [(0, g[K.winnow(g, window - k + 1)])] + [(s, K.grams(h, s)) for s in sizes]
                for s, x in parts:
                    x = np.unique(x)
                    rows.append(np.full(len(x), i))
                    lens.append(np.full(len(x), s))
                    out.append(x.view(np.int64))
            take = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(np.concatenate(lens) if rows else [], pa.int64()), pa.array(np.concatenate(out) if rows else [], pa.int64())], names=["key", "size", "h"])

    return run


def _met(window: int, k: int):
    """Rows (key, text, item_id, item_text), one for each document and item that share a fingerprint: (key, start, stop, item_id) of marked runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, items = None, None
        for b in batches:
            keys, starts, stops, ids = [], [], [], []
            for key, text, item_id, item in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if items is None or item != last:
                    last, items = item, Items([(item_id, item)], window, k)
                hit = items.in_words(split(text))[0].astype(np.int8)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]))).tolist()
                for start, stop in zip(edges[0::2], edges[1::2], strict=True):
                    keys.append(key)
                    starts.append(start)
                    stops.append(stop)
                    ids.append(item_id)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(ids, pa.string())], names=["key", "start", "stop", "item_id"])

    return run


def _label_by_shuffle(docs: DataFrame, bench: DataFrame, text_col: str, window: int, k: int, sizes: list[int]) -> DataFrame:
    """The way for a benchmark of any size; texts are told apart by their digest, so copies are met once."""
    plain, place = by_place(docs)
    text = F.coalesce(F.col(place[text_col]), F.lit(""))
    keyed = plain.withColumn("key", F.unhex(F.sha2(text, 256)))
    once = written(keyed.select("key", text.alias("text")).dropDuplicates(["key"]), "distinct-texts")
    items = written(bench.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("item_text")), "items")
    doc_prints = once.mapInArrow(_prints_of(window, k, sizes), "key binary, size long, h long")
    item_prints = items.withColumn("key", F.col("item")).select("key", "item_text").mapInArrow(_prints_of(window, k, sizes), "key long, size long, h long").select(F.col("key").alias("item"), "size", "h").distinct()
    met = doc_prints.join(item_prints, ["size", "h"]).select("key", "item").distinct()
    runs = met.join(items, "item").join(once, "key").select("key", "text", "item_id", "item_text").mapInArrow(_met(window, k), "key binary, start long, stop long, item_id string")
    runs = written(runs, "runs")
    covered = runs.select("key", F.explode(F.sequence("start", F.col("stop") - 1)).alias("at")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    listed = runs.filter("item_id IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    listed = listed.select("key", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("items"))
    hit = covered.join(listed, "key", "left")
    words = F.size(F.array_remove(F.split(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "), "")).cast("long")
    out = keyed.join(hit, "key", "left").withColumn("n_words", words)
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_hit", "n_items")} | {"items": F.coalesce("items", F.lit(""))}
    out = out.withColumns(filled).withColumn("items_sha256", F.sha2("items", 256))
    return out.select(*[F.col(p).alias(c) for c, p in place.items() if c != text_col], *(f.name for f in MARKED))


def label(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW, k: int = GRAM, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The columns of docs but the text (those that bear a name of the result are left out), and n_words, n_hit, n_items,
    items, items_sha256, contaminated.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in (*(f.name for f in MARKED), "contaminated") if c != text_col])
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    pieces = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "), lambda x: x != "")
    sized = bench.withColumn("n", F.size(pieces))
    count = sized.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_set(F.when(F.col("n").between(1, window - 1), F.col("n"))), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if count[0] <= broadcast_words and count[2] <= 16 * broadcast_words:  # proven size: at most broadcast_words words
        rows = [(r["item_id"], r["text"]) for r in bench.collect()]
        shared = spark.sparkContext.broadcast(rows)
        others = [f for f in docs.schema.fields if f.name != text_col]
        ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [MARKED_DDL])
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, schema = Items(shared.value, window, k), None
            for b in batches:
                schema = schema or pa.schema([b.schema.field(i) for i in range(b.num_columns) if i != at] + list(MARKED))
                yield from _scan(iter([b]), items, at, schema)

        out = small_batches(docs).mapInArrow(run, ddl)
    else:
        out = _label_by_shuffle(docs, bench, text_col, window, k, sorted(count[1]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; columns as they were."""
    plain, place = by_place(docs)
    kept = label(plain.withColumn("text", F.col(place[text_col])), bench).filter("NOT contaminated")
    return kept.select([F.col(p).alias(c) for c, p in place.items()])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = label(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS g
       FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM (SELECT *, least(13, len(ws)) AS size FROM b WHERE len(ws) > 0))),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS g
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
h AS (SELECT doc_id, item_id, i, bw.size AS size FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
