"""Ranked lexical search: per shard a dual-sorted wavelet tree over its postings, searched best node first; exact top k.

Index. Documents are taken in shards of bounded size, each by the task that reads them, so no posting is shuffled. A
shard's postings stand term by term, the highest impact first (ties: smaller id): that is one order. The sequence of
their documents is stored as a wavelet tree (one bit a level and posting, level by level): that is the other, as its
leaves are the documents by id. A term is a range of the root; rank maps a range to a node's children. Parts of a range
keep their order, so the first posting of a term's range at a node has the term's highest impact among all the documents
below. Impacts depend on corpus-wide counts, which are summed up first.

Search. An item is a set of root ranges with weights. The sum of weight x first impact over the ranges that a node still
holds bounds every document's score below; at a leaf it is the score. Nodes are opened by bound, the highest first, a
block of them at a time, until none can hold one of the k best; documents that share no term with an item have no range.
What one shard has found for an item bounds the next shard of the task from below. Each task returns k rows an item at
most, and a window with a limit before its shuffle takes the k best of all.

Items are a stated query set, taken in blocks of at most BLOCK_TERMS (item, term) pairs (an item with more is a block of
its own): a block goes to the tasks; its document frequencies are summed from the shards' dictionaries alone.

Score of a document for an item, in 64-bit integers, `//` rounding down: the sum over the item's terms, repeats included,
of w * (1000000000 * tf // (1000 * tf + 12 * m)), with m = 100 - 25 + 25 * n * N // L and w = floor(1000 * ln((2N + 2) / (2df + 1)))
in doubles; N documents with a term, L all terms, n the document's, df documents that hold the term, tf its occurrences.

Defined results: null or empty texts, and texts without terms, are in no count and never found; an item without terms,
or whose terms stand nowhere, has no rows. Rows that repeat an item_id, null included, are one item with the terms of all.
Rows that repeat a doc_id are documents of their own; a null doc_id comes before all others in ties. Fewer than k rows are
all there are. Terms that more than half the documents hold still count, by their small weight; scores of 0 are left out.
Empty tables give an empty result; other columns, whatever their names, play no part. A very long text is one document in one shard.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonlake.llm.common import small_batches, written
from codonlake.llm.kernels import ALNUM, LOWERED

K = 20
#: A shard ends with the document that reaches one of these: bytes of text, postings.
SHARD_BYTES = 8 << 20
SHARD_POSTINGS = 1 << 19
#: (item, term) pairs that are searched at a time.
BLOCK_TERMS = 200_000
#: Nodes that are opened at a time.
NODES = 32

#: Bytes of terms, lower-cased; all others become spaces.
TERM_BYTES = bytes(LOWERED[b] if ALNUM[LOWERED[b]] else 32 for b in range(256))
SHARD = "docs int, postings int, all_docs long, all_terms long, nulls int, doc_ids binary, terms binary, counts binary, impacts binary, bits binary"


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = held = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n = len(terms(text)) if text else 0
            docs, held = docs + (n > 0), held + n
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [held]})


# ---- index
def levels(docs: int) -> int:
    return max(1, (docs - 1).bit_length())


class Shard:
    """Documents on their way into a shard: their ids, and (term, document, occurrences) of each posting."""

    def __init__(self, all_docs: int, all_terms: int):
        self.all_docs, self.all_terms = all_docs, all_terms
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.term, self.tf, self.held = [], [], []
        self.bytes = self.postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms(text)
        if not found:
            return
        counts = Counter(found)
        self.term.append(np.fromiter(map(self.number.__getitem__, counts), np.int64, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.held.append(len(counts))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.bytes += len(text)
        self.postings += len(counts)

    def full(self, most_bytes: int, most_postings: int) -> bool:
        return self.bytes >= most_bytes or self.postings >= most_postings

    def batch(self) -> pa.RecordBatch:
        nulls = sum(x is None for x in self.ids)
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)
        by_id = np.lexsort((ids, np.array([x is not None for x in self.ids])))
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        names = list(self.number)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        renamed = np.empty(len(names), np.int64)
        renamed[by_name] = np.arange(len(names))
        doc = np.repeat(place, self.held)
        term, tf = renamed[np.concatenate(self.term)], np.concatenate(self.tf)
        m = 75 + 25 * np.array(self.lengths, np.int64) * self.all_docs // self.all_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, self.held))
        order = np.lexsort((doc, -impact, term))
        sequence, bits = doc[order], []
        for shift in reversed(range(levels(len(ids)))):
            bit = sequence >> shift & 1 == 1
            bits.append(np.packbits(bit, bitorder="little"))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        values = {
            "docs": len(ids), "postings": len(term), "all_docs": self.all_docs, "all_terms": self.all_terms, "nulls": nulls, "doc_ids": ids[by_id].tobytes(), "terms": b" ".join(names[i] for i in by_name),
            "counts": np.bincount(term, minlength=len(names)).astype("<u4").tobytes(), "impacts": impact[order].astype("<u4").tobytes(), "bits": np.concatenate(bits).tobytes(),
        }
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values.values(), SHARD_TYPES, strict=True)], names=list(values))


SHARD_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SHARD.split(", ")]


def _builder(all_docs: int, all_terms: int, *most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(all_docs, all_terms)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, text or b"")
                if shard.full(*most):
                    yield shard.batch()
                    shard = Shard(all_docs, all_terms)
        if shard.ids:
            yield shard.batch()

    return run


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Shards of all documents, written to the shared folder; each row is self-contained."""
    sent = small_batches(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")))
    totals = sent.select("text").mapInArrow(_totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return written(sent.mapInArrow(_builder(totals[0] or 0, totals[1] or 1, shard_bytes, shard_postings), SHARD), "lexical")


# ---- search
class Tree:
    """A shard as it is searched: rank over the bits of each level, and the impacts in each level's order."""

    def __init__(self, row: dict):
        self.nulls, n = row["nulls"], row["postings"]
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.levels = levels(row["docs"])
        packed = np.frombuffer(row["bits"], np.uint8).reshape(self.levels, -1)
        words = -(-(n + 1) // 64)
        padded = np.zeros((self.levels, words * 8), np.uint8)
        padded[:, : packed.shape[1]] = packed
        self.words = padded.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones, axis=1) - ones
        self.zeros = n - ones.sum(axis=1)
        self.impacts = np.empty((self.levels + 1, n), np.int64)
        self.impacts[0] = np.frombuffer(row["impacts"], "<u4")
        for i in range(self.levels):
            bit = np.unpackbits(packed[i], count=n, bitorder="little").view(bool)
            z = self.zeros[i]
            self.impacts[i + 1, :z], self.impacts[i + 1, z:] = self.impacts[i, ~bit], self.impacts[i, bit]
        self.start = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], "<u4").astype(np.int64))])
        self.number = {t: i for i, t in enumerate(row["terms"].split(b" "))}

    def ones(self, level: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ones before a place of a level."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[level, word] + np.bitwise_count(self.words[level, word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def tie(self, doc_id: int | None) -> int:
        """The first document that does not come before doc_id."""
        return 0 if doc_id is None else self.nulls + int(np.searchsorted(self.ids[self.nulls :], doc_id))

    def best(self, query: list[tuple[bytes, int]], k: int, least: tuple[int, int]) -> list[tuple[int, int]]:
        """(score, document) of up to k best documents of a query; least: (score, document) from which on none is wanted."""
        own = [(i, w) for t, w in query if w > 0 and (i := self.number.get(t)) is not None]
        if not own:
            return []
        term, w = np.array(own, np.int64).T
        lo, hi = self.start[term], self.start[term + 1]
        found: list[tuple[int, int]] = []  # a heap of (score, -document), the worst first
        queue = [(-int((w * self.impacts[0, lo]).sum()), 0, 0, 0, lo, hi, w)]
        number = itertools.count(1)

        def wanted(bound: int, doc: int) -> bool:
            """Whether a document from doc on, with a score of at most bound, could be one of the k."""
            return (bound, -doc) > (least[0], -least[1]) and (len(found) < k or (bound, -doc) > found[0])

        while queue:
            nodes = []
            while queue and len(nodes) < NODES and wanted(-queue[0][0], queue[0][1]):
                nodes.append(heapq.heappop(queue))
            if not nodes:
                break
            sizes = [len(x[4]) for x in nodes]
            level = np.repeat([x[3] for x in nodes], sizes)
            lo, hi, w = (np.concatenate([x[i] for x in nodes]) for i in (4, 5, 6))
            owner = np.repeat(np.arange(len(nodes)), sizes)
            low, high = self.ones(level, lo), self.ones(level, hi)
            for bit in (0, 1):
                a, b = (self.zeros[level] + low, self.zeros[level] + high) if bit else (lo - low, hi - high)
                live = np.flatnonzero(b > a)
                if not len(live):
                    continue
                node, a, b, own_w = owner[live], a[live], b[live], w[live]
                first = np.flatnonzero(np.diff(node, prepend=-1))
                bounds = np.add.reduceat(own_w * self.impacts[level[live] + 1, a], first)
                for i, x, y, bound in zip(node[first].tolist(), first.tolist(), [*first[1:].tolist(), len(live)], bounds.tolist(), strict=True):
                    depth = nodes[i][3] + 1
                    doc = nodes[i][1] + (bit << (self.levels - depth))
                    if not wanted(bound, doc):
                        continue
                    if depth < self.levels:
                        heapq.heappush(queue, (-bound, doc, next(number), depth, a[x:y], b[x:y], own_w[x:y]))
                    elif len(found) < k:
                        heapq.heappush(found, (bound, -doc))
                    else:
                        heapq.heapreplace(found, (bound, -doc))
        return [(s, -d) for s, d in found]


def _frequencies(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()
        for batch in batches:
            for names, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = np.frombuffer(counts, "<u4")
                df.update({t: int(held[i]) for i, t in enumerate(names.split(b" ")) if t in sent.value})
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(df), pa.binary()), "df": pa.array(list(df.values()), pa.int64())})

    return run


def _searcher(sent, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = defaultdict(list)  # (-score, has an id, id), the best first
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                for item, query in enumerate(sent.value):
                    own, least = best[item], (0, -1)
                    if len(own) == k:
                        least = (-own[-1][0], tree.tie(own[-1][2] if own[-1][1] else None))
                    found = tree.best(query, k, least)
                    if found:
                        new = [(-s, d >= tree.nulls, int(tree.ids[d]) if d >= tree.nulls else 0) for s, d in found]
                        best[item] = sorted(own + new)[:k]
        rows = [(item, i if has else None, -s) for item, own in best.items() for s, has, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place, term, held = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            counts = Counter(terms(text or b""))
            place += [i] * len(counts)
            term += counts
            held += counts.values()
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(term, pa.binary()), pa.array(held, pa.int64())], names=["item_id", "term", "held"])


def search(shards: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of the shards for each item."""
    spark = shards.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    sent = small_batches(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text")))
    asked = written(sent.mapInArrow(_item_terms, f"item_id {kind}, term binary, held long").groupBy("item_id", "term").agg(F.sum("held").alias("held")), "items")
    pairs, docs = asked.count(), shards.agg(F.max("all_docs")).first()[0] or 0
    blocks = -(-pairs // block_terms)
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(max(blocks, 1)))
    found = None
    for b in range(blocks):
        rows = asked.filter(block == b).orderBy("item_id", "term").collect()  # about block_terms rows
        vocabulary = spark.sparkContext.broadcast({bytes(r["term"]) for r in rows})
        df = shards.select("terms", "counts").mapInArrow(_frequencies(vocabulary), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weights = {bytes(r["term"]): weight(docs, r["df"]) for r in df}
        own = [(i, [(bytes(r["term"]), r["held"] * weights[bytes(r["term"])]) for r in group if bytes(r["term"]) in weights]) for i, group in itertools.groupby(rows, lambda r: r["item_id"])]
        queries = spark.sparkContext.broadcast([q for _, q in own])
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(own)], f"item int, item_id {kind}")
        top = shards.mapInArrow(_searcher(queries, k), "item int, doc_id long, score long")
        top = best_of(top, "item", k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: a row an item of the block
        top = written(top, "ranked") if blocks > 1 else top
        found = top if found is None else found.unionByName(top)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def best_of(rows: DataFrame, key: str, k: int) -> DataFrame:
    """rank and the rows of the k best of each key; each task limits its own before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc, t, count(*) AS tf FROM (SELECT doc, unnest(ws) AS t FROM d) GROUP BY ALL),
c AS (SELECT count(*) AS docs, sum(len(ws)) AS terms FROM d WHERE len(ws) > 0),
m AS (SELECT doc, doc_id, 75 + (25 * len(ws) * docs) // terms AS m FROM d, c WHERE len(ws) > 0),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, docs),
q AS (SELECT item_id, t, count(*) AS held FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc, any_value(doc_id) AS doc_id, CAST(sum(held * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (doc) GROUP BY item_id, doc)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
