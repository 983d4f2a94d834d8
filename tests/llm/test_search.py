"""Ranked search, hard negatives and pieces against plain definitions, on rows that hold nulls, ties, copies and odd values."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from codonlake.llm import lexical, negatives, pieces
from codonlake.llm.lexical import Shard, Tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("doc", "term", "score", "rank", "item", "held", "group", "pivot", "distance", "vector", "id")})


# ---- 11
def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    found = [(i, d, Counter(terms_of(t))) for i, (d, t) in enumerate(docs)]
    found = [(i, d, c, sum(c.values())) for i, d, c in found if c]
    n_all, length = len(found), sum(x[3] for x in found)
    df = Counter(t for _, _, c, _ in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = set()
    for item, query in asked.items():
        rows = []
        for _, d, c, n in found:
            m = 100 - 25 + 25 * n * n_all // length
            score = sum(held * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, held in query.items() if t in c)
            if score > 0:
                rows.append((-score, d is not None, d or 0))
        out |= {(item, r, d if has else None, -s) for r, (s, has, d) in enumerate(sorted(rows)[:k], 1)}
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = "alpha beta Gamma delta x7 über été niño 中文 zwei drei rare".split()
    docs = [(rng.randrange(-50, 200), " ".join(rng.choices(words, [9, 8, 7, 6, 5, 4, 3, 3, 2, 2, 2, 1], k=rng.randrange(1, 30)))) for _ in range(n)]
    docs += [(1000 + i, "Gamma, delta; x7-x7!") for i in range(n // 2)]  # a third are copies
    docs += [(None, "beta x7"), (None, None), (7, ""), (8, "?! ..."), (9, "rare " * 4000), (9, "rare"), docs[0], docs[0]]
    items = [(1, "alpha beta"), (2, "x7 x7 gamma delta"), (3, "rare RARE unknown"), (4, None), (None, "zwei"), (None, "drei drei"), (5, "nothing here"), (6, "中文 über"), (2, "beta"), (7, "")]
    return docs, items


@pytest.mark.parametrize(("shard", "block", "k"), [(40, 3, 5), (10**6, 10**6, 20), (1, 10**6, 1)])
def test_search_ranks_as_the_definition_does(spark, shard, block, k):
    docs, items = corpus(shard)
    shards = lexical.index(clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), shard_postings=shard)
    out = lexical.search(shards, clashing(spark.createDataFrame(items, "item_id long, text string")), k, block_terms=block).collect()
    got = [tuple(r) for r in out]
    assert len(got) == len(set(got)) and set(got) == ranked(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    some = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    for d, i in ((docs, some), (some.withColumnRenamed("item_id", "doc_id"), items), (docs, items), (spark.createDataFrame([(1, None)], docs.schema), some)):
        out = lexical.search(lexical.index(d), i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_trees_open_few_nodes_and_find_the_best(monkeypatch):
    rng = np.random.default_rng(2)
    shard = Shard(1000, 40_000)
    for i in rng.permutation(1000).tolist():
        shard.add(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.5, 40) if x < 500).encode() + b" base")
    row = shard.batch().to_pylist()[0]
    tree, opened = Tree(row), []
    rank = Tree.ones
    monkeypatch.setattr(Tree, "ones", lambda self, level, place: opened.append(len(level)) or rank(self, level, place))
    held = np.frombuffer(row["counts"], "<u4")
    assert held.sum() == row["postings"] and len(tree.number) == len(held)
    for query in ([(b"t1", 3), (b"t2", 5), (b"t40", 90)], [(b"base", 1)], [(b"t9", 7), (b"absent", 5)], [(b"t3", 0)]):
        every = tree.best(query, 2000, (0, -1))
        opened.clear()
        for k in (1, 7):
            assert sorted(tree.best(query, k, (0, -1)), key=lambda x: (-x[0], x[1])) == sorted(every, key=lambda x: (-x[0], x[1]))[:k]
        assert sum(opened) < 4 * sum(int(held[tree.number[t]]) for t, w in query if w and t in tree.number) or not every


def test_of_equal_documents_few_are_opened(monkeypatch):
    shard, opened = Shard(4096, 8192), []
    for i in range(4096):
        shard.add(i, b"same words")
    tree, rank = Tree(shard.batch().to_pylist()[0]), Tree.ones
    monkeypatch.setattr(Tree, "ones", lambda self, level, place: opened.append(len(level)) or rank(self, level, place))
    assert sorted(d for _, d in tree.best([(b"same", 2), (b"words", 3)], 20, (0, -1))) == list(range(20))
    assert sum(opened) < 4096


# ---- 12
def mined(rows, every=100, per=5):
    part = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) > negatives.MOST for x in v):
            continue
        part.append((i, math.fmod(label + 1, 10) if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, label, q in part:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, other == label) for i, other, v in part if i != a)
        for s, positive, _ in [x for x in scored if x[2]][:per]:
            fit = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:per]
            out += [(a, positive, r, i, -s, -n) for r, (n, i, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n=400):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, 12))
    rows = []
    for i in range(n):
        v = (centre[rng.integers(6)] + rng.standard_normal(12)).astype(np.float32)
        rows.append((i - 20, (v / np.linalg.norm(v)).tolist(), int(rng.integers(4))))
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(n // 2)]  # a third are copies, of two labels
    rows += [(5000, None, 1), (5001, rows[0][1], None), (None, rows[0][1], 1), (5002, [math.nan] * 12, 1), (5003, [math.inf] + [0.0] * 11, 1), (5004, [None] + [0.1] * 11, 1), (5005, [1e9] * 12, 1)]
    rows += [(5100, [], 1), (5200, rows[5][1][:5], 2), (5300, rows[5][1] + [3.0, -2.0], 2), (5400, [0.0] * 12, 3), (5500, [60_000.0] * 12, 1), (5501, [-60_000.0] * 12, 2), rows[100], rows[100], rows[120], (100, rows[9][1], 2)]
    return rows


@pytest.mark.parametrize(("cell", "block", "every"), [(7, 10**6, 20), (64, 4, 50), (2048, 10**6, 100)])
def test_negatives_as_the_definition_has_them(spark, cell, block, every):
    rows = vectors(cell)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5))
    got = sorted(tuple(r) for r in negatives.mined(df, every, block, cell).collect())
    assert got == mined([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows], every)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    alone = spark.createDataFrame([(100, [0.5], 1), (3, [0.5], 2), (5, None, 1)], empty.schema)
    for df in (empty, alone, alone.filter("vec_id = 5"), alone.filter("vec_id = 3")):
        out = negatives.mined(df)
        assert out.count() == 0 and out.columns == [c.split()[0] for c in negatives.RESULT.split(", ")]


def test_cells_hold_all_rows_and_intervals_bound_scores(spark):
    rng = np.random.default_rng(5)
    data = [(i, (x / np.linalg.norm(x)).tolist(), 1) for i, x in enumerate(rng.standard_normal((3000, 8)) + 2 * rng.standard_normal((5, 8))[rng.integers(5, size=3000)])]
    cells, pivots = negatives.index(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), cell_rows=50)
    rows = cells.collect()
    assert sorted(i for r in rows for i in np.frombuffer(r["ids"], "<i8").tolist()) == list(range(3000))
    anchors = negatives.matrix([np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist() for _, v, _ in data[:40]])
    ids = np.arange(40)
    skipped = 0
    for r in rows:
        own = np.frombuffer(r["vectors"], "<i4").reshape(-1, r["dims"]).astype(np.int64)
        scores = negatives.products(anchors, own)
        floor = np.full(40, 45_000)
        touched = set()
        for home in (True, False):
            wanted = negatives.Wanted(ids, np.ones(40, int), anchors, pivots, ids, floor, np.full(40, 2**62), True, home)
            touched |= set(wanted.touched(r["pivot"], r["least"], r["most"]).tolist())
        assert set(np.flatnonzero((scores >= 45_000).any(1)).tolist()) <= touched
        skipped += 40 - len(touched)
    assert skipped > 10 * len(rows)  # a quarter of all visits and more are left out


def test_products_beyond_doubles():
    a, b = np.full((2, 3), 2**24 - 1), np.array([[2**24 - 1, 2**24, 1], [-(2**24), 5, 7]])
    a = np.tile(a, 80)
    b = np.tile(b, 80)
    assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]


# ---- 13
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def model_bytes():
    with open(MODEL, "rb") as f:
        return f.read()


def number(n):
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def with_field(data, field, value):
    """data with a sub-message in the place of its own."""
    keep = bytearray()
    for f, v in pieces.fields(data):
        if f != field:
            keep += number(f << 3 | 2) + number(len(v)) + v
    return bytes(keep) + number(field << 3 | 2) + number(len(value)) + value


def odd_texts():
    rng = random.Random(6)
    some = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "é", "中", "\U0001f600", "<s>", "<0x41>", ".", "\x00", "the", "ing ", "ﬁ", "①", "ｱﾞ", "　", "\xa0", "​", "\xad", "Å", "한", "x" * 60, "\x07"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(1500)]
    return ["", " ", "  ", "▁", " a", "a ", "\n", "ab" * 3000, "é" * 500, " " * 300, "\U0001f600" * 70, *texts]


def spans_of(library, text):
    at = list(itertools.accumulate((len(c.encode()) for c in text), initial=0))
    return [(at[a], at[b]) for a, b in library.encode_as_offset_mapping(text)["offsets"]]


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf", "identity"])
def test_pieces_are_those_of_the_library(rule):
    data = model_bytes()
    if rule:
        data = with_field(data, pieces.NORMALIZER, sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Model(data)
    texts = odd_texts()
    for text, (ids, spans) in zip(texts, own.encoded([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text
        assert own.decoded(ids) == library.decode(want), text
        assert [tuple(s) for s in spans[1:-1].tolist()] == spans_of(library, text), text


def test_any_ids_are_decoded_as_the_library_does():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Model(model_bytes()), random.Random(3)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), 0, 1, 2, 259, 28705]) for _ in range(rng.randrange(7))]
        assert own.decoded(np.array(ids, int)) == library.decode(ids), ids


def test_what_is_remembered_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Model(model_bytes())
    for text in odd_texts()[:300]:
        assert next(own.encoded([text.encode()]))[0].tolist() == library.encode(text, add_bos=True, add_eos=True)
    long = "".join(random.Random(1).choices("abcdefgh the\n", k=20_000))
    monkeypatch.setattr(pieces, "SHORT", 3)
    assert next(own.encoded([long.encode()]))[0].tolist() == library.encode(long, add_bos=True, add_eos=True)


def test_other_models_are_refused(tmp_path, spark):
    trainer = dict(pieces.fields(model_bytes()))[pieces.TRAINER]
    changed = trainer.replace(number(3 << 3) + number(2), number(3 << 3) + number(1), 1)
    with pytest.raises(ValueError, match="only BPE"):
        pieces.Model(with_field(model_bytes(), pieces.TRAINER, changed))


def test_encoded_tables(spark):
    texts = [None, "", "a  b", "a  b", "\U0001f600 é\n" * 5, "word " * 30_000]
    df = spark.createDataFrame([(i if i else None, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, other int").repartition(2)
    out = pieces.encoded(df, MODEL)
    assert out.columns == ["doc_id", "text", "other", "n_tokens", "ids", "spans", "decoded"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, want = rows[i if i else None], library.encode(t or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) == (len(want), want, library.decode(want))
        spans = np.frombuffer(r["spans"], "<u4").reshape(-1, 2)
        assert b"".join((t or "").encode()[a:b] for a, b in spans[1:-1].tolist()) == (t or "").encode()
    assert pieces.encoded(df.limit(0), MODEL).count() == 0
    clash = pieces.encoded(df.withColumnRenamed("text", "decoded"), MODEL, "decoded")
    assert clash.columns == ["doc_id", "other", "n_tokens", "ids", "spans", "decoded"] and clash.count() == len(texts)


def test_query_of_pieces_is_the_library_on_the_whole_table(spark, sf):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
