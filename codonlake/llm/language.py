"""Language identification of whole, possibly mixed texts.

Script ranges narrow each word's candidate languages to those that were seen to write its script; hashed character
trigrams score the word for each candidate; a Viterbi pass with a penalty for each switch labels every word, so spans of
another language inside a text are found and single odd words are not. A text's language is the one whose words hold the
most letters' bytes.

The trigram counts are learned from at most `train_rows` labelled texts a language (those with the smallest hashes of
their ids and labels), of which whole texts are read.

Defined results: null text, or text without any letter: `und`, score 0; nothing to learn from: every text `und`; labels
and ids that are null teach nothing; words without letters take part in no span; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonlake.llm import kernels as K
from codonlake.llm.common import small_batches

TRAIN_ROWS = 1500
SWITCH = 4.0
BUCKETS = 1 << 16
#: Bytes of text whose documents take the Viterbi steps together.
STEP = 4 << 20

#: First code points of script ranges and the script that begins there (0 other, 1 Latin, 2 Greek,
#: 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 7 Devanagari and other Indic, 8 Thai, 9 Georgian, 10 Hangul, 11 Kana, 12 Han)
RANGES = (
    (0x0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0),
    (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x250, 1), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6),
    (0x780, 0), (0x900, 7), (0xE00, 8), (0xE80, 0), (0x10A0, 9), (0x1100, 10), (0x1200, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 11), (0x3100, 0), (0x3400, 12), (0xA000, 0), (0xAC00, 10), (0xD7B0, 0),
)
SCRIPTS = 13
_EDGES = np.array([r[0] for r in RANGES])
_SCRIPT = np.array([r[1] for r in RANGES], np.uint8)
_WORD = np.zeros(256, bool)  # bytes that can stand in a word: letters A-Z, a-z and all beyond ASCII
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _lead_script() -> np.ndarray:
    """Script of each two-byte UTF-8 start by code point, for the vectorised lookup."""
    return _SCRIPT[np.searchsorted(_EDGES, np.arange(0x10000), "right") - 1]


_SCRIPT_OF = _lead_script()


def word_scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word's first character."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    b = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2 = b[starts], b[starts + 1] & 63, b[starts + 2] & 63
    point = np.where(b0 < 128, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, 0x2000)))
    return _SCRIPT_OF[point]


def trigram_buckets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the bucket of it and its two neighbours in its text; what is no letter, or outside, is one and the same byte."""
    x = np.where(_WORD[data], K.LOWERED[data], 0).astype(np.uint32)
    left, right = np.zeros_like(x), np.zeros_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    left[offsets[:-1][offsets[:-1] < len(data)]] = 0
    right[offsets[1:][offsets[1:] > 0] - 1] = 0
    return ((left * np.uint32(0x9E3779B1) ^ x * np.uint32(0x85EBCA6B) ^ right * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        """counts: (languages, BUCKETS) trigrams; scripts: (languages, SCRIPTS) words."""
        self.languages = languages
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed = share >= 0.001
        allowed[:, ~allowed.any(0)] = True  # a script that no language writes narrows nothing
        self.bar = np.where(allowed, 0.0, -50.0).astype(np.float32).T.copy()

    def scores(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, languages) log scores of the words' trigrams, with the bar of the script on top."""
        buckets = trigram_buckets(data, offsets)
        out = np.empty((len(starts), len(self.languages)), np.float32)
        cuts = np.empty(2 * len(starts), np.int64)
        cuts[0::2], cuts[1::2] = starts, ends
        if len(cuts) and cuts[-1] == len(data):
            cuts = cuts[:-1]
        for i in range(len(self.languages)):
            out[:, i] = np.add.reduceat(self.logs[i][buckets], cuts)[0::2] if len(cuts) else 0
        return out + self.bar[word_scripts(data, starts)]

    def spans(self, scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
        """The label of each word on its document's best path; documents go in step, longest first."""
        n, width = len(scores), len(self.languages)
        path = np.zeros(n, np.int16)
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return path
        begin, left = first[:-1][order], lengths[order]
        best = scores[begin].astype(np.float64)
        came = np.zeros((n, width), np.int16)
        active_at = np.searchsorted(-left, -np.arange(left[0]), "left")  # documents longer than t words
        for t in range(1, int(left[0])):
            m = int(active_at[t])
            b = best[:m]
            top = b.argmax(1)
            jump = b[np.arange(m), top] - switch
            stay = b >= jump[:, None]
            at = begin[:m] + t
            came[at] = np.where(stay, np.arange(width), top[:, None])
            best[:m] = np.where(stay, b, jump[:, None]) + scores[at]
        state = best.argmax(1)
        for t in range(int(left[0]) - 1, -1, -1):
            m = int(active_at[t])
            at = begin[:m] + t
            path[at] = state[:m]
            if t:
                state[:m] = came[at, state[:m]]
        return path


COUNTED = "lang string, script int, bucket int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams and words' scripts by label; script -1 with a bucket, or bucket -1 with a script."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for b in batches:
        labels = b.column(0).to_pylist()
        for lo, hi, data, offsets in K.text_steps(b.column(1)):
            starts, ends, first = K.words(data, offsets, _WORD)
            kind = word_scripts(data, starts)
            buckets = trigram_buckets(data, offsets)
            inside = _WORD[data]
            for i in range(hi - lo):
                lang = labels[lo + i]
                if lang not in grams:
                    grams[lang], scripts[lang] = np.zeros(BUCKETS, np.int64), np.zeros(SCRIPTS, np.int64)
                part = slice(offsets[i], offsets[i + 1])
                grams[lang] += np.bincount(buckets[part][inside[part]], minlength=BUCKETS)
                scripts[lang] += np.bincount(kind[first[i] : first[i + 1]], minlength=SCRIPTS)
    for lang in grams:
        g, s = np.flatnonzero(grams[lang]), np.flatnonzero(scripts[lang])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(g) + len(s)), pa.string()), pa.array(np.concatenate([np.full(len(g), -1), s]).astype(np.int32)), pa.array(np.concatenate([g, np.full(len(s), -1)]).astype(np.int32)), pa.array(np.concatenate([grams[lang][g], scripts[lang][s]]))],
            names=["lang", "script", "bucket", "n"],
        )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model of at most train_rows texts of each label; what reaches the driver is a table of counts of fixed size a label."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    labelled = own.select("id", "lang", F.xxhash64("id", "lang").alias("turn"))
    totals = labelled.groupBy("lang").agg(F.count("*").alias("rows")).collect()  # one row a label
    if not totals:
        return None
    # the smallest hashes of each label: a share of the hash range that holds a few more rows than wanted, then ranked
    share = F.create_map(*[x for r in totals for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * train_rows / r["rows"] + 1e-9)))])
    near = labelled.filter((F.pmod("turn", F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")]).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("turn", F.lit(1 << 30)), "id"))
    ids = near.withColumn("rank", rank).filter(F.col("rank") <= train_rows).select("id", "lang")
    # at most train_rows ids a label: small by its bound
    chosen = own.join(F.broadcast(ids), ["id", "lang"]).select("lang", "text")
    rows = chosen.mapInArrow(_count, COUNTED).groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    counts, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), SCRIPTS))
    for r in rows:
        if r["bucket"] >= 0:
            counts[place[r["lang"]], r["bucket"]] = r["n"]
        else:
            scripts[place[r["lang"]], r["script"]] = r["n"]
    return Model(languages, counts, scripts) if languages else None


PREDICTED = [("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())]


def _predict(shared, text_at: int, switch: float, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for b in batches:
            for lo, hi, data, offsets in K.text_steps(b.column(text_at), STEP):
                langs, scores, spans = ["und"] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, np.int64)
                if model is not None:
                    starts, ends, first = K.words(data, offsets, _WORD)
                    path = model.spans(model.scores(data, offsets, starts, ends), first, switch)
                    weight = ends - starts
                    texts = b.column(text_at).slice(lo, hi - lo)
                    ascii_letters = np.concatenate([[0], np.cumsum(_WORD[data] & (data < 128))])
                    for i in range(hi - lo):
                        a, z = first[i], first[i + 1]
                        if a == z:
                            continue
                        if ascii_letters[offsets[i + 1]] == ascii_letters[offsets[i]] and not any(map(str.isalpha, texts[i].as_py())):
                            continue
                        held = np.bincount(path[a:z], weights=weight[a:z], minlength=len(model.languages))
                        best = int(held.argmax())
                        langs[i], scores[i] = model.languages[best], held[best] / held.sum()
                        spans[i] = 1 + np.count_nonzero(np.diff(path[a:z]))
                own = [pa.array(langs, pa.string()), pa.array(scores), pa.array(spans)]
                rest = [i for i in range(b.num_columns) if keep_text or i != text_at]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in rest), *own], names=[*(b.schema.names[i] for i in rest), *(n for n, _ in PREDICTED)])

    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", switch: float = SWITCH, keep_text: bool = False) -> DataFrame:
    """The columns of docs (the text only with keep_text), and lang_pred, score (share of letters' bytes on its spans), n_spans.

    A column of docs that bears one of those three names is left out.
    """
    docs = docs.drop(*[c for c, _ in PREDICTED if c != text_col])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language
    others = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["lang_pred string, score double, n_spans long"])
    return small_batches(docs).mapInArrow(_predict(shared, docs.columns.index(text_col), switch, keep_text), ddl)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang replaced by the prediction, without the texts in which no language is found; columns as they were."""
    model = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    found = predict(docs.toDF(*names), model, names[docs.columns.index(text_col)], keep_text=True).filter("lang_pred <> 'und'")
    return found.select([F.col("lang_pred" if c == lang_col else n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
