"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are paragraphs (between empty lines); a block matches a template when it holds at least THRESHOLD of the
template's distinct words. Words are ordered by how often they occur in the whole corpus, rarest first. To reach the
threshold a block must hold one of the first |T| - need + 1 words of that order (prefix filter) and have at least `need`
distinct words (length filter). The prefix index says for each such word which templates begin with it and at which
place; of a template whose first word in the block stands at place i, no more than |T| - i words can be there, so it is
given up if that is below `need`, and likewise at each later word that the block lacks (positional filter). What passes
is counted in full, so every matching block is found. The templates are a parameter, and their index goes to the tasks.

Defined results: null counts as empty; a text without words has no labels and score 0; rows that repeat an id are rows
of their own; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm import kernels as K
from codonlake.llm.common import small_batches
from codonlake.llm.decontaminate import hashed, split

#: Phrases and labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Opening sentences and notices of well-known licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "This work is licensed under a Creative Commons Attribution International License"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("gpl-line", "This work is licensed under the GNU General Public License, version 3."),
    ("mit-notice", "Released under the MIT License."),
    ("no-warranty", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
)
THRESHOLD = 0.8


def need_of(n: int, threshold: float) -> int:
    return max(1, int(np.ceil(threshold * n - 1e-9)))


class Ordered:
    """Templates with their words in the global order, and the index of their prefixes."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], counts: dict[bytes, int], threshold: float) -> None:
        self.templates: list[tuple[str, list[bytes], int]] = []
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}  # word -> (template, its place in the order)
        for label, words in templates:
            own = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
            if not own:
                continue  # a template without words matches nothing
            need = need_of(len(own), threshold)
            for i, w in enumerate(own[: len(own) - need + 1]):
                self.prefixes.setdefault(w, []).append((len(self.templates), i))
            self.templates.append((label, own, need))
        self.hashes = np.sort(hashed(list(self.prefixes)))

    def matches(self, block: set[bytes]) -> dict[str, float]:
        """Labels of the templates of which the block holds enough, and the share of their words that it holds."""
        first: dict[int, int] = {}
        for w in self.prefixes.keys() & block:
            for at, i in self.prefixes[w]:
                first[at] = min(i, first.get(at, i))
        out: dict[str, float] = {}
        for at, i in first.items():
            label, own, need = self.templates[at]
            left = len(own) - i
            if len(block) < need or left < need:
                continue
            for w in own[i:]:
                if w not in block:
                    left -= 1
                    if left < need:
                        break
            else:
                out[label] = max(left / len(own), out.get(label, 0.0))
        return out


def _counted(vocabulary: list[bytes]):
    h = hashed(vocabulary)
    order = np.argsort(h)
    ranked = h[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(h), np.int64)
        for b in batches:
            for _, _, raw, offsets in K.text_steps(b.column(0)):
                data = K.LOWERED[raw]
                starts, ends, _ = K.words(data, offsets, K.ALNUM)
                own = K.word_hashes(data, starts, ends)
                place = np.minimum(np.searchsorted(ranked, own), len(h) - 1)
                counts += np.bincount(order[place[ranked[place] == own]], minlength=len(h))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(h))), pa.array(counts)], names=["word", "n"])

    return run


def ordered(docs: DataFrame, text_col: str, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> Ordered:
    """The templates ordered by their words' frequencies in all texts; a row a template word reaches the driver."""
    parts = [(label, split(text)) for label, text in templates]
    vocabulary = sorted({w for _, words in parts for w in words})
    rows = docs.select(text_col).mapInArrow(_counted(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect() if vocabulary else []
    return Ordered(parts, {vocabulary[r["word"]]: r["n"] for r in rows}, threshold)


_EMPTY_LINE = re.compile(rb"\n[ \t\r]*\n")
FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def _scanned(order: Ordered):
    phrases = [(label, split(text)) for text, label in PHRASES]
    phrase_hashes = [(label, words, hashed(words)) for label, words in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in K.text_steps(b.column(1)):
                data = K.LOWERED[raw]
                starts, ends, first = K.words(data, offsets, K.ALNUM)
                own = K.word_hashes(data, starts, ends)
                places: dict[int, list] = {}
                for label, words, h in phrase_hashes:
                    n = len(h)
                    if len(own) < n:
                        continue
                    hit = np.ones(len(own) - n + 1, bool)
                    for i in range(n):
                        hit &= own[i : len(own) - n + 1 + i] == h[i]
                    at = np.flatnonzero(hit)
                    doc = np.searchsorted(first, at, "right") - 1
                    for d, a in zip(doc.tolist(), at.tolist(), strict=True):
                        if a + n <= first[d + 1] and [data[x:y].tobytes() for x, y in zip(starts[a : a + n], ends[a : a + n], strict=True)] == words:
                            places.setdefault(d, []).append((a - int(first[d]), label))
                where = np.searchsorted(order.hashes, own)
                where[where == len(order.hashes)] = 0
                near = np.unique(np.searchsorted(first, np.flatnonzero(order.hashes[where] == own), "right") - 1) if len(order.hashes) else ()
                matched: dict[int, dict[str, float]] = {}
                blocks: dict[int, int] = {}
                for d in map(int, near):
                    for block in _EMPTY_LINE.split(data[offsets[d] : offsets[d + 1]].tobytes()):
                        best = order.matches(set(split(block.decode(errors="replace"))))
                        if best:
                            blocks[d] = blocks.get(d, 0) + 1
                            mine = matched.setdefault(d, {})
                            for label, c in best.items():
                                mine[label] = max(c, mine.get(label, 0.0))
                cols: list[list] = [[] for _ in range(8)]
                for d in range(hi - lo):
                    base = places.get(d, ())
                    labels = {x[1] for x in base}
                    more = matched.get(d, {})
                    at = [x[0] for x in base]
                    values = (
                        int(first[d + 1] - first[d]), len(at), min(at) if at else None, max(at) if at else None, ",".join(sorted(labels)),
                        ",".join(sorted(labels | set(more))), 1.0 if labels else max(more.values(), default=0.0), blocks.get(d, 0),
                    )
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks) of every row."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scanned(ordered(rows, "text", templates, threshold)), f"id {kind}, {FOUND}").withColumnRenamed("id", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _oracle() -> str:
    words = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    sql_list = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, text, {words.format("text")} AS ws FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, CASE WHEN ws[i:i + 1] = ['cc', 'by'] THEN 'cc-by' WHEN ws[i:i + 2] = ['general', 'public', 'license'] THEN 'gpl' WHEN ws[i:i + 2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE list_has_any(ws, ['cc', 'general', 'all']))),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p WHERE label IS NOT NULL GROUP BY doc_id),
t AS (SELECT label, list_distinct({words.format("text")}) AS tw FROM (VALUES {sql_list}) AS v(label, text)),
k AS (SELECT doc_id, list_distinct({words.format("block")}) AS bw FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n')) AS block FROM d)),
m AS (SELECT doc_id, label, max(len(list_intersect(bw, tw)) / len(tw)) AS c FROM k, t WHERE len(list_intersect(bw, tw)) >= ceil({THRESHOLD} * len(tw) - 1e-9) GROUP BY doc_id, label),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM p WHERE label IS NOT NULL) GROUP BY doc_id),
s AS (SELECT doc_id, max(c) AS c FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""


ORACLE = _oracle()
