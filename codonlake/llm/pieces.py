"""SentencePiece encoding and decoding that keeps, for every piece, the bytes of the original text it stands for.

A model file (BPE) is read once on the driver and sent to the tasks; nothing is trained. In a task, per text:

1. Normalisation. At each place the longest prefix that the model's compiled character map holds is replaced; what no
   prefix covers is copied, character by character. Next to the normalised bytes an alignment is recorded: the original
   byte at which the source of each normalised byte begins.
2. Segmentation. The best-scored pair of neighbours that is a piece is merged, the leftmost of equals, until none is
   left. Two characters that stand together in no piece of the vocabulary can never be merged across, so a text falls
   into parts there, each of which is segmented alone and remembered; the result is the same as for the whole.
3. Projection. Piece lengths, summed up, give places in the normalised text, and the alignment gives those of the
   original. A character that is no piece becomes one piece a byte; the last of these bears its whole span.

Decoding takes ids alone: pieces are joined, runs of byte pieces read as UTF-8, the marked space of the start left out.

Defined results: a null or empty text has the begin and end ids only, and decodes to an empty text; ids are binary,
unsigned 32-bit little-endian, and spans are pairs of such numbers (begin, end), in bytes of the text, one pair an id; the
begin id spans (0, 0) and the end id (n, n). Rows that repeat are each encoded. An empty table gives an empty one. A very
long text is one value in one task. Other columns stay; those named as the results are replaced by them.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import operator
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codonlake.llm.common import small_batches

RESULT = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "spans": T.BinaryType(), "decoded": T.StringType()}
#: Model files beyond this are not sent to the tasks (known ones have less than 5 MB).
MODEL_BYTES = 64 << 20
#: Segmented parts that a task remembers, and the length up to which one is worth it.
REMEMBERED = 400_000
SHORT = 48
NONE = 1 << 40

#: Numbers of fields, kinds of pieces and the marked space of the public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
SPACE = "▁"
SPACE_BYTES = SPACE.encode()


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of a protocol buffer's fields."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        match key & 7:
            case 0:
                value, at = number(at)
            case 1:
                value, at = data[at : at + 8], at + 8
            case 2:
                size, at = number(at)
                value, at = data[at : at + size], at + size
            case 5:
                value, at = struct.unpack_from("<f", data, at)[0], at + 4
            case other:
                raise ValueError(f"no such kind of field: {other}")
        yield key >> 3, value


def _gathered(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs that begin at start and hold count entries each, and where each run begins (and the last ends)."""
    before = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(start - before[:-1], count) + np.arange(int(before[-1])), before


class CharacterMap:
    """The compiled map of a model: a double array of prefixes, and the replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.texts = compiled[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of data[at:] and that prefix's length."""
        units, found = self.units, None
        place = self._first(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units) or units[place] & 0x800000FF != data[i]:
                break
            unit = units[place]
            place ^= self._first(unit)
            if unit >> 8 & 1:
                found = units[place] & 0x7FFFFFFF, i + 1 - at
        return None if found is None else (self.texts[found[0] : self.texts.index(0, found[0])], found[1])

    @staticmethod
    def _first(unit: int) -> int:
        """The exclusive-or distance to the node's children."""
        return unit >> 10 << ((unit & 0x200) >> 6)


class Model:
    """A BPE model: normalised(), segmented(), encoded() and decoded()."""

    def __init__(self, data: bytes):
        pieces, trainer, spec = [], {}, {}
        for field, value in fields(data):
            if field == PIECES:
                p = dict(fields(value))
                pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif field == TRAINER:
                trainer = dict(fields(value))
            elif field == NORMALIZER:
                spec = dict(fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3, 1) != BPE or kinds & {USER_DEFINED, UNUSED} or trainer.get(24, 0):
            raise ValueError("only BPE models without user-defined or unused pieces, spaces first, are known here")
        self.pieces = pieces
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        self.space = SPACE_BYTES if self.escape else b" "
        normal = {p: (i, s) for i, (p, s, k) in enumerate(pieces) if k == NORMAL}
        places = {s: i for i, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        self.id = {p: i for p, (i, _) in normal.items()}
        self.rank = {p: places[s] for p, (_, s) in normal.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.fallback = bool(trainer.get(35, 0)) and len(self.byte) == 256
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.controls = {i for i, (_, _, k) in enumerate(pieces) if k == CONTROL}
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.pairs = {x + y for p in normal for x, y in itertools.pairwise(p)}
        self._tables()
        #: Whether every space begins a part: no piece holds one behind another character.
        self.parted = self.escape and not any(SPACE in p.lstrip(SPACE) for p in normal)
        self.part = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        unknown = trainer.get(44, " ⁇ ".encode()).decode()
        shown = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), CONTROL: lambda p: b"", UNKNOWN: lambda p: unknown.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.shown = [shown[k](p) for p, _, k in pieces]
        self._forget()

    def _tables(self) -> None:
        """Symbols (pieces, and characters that only stand inside pieces) by character, and what each two make."""
        names = [*self.id, *sorted({c for p in self.id for c in p} - self.id.keys())]
        number = {x: i for i, x in enumerate(names)}
        self.symbol = -np.arange(0x110000)
        single = [(ord(x), i) for x, i in number.items() if len(x) == 1]
        self.symbol[[c for c, _ in single]] = [i for _, i in single]
        if 0 not in [c for c, _ in single]:
            self.symbol[0] = -0x110000
        made = sorted((number[p[:i]] << 32 | number[p[i:]], self.rank[p], number[p]) for p in self.id for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.pair_keys, self.pair_rank, self.pair_into = np.array(made or [(-1, NONE, 0)], np.int64).T.copy()
        own = [(np.array([self.id[x]]), np.array([len(x.encode())])) if x in self.id else self._bytes_of(x) for x in names]
        self.count = np.array([len(x) for x, _ in own], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.ids, self.lengths = (np.concatenate(x) for x in zip(*own, strict=True))

    # ---- normalisation
    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each (and for the end) the original byte where its source begins."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.map or self.squeeze:
            return self._mapped(text)
        lead = len(self.space) if self.dummy else 0
        sizes = np.where(np.frombuffer(text, np.uint8) == 32, len(self.space), 1)
        source = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(text)), sizes), [len(text)]])
        return (self.space if self.dummy else b"") + text.replace(b" ", self.space), source

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The same through the character map, with runs of spaces squeezed if the model asks for it."""
        def shown(at: int) -> tuple[bytes, int]:
            return (self.map.longest(text, at) if self.map else None) or self._character(text, at)

        out, source, at, spaced = bytearray(), [], 0, self.squeeze
        while self.squeeze and at < len(text) and (first := shown(at))[0] == b" ":
            at += first[1]
        if at == len(text):
            return b"", np.array([at])
        if self.dummy:
            out += self.space
            source += [at] * len(self.space)
        while at < len(text):
            new, size = shown(at)
            if spaced:
                new = new.lstrip(b" ")
            for c in new:
                own = self.space if c == 32 else bytes([c])
                out += own
                source += [at] * len(own)
            if new:
                spaced = self.squeeze and new.endswith(b" ")
            at += size
        end = len(text)
        while self.squeeze and out.endswith(self.space):
            end = source[len(out) - len(self.space)]
            del out[len(out) - len(self.space) :], source[len(out) :]
        return bytes(out), np.array([*source, end], np.int64)

    @staticmethod
    def _character(text: bytes, at: int) -> tuple[bytes, int]:
        """The character that begins at a place; a byte that begins none is replaced."""
        first = text[at]
        size = 1 if first < 128 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
        try:
            return (own := text[at : at + max(size, 1)]).decode().encode() if size else b"\xef\xbf\xbd", max(size, 1) if size == 0 else len(own)
        except UnicodeDecodeError:
            return b"\xef\xbf\xbd", 1

    # ---- segmentation
    def parts(self, text: str) -> list[str]:
        """The normalised text cut where no piece of the vocabulary can stand across."""
        return self.part.findall(text) if self.parted else [text] if text else []

    def segmented(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text ids and their lengths in normalised bytes; new parts of all texts are segmented at once."""
        parts = [self.parts(t) for t in texts]
        once = set().union(*parts)
        new = once.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = once
        self._learn(new)
        held = np.cumsum([0, *map(len, parts)])
        part = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(held[-1]))
        at, before = _gathered(self.part_start[part], np.diff(self.part_start)[part])
        ids, lengths = self.part_ids[at], self.part_lengths[at]
        for a, b in itertools.pairwise(before[held].tolist()):
            yield ids[a:b], lengths[a:b]

    def _forget(self) -> None:
        """Parts that have been met: their numbers, and where each one's ids and lengths begin."""
        self.known: dict[str, int] = {}
        self.part_start, self.part_ids, self.part_lengths = np.zeros(1, np.int64), np.zeros(0, "<u4"), np.zeros(0, "<u4")

    def _learn(self, new: set[str]) -> None:
        """Segments parts; those that are long are cut further, and what stays long is merged with a queue."""
        long = {p: self._cuts(p) for p in new if len(p) > SHORT}
        short = list(set(new).difference(long).union(c for own in long.values() for c in own if len(c) <= SHORT) - self.known.keys())
        self._keep(short, *self._merged(short))
        for part, own in long.items():
            found = [self._part(c) if len(c) <= SHORT else self._merged_long(c) for c in own]
            ids, lengths = (np.concatenate(x) for x in zip(*found, strict=True))
            self._keep([part], np.array([len(ids)]), ids, lengths)

    def _keep(self, parts: list[str], counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.part_start = np.concatenate([self.part_start, self.part_start[-1] + np.cumsum(counts)])
        self.part_ids = np.concatenate([self.part_ids, ids.astype("<u4")])
        self.part_lengths = np.concatenate([self.part_lengths, lengths.astype("<u4")])

    def _part(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.part_start[self.known[part] :][:2]
        return self.part_ids[a:b], self.part_lengths[a:b]

    def _cuts(self, part: str) -> list[str]:
        pairs, cuts, at = self.pairs, [], 0
        for i, pair in enumerate(map(operator.add, part, part[1:]), 1):
            if pair not in pairs:
                cuts.append(part[at:i])
                at = i
        return [*cuts, part[at:]]

    def _merged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each text has, all ids and their lengths: in every round each text merges its best pair, the leftmost of equals."""
        symbol = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        odd = np.flatnonzero(symbol < 0)
        others, place = np.unique(-symbol[odd] % 0x110000, return_inverse=True)  # characters of no piece
        symbol[odd] = len(self.start) + place
        held = np.fromiter(map(len, texts), np.int64, len(texts))
        text = np.repeat(np.arange(len(texts)), held)
        rank, into = self._pair(symbol, text)
        done = []
        while len(text):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            size = np.diff(first, append=len(text))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            over = best == NONE
            if over.any():
                done.append((text[over], symbol[over]))
                text, symbol, rank, into, best = (x[~over] for x in (text, symbol, rank, into, best))
            hit = np.flatnonzero(rank == best)
            hit = hit[np.diff(text[hit], prepend=-1) != 0]
            symbol[hit] = into[hit]
            stay = np.ones(len(text), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay)[hit] - 1
            text, symbol, rank, into = (x[stay] for x in (text, symbol, rank, into))
            for i in (place, place[place > 0] - 1):
                two = np.minimum(i + 1, len(text) - 1)
                rank[i], into[i] = self._ranks(symbol[i], symbol[two], (text[i] == text[two]) & (two > i))
        text, symbol = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*done, strict=True) if done else ((), ())))
        order = np.argsort(text, kind="stable")
        text, symbol = text[order], symbol[order]
        own = [self._bytes_of(chr(c)) for c in others.tolist()]
        sizes = np.array([len(x) for x, _ in own], np.int64)
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        count = np.concatenate([self.count, sizes])[symbol]
        ids, lengths = np.concatenate([self.ids, *(x for x, _ in own)]), np.concatenate([self.lengths, *(y for _, y in own)])
        at, _ = _gathered(start[symbol], count)
        return np.bincount(text, count, len(texts)).astype(np.int64), ids[at], lengths[at]

    def _pair(self, symbol: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._ranks(symbol, np.append(symbol[1:], 0), np.diff(text, append=-1) == 0)

    def _ranks(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of the piece that two neighbours make; NONE if they make none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = together & (self.pair_keys[at] == key)
        return np.where(found, self.pair_rank[at], NONE), self.pair_into[at]

    def _bytes_of(self, character: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of a character that is no piece: a piece a byte, the last bears its length; or the unknown piece."""
        own = character.encode()
        if not self.fallback:
            return np.array([self.unknown]), np.array([len(own)])
        return np.array([self.byte[x] for x in own]), np.array([0] * (len(own) - 1) + [len(own)])

    def _merged_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of one text of any length, with a queue of its pairs."""
        rank, symbols = self.rank, list(text)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue = [(rank[x + y], i, i + 1, x + y) for i, (x, y) in enumerate(itertools.pairwise(text)) if x + y in rank]
        heapq.heapify(queue)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            k = after[i] = after[j]
            if k < len(text):
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < len(text) and (new := symbols[a] + symbols[b]) in rank:
                    heapq.heappush(queue, (rank[new], a, b, new))
        found = [((self.id[x],), (len(x.encode()),)) if x in self.id else self._bytes_of(x) for x in symbols if x is not None]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    # ---- both ways
    def encoded(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, begin and end included, and the (begin, end) bytes of the original text of each."""
        normal = [self.normalised(t) for t in texts]
        for text, (_, source), (ids, sizes) in zip(texts, normal, self.segmented([t.decode() for t, _ in normal]), strict=True):
            if not self.fallback:
                ids, sizes = self._united(ids, sizes)
            ends = np.cumsum(sizes, dtype=np.int64)
            begins = source[ends - sizes]
            spans = np.zeros((len(ids) + 2, 2), "<u4")
            spans[1:-1, 0] = begins
            spans[1:-1, 1] = np.where(sizes > 0, source[ends], begins)
            spans[-1] = len(text)
            yield np.concatenate([[self.begin], ids, [self.end]]).astype("<u4"), spans

    def _united(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without byte pieces, neighbouring unknown characters are one piece."""
        if not len(ids):
            return ids, sizes
        first = np.flatnonzero(~((ids[1:] == self.unknown) & (ids[:-1] == self.unknown))) + 1
        first = np.concatenate([[0], first])
        return ids[first], np.add.reduceat(sizes, first)

    def decoded(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, one each."""
        own = ids.tolist()
        shown = list(map(self.shown.__getitem__, own))
        if self.dummy or self.squeeze:
            for i, x in enumerate(own):  # the space of the start: of the first piece that shows anything
                kind = self.pieces[x][2]
                if kind == NORMAL and shown[i].startswith(b" "):
                    shown[i] = shown[i][1:]
                    if not shown[i] and self.squeeze:
                        continue
                if kind != CONTROL:
                    break
        try:
            if self.controls.isdisjoint(own[1:-1]):  # one between bytes parts them
                return b"".join(shown).decode()
        except UnicodeDecodeError:
            pass
        return "".join(self._runs(own, shown))

    def _runs(self, ids: list[int], shown: list[bytes]) -> Iterator[str]:
        for byte, run in itertools.groupby(zip(ids, shown, strict=True), lambda x: self.pieces[x[0]][2] == BYTE):
            data, at = b"".join(s for _, s in run), 0
            if not byte:
                yield data.decode()
            while byte and at < len(data):
                own, size = self._character(data, at)
                yield own.decode()
                at += size


@functools.lru_cache(maxsize=2)
def model(data: bytes) -> Model:
    """The model of a file's bytes; one a Python worker."""
    return Model(data)


def _encoder(sent, place: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(sent.value)
        for batch in batches:
            sizes, ids, spans, texts = [], [], [], []
            for one, span in own.encoded([x or b"" for x in batch.column(place).to_pylist()]):
                sizes.append(len(one))
                ids.append(one.tobytes())
                spans.append(span.tobytes())
                texts.append(own.decoded(one))
            new = [pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(spans, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != place), *new], names=names)

    return run


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids, spans and decoded of its text column, by the model file at `path` (read on the driver)."""
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"the model file has more than {MODEL_BYTES} bytes")
    model(data)  # what cannot be read fails here
    kept = [c for c in df.columns if c not in RESULT]
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("binary").alias("text"))
    schema = T.StructType([*(T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)), *(T.StructField(c, t) for c, t in RESULT.items())])
    out = small_batches(plain).mapInArrow(_encoder(df.sparkSession.sparkContext.broadcast(data), len(kept), schema.names), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))
