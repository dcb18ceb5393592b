"""Cost-balanced packing of documents into training sequences of at most CAPACITY tokens, without padding.

A document is its token ids and one end id. What a sequence costs is estimated as the sum over its pieces of length + QUADRATIC * length^2: work that grows with the tokens, and attention within a piece. Documents
are packed in groups of about GROUP tokens. Of a document as long as a sequence or longer, whole sequences are cut off. The rest goes, longest first, to the sequence of lowest cost that has room for it; a group has as
many sequences as its tokens fill. What finds no room is cut and fills what is left of them, the roomiest first, so every sequence is full. Less than one sequence's tokens remain: they join the next group.

Plan: a task encodes its documents and packs them as they come; no text and no ids are shuffled, but for the less than CAPACITY tokens that each task ends with. Those are packed in the same way, FAN tasks' rests at a time,
and what these leave again, until one group is left. Its last tokens make sequences whose lengths are different powers of two, which need no padding, so the corpus has none. Rests are written before they are packed on:
a lost executor repeats a task's own share. Which documents share a sequence depends on how Spark deals out the rows.

Encoding: ids are those of the tokenizer for the whole text. Its pattern never matches blanks and always parts ASCII letters or digits from `.,;:!?`, so a text is cut there into units, and each different unit is encoded
once while a worker keeps it in its table (begun anew when it holds CACHE units); units are compared by their bytes. The strings of special tokens in a text become those tokens, as the tokenizer does by itself.

Cases: a null or empty text is its end id alone; rows that repeat a doc_id are documents of their own, each with its own pieces; a null doc_id is kept; a text of any length is encoded whole (more than SEGMENT bytes in
segments, cut at blanks, so memory grows by its ids only); equal lengths are taken in order of arrival, equal costs go to the earlier sequence; without documents there are no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialise, mix, row_of, spans, string_buffer

CAPACITY = 4096
#: Cost of a token pair within a piece, where a token costs 1: a layer of width 1024 does 6 * 1024 as much for a token as for a pair.
QUADRATIC = 1 / 6144
#: Fixed value: the id that ends a document.
END = 2
GROUP = 1 << 21
FAN = 256
CACHE = 700_000
SEGMENT = 1 << 21
#: Bytes of a unit that are compared as numbers; longer units one by one.
_SHORT = 24

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
#: Units of these letters alone stand for themselves but for their case: one run of letters, and in no two forms.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def load(spark: SparkSession, path: str | None = None):
    """The tokenizer's file as a broadcast (a few MB, whatever the data)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if "://" in path:
        return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class Encoder:
    """ids() of whole texts, unit by unit."""

    def __init__(self, file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_buffer(file)
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, list[int]] = {}

    def _learn(self, units: list[bytes]) -> list[list[int]]:
        """The ids of each unit."""
        if len(self.known) > CACHE:
            self._forget()
        known, merges, spelling, rest = self.known, self.tokenizer.model.tokenize, self.spelling, []
        for u in units:
            if u not in known:
                if u.isalpha():  # ASCII letters, which spell themselves
                    known[u] = [t.id for t in merges(u.lower().decode())]
                elif _LETTERS(text := u.decode()):
                    known[u] = [t.id for t in merges(text.lower().translate(spelling))]
                else:
                    rest.append((u, text))
        if rest:
            for (u, _), e in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
                known[u] = e.ids
        return [known[u] for u in units]

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk of texts, and where each text's begin."""
        starts, ends = spans(data, offs, ~_BLANK)
        if len(data):
            a, b = data[:-1], data[1:]
            cut = np.flatnonzero((_ALNUM[a] & _STOP[b]) | (_STOP[a] & _ALNUM[b])) + 1
            cut = cut[~np.isin(cut, offs, assume_unique=True)] if len(cut) else cut  # a text's end cuts already
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        n, size = len(starts), ends - starts
        padded = np.concatenate([data, np.zeros(_SHORT + 8, np.uint8)])
        at = np.ndarray(len(data) + _SHORT + 1, np.uint64, padded.data, 0, (1,))  # the eight bytes from each place on
        part = [at[np.minimum(starts + 8 * j, len(data) + _SHORT)] & _KEEP[np.clip(size - 8 * j, 0, 8)] for j in range(_SHORT // 8)]
        hashed = size.astype(np.uint64)
        for p in part:
            hashed = mix((hashed ^ p) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(hashed)
        same = self._same(order, hashed, size, part)
        if same is None:  # two units of one hash
            order = np.lexsort((size, *part))
            same = self._same(order, None, size, part)
        first = np.flatnonzero(~same)
        raw = data.tobytes()
        found = self._learn([raw[i:j] for i, j in zip(starts[order[first]].tolist(), ends[order[first]].tolist(), strict=True)])
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))
        which = np.empty(n, np.int64)
        which[order] = np.cumsum(~same) - 1
        count, begin = length[which], (np.cumsum(length) - length)[which]
        total = np.cumsum(count)
        out = flat[np.repeat(begin - (total - count), count) + np.arange(total[-1] if n else 0)]
        bounds = np.concatenate([[0], total])[np.searchsorted(row_of(offs, starts), np.arange(len(offs)))]
        return out, bounds

    @staticmethod
    def _same(order: np.ndarray, hashed: np.ndarray | None, size: np.ndarray, part: list[np.ndarray]) -> np.ndarray | None:
        """Whether each unit in order equals the one before it; None if the hashes have it that two are equal which aren't. Long units count as different."""
        equal = np.zeros(len(order), bool)
        s = size[order]
        equal[1:] = (s[1:] == s[:-1]) & (s[1:] <= _SHORT)
        for p in part:
            x = p[order]
            equal[1:] &= x[1:] == x[:-1]
        if hashed is not None:
            h = hashed[order]
            if ((h[1:] == h[:-1]) & ~equal[1:] & (s[1:] <= _SHORT)).any():
                return None
        return equal

    def documents(self, col: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, with the end id."""
        end = np.array([END], np.uint32)
        for lo, hi, data, offs in chunks(*string_buffer(col), SEGMENT):
            if hi - lo == 1 and len(data) > 2 * SEGMENT:
                parts, at = [], 0
                while at < len(data):
                    cut = _blank_from(data, at + SEGMENT)
                    parts.append(self.ids(data[at:cut], np.array([0, cut - at]))[0])
                    at = cut
                yield np.concatenate([*parts, end])
                continue
            ids, bounds = self.ids(data, offs)
            for i in range(hi - lo):
                yield np.concatenate([ids[bounds[i] : bounds[i + 1]], end])


_encoders: list[tuple[bytes, Encoder]] = []


def _encoder(file: bytes) -> Encoder:
    """A Python worker keeps the last one, and its table, for the tasks to come."""
    if not _encoders or _encoders[0][0] != file:
        _encoders[:] = [(file, Encoder(file))]
    return _encoders[0][1]


def _blank_from(data: np.ndarray, at: int) -> int:
    step = 256
    while at < len(data):
        hit = np.flatnonzero(_BLANK[data[at : at + step]])
        if len(hit):
            return at + int(hit[0])
        at, step = at + step, step * 2
    return len(data)


def cost(length):
    return length + QUADRATIC * length * length


#: A piece: doc_id, place of its first id in the document, the document's ids, and its own ids.
Piece = tuple[int | None, int, int, np.ndarray]


class Packer:
    """Packs groups of pieces; rows(): what has been placed; rest: what is left for the next group."""

    def __init__(self, first_sequence: int) -> None:
        self.next = first_sequence
        self.rest: list[Piece] = []
        self.placed: list[tuple] = []

    def _put(self, piece: Piece, sequence: int, offset: int) -> None:
        doc, start, total, ids = piece
        self.placed.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

    def pack(self, pieces: list[Piece], close: bool = False) -> None:
        """Places the rest of the last group and these pieces; close: the rest as well, in sequences of powers of two."""
        todo: list[Piece] = []
        for doc, start, total, ids in [*self.rest, *pieces]:
            whole = len(ids) // CAPACITY * CAPACITY
            for k in range(0, whole, CAPACITY):
                self._put((doc, start + k, total, ids[k : k + CAPACITY]), self.next, 0)
                self.next += 1
            if whole < len(ids):
                todo.append((doc, start + whole, total, ids[whole:]))
        todo.sort(key=lambda p: -len(p[3]))
        tokens = sum(len(p[3]) for p in todo)
        sizes = [CAPACITY] * (tokens // CAPACITY)
        if close:
            sizes += [1 << b for b in reversed(range(CAPACITY.bit_length() - 1)) if tokens % CAPACITY >> b & 1]
        size = np.array(sizes, np.int64)
        room, spent = size.copy(), np.zeros(len(size))
        left: list[Piece] = []

        def place(piece: Piece, s: int) -> None:
            self._put(piece, self.next + s, int(size[s] - room[s]))
            room[s] -= len(piece[3])
            spent[s] += cost(len(piece[3]))

        for piece in todo:
            fits = np.where(room >= len(piece[3]), spent, np.inf)
            s = int(fits.argmin()) if len(fits) else -1
            if s >= 0 and np.isfinite(fits[s]):
                place(piece, s)
            else:
                left.append(piece)
        open_ = [int(s) for s in np.argsort(-room, kind="stable") if room[s]]
        while open_:
            doc, start, total, ids = left.pop(0)
            s = open_[0]
            n = min(len(ids), int(room[s]))
            place((doc, start, total, ids[:n]), s)
            if n < len(ids):
                left.insert(0, (doc, start + n, total, ids[n:]))
            if not room[s]:
                open_.pop(0)
        self.next += len(size)
        self.rest = left

    def rows(self, slot: int, last: bool) -> pa.RecordBatch:
        """The placed pieces, and, if last, the rest with its ids under this slot."""
        placed, self.placed = self.placed, []
        cols: list[list] = [list(c) for c in zip(*placed, strict=True)] if placed else [[] for _ in range(7)]
        ids: list[bytes | None] = [None] * len(placed)
        for doc, start, total, own in self.rest if last else []:
            for c, x in zip(cols, (doc, start, len(own), None, total, None, None), strict=True):
                c.append(x)
            ids.append(own.astype("<u4").tobytes())
        arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array([slot if x is not None else None for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "slot", "ids"]
_ROWS = ", ".join(f"{n} long" for n in _NAMES[:-1]) + ", ids binary"


def _sequences_of(level: int, slot: int) -> int:
    """The first sequence number of a task: 2^32 for each, 2^24 tasks a level."""
    return level << 56 | slot << 32


def pack_documents(docs: DataFrame, tokenizer=None) -> DataFrame:
    """A row for each piece: doc_id, start (its document's ids before it), length, ids_crc32 (of its ids as little-endian 32-bit numbers), doc_tokens, sequence_id, offset (in its sequence, without gaps from 0).
    tokenizer: load()'s; the public one of 49k words without."""
    spark = docs.sparkSession
    tokenizer = tokenizer or load(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        encoder, packer = _encoder(tokenizer.value), Packer(_sequences_of(0, slot))
        held, tokens = [], 0
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), encoder.documents(b.column(1)), strict=True):
                held.append((doc, 0, len(ids), ids))
                tokens += len(ids)
                if tokens >= GROUP:
                    packer.pack(held)
                    yield packer.rows(slot, False)
                    held, tokens = [], 0
        packer.pack(held)
        yield packer.rows(slot, True)

    def pack_on(level: int, close: bool):
        def on(key: tuple, t: pa.Table) -> pa.Table:
            slot = key[0].as_py()
            t = t.sort_by([("slot", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
            packer = Packer(_sequences_of(level, slot))
            packer.pack([(d, s, n, np.frombuffer(x, "<u4")) for d, s, n, x in zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True)], close)
            return pa.Table.from_batches([packer.rows(slot, True)])

        return on

    found = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(pack, _ROWS), "packed0")
    out, level = found.where("ids is null"), 0
    while True:
        rest = found.where("ids is not null")
        most = rest.agg(F.max("slot")).first()[0]
        if most is None:
            return out.drop("slot", "ids")
        level, close = level + 1, most < FAN
        found = materialise(rest.groupBy(F.floor(F.col("slot") / FAN).alias("group")).applyInArrow(pack_on(level, close), _ROWS), f"packed{level}")
        out = out.unionByName(found.where("ids is null"))
