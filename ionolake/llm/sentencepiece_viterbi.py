"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The model file is a public one, read by its path; scores are the file's own. A text is escaped as the file says (spaces become U+2581, one
before the text; a character map and the dropping of extra spaces apply first, where the file has them). The automaton runs over it once; at each position it reports the pieces that end there (the state's piece and those of its
output links, longest first), and each relaxes the best score of the position by that of its start plus the piece's. A character that no piece
covers is worth the lowest score minus 10 and becomes its UTF-8 byte pieces, or the unknown piece in a model without them. Equal scores keep the longest last piece.

No piece of such a model crosses from a word into the next one's U+2581, so the best path of a text is the best paths of its words in a row. Words
repeat, so each task keeps the paths of the words that it has met (at most CACHE_WORDS, then it starts anew). A model with pieces across
words is encoded whole texts at a time.

Decoding joins pieces and bytes, undoes the escape and drops the leading space. It gives back the text, unless the text itself has
U+2581 (decoded as a space), or the model maps characters, drops spaces or has no byte pieces, as round_trip says.

Cases: null text has null ids and 0 tokens, empty text no ids; repeated rows are encoded alike; a text or word is never cut, however long (some 40 bytes of memory a character of the longest word); an empty table gives no
rows; extra columns are ignored or kept.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_WORDS = 400_000
#: Characters from which on a word's scores are kept in packed arrays.
LONG = 10_000
UNKNOWN_PENALTY = 10.0
_SPACE = "▁"
_NONE = float("-inf")
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
#: What an unknown piece is decoded as.
_UNKNOWN_TEXT = " \u2047 ".encode()


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


def read_model(raw: bytes) -> dict:
    """Pieces (text, score, type) in order of id, and of the normaliser whether it sets a space before the text, drops extra spaces, and what it maps, of a SentencePiece model file."""
    pieces, prefix, squeeze, mapped = [], True, True, {}
    for number, value in _fields(raw):
        if number == 1:
            p = {1: b"", 2: struct.pack("<f", 0), 3: _NORMAL} | dict(_fields(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0], p[3]))
        elif number == 3:
            spec = dict(_fields(value))
            prefix, squeeze, mapped = bool(spec.get(3, 1)), bool(spec.get(4, 1)), character_map(spec.get(2) or b"")
    if sum(kind == _BYTE for _, _, kind in pieces) not in (0, 256):
        raise ValueError("the model has some byte pieces, but not all")
    return {"pieces": pieces, "prefix": prefix, "squeeze": squeeze, "map": mapped}


def character_map(raw: bytes) -> dict[str, str]:
    """What a model's compiled character map replaces: a double-array trie of UTF-8 strings, whose values are places in a block of texts that each end in a zero byte."""
    if not raw:
        return {}
    size = struct.unpack("<I", raw[:4])[0]
    unit, texts = np.frombuffer(raw[4 : 4 + size], np.uint32).astype(np.int64), raw[4 + size :]
    offset = lambda u: int((u >> 10) << ((u & 512) >> 6))
    out, nodes, every = {}, [(b"", offset(unit[0]))], np.arange(1, 256)
    while nodes:
        key, base = nodes.pop()
        at = base ^ every
        at, label = at[at < len(unit)], every[at < len(unit)]
        for c, u, place in zip(*(x[(unit[at] & (1 << 31 | 255)) == label].tolist() for x in (label, unit[at], at)), strict=True):
            below = place ^ offset(u)
            if u >> 8 & 1:
                value = int(unit[below]) & (1 << 31) - 1
                out[(key + bytes([c])).decode("utf-8", "surrogateescape")] = texts[value : texts.index(b"\0", value)].decode()
            nodes.append((key + bytes([c]), below))
    return out


class Codec:
    """Encoder and decoder of one model; made once in each Python worker."""

    def __init__(self, model: dict) -> None:
        import ahocorasick

        self.prefix, self.squeeze, self.map = model["prefix"], model["squeeze"], model["map"]
        # from a character that begins a mapped string on, the longest such string
        by_first: dict[str, list[str]] = {}
        for key in sorted(self.map, key=len, reverse=True):
            by_first.setdefault(key[0], []).append(key)
        self.by_first, self.first = by_first, re.compile("[" + "".join(map(re.escape, by_first)) + "]") if by_first else None
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.unk = next((i for i, (_, _, kind) in enumerate(model["pieces"]) if kind == _UNKNOWN), 0)
        self.has_bytes = any(kind == _BYTE for _, _, kind in model["pieces"])
        usable = [(i, t, s) for i, (t, s, kind) in enumerate(model["pieces"]) if kind in (_NORMAL, _USER) and t]
        for i, t, s in usable:
            self.automaton.add_word(t, (len(t), s, i))
        self.automaton.make_automaton()
        self.unknown = min(s for _, _, s in usable) - UNKNOWN_PENALTY
        for i, (t, _, kind) in enumerate(model["pieces"]):
            if kind == _BYTE:
                value = int(t[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            else:
                self.bytes_of.append(t.replace(_SPACE, " ").encode() if kind in (_NORMAL, _USER) else _UNKNOWN_TEXT if kind == _UNKNOWN else b"")
        self.single = {t for _, t, _ in usable if len(t) == 1}
        text = set().union(*(t for _, t, _ in usable))
        # where no piece reaches over: before a run of U+2581, and around line ends that are in no piece
        hard = "".join(c for c in "\n\r\t" if c not in text)
        self.units = re.compile(f"{_SPACE}+[^{_SPACE}{hard}]*|[^{_SPACE}{hard}]+" + (f"|[{hard}]" if hard else ""))
        self.by_word = not any(re.search(f"[^{_SPACE}]{_SPACE}", t) for _, t, _ in usable)
        self.cache: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path over an escaped text."""
        n = len(text)
        if n < LONG:
            best, start, last = [0.0] + [_NONE] * n, [0] * (n + 1), [-1] * (n + 1)
        else:  # a fifth of the memory, a little slower
            best, start, last = array("d", [_NONE]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
            best[0] = 0.0
        if self.single.issuperset(text):
            for end, (length, score, piece) in self.automaton.iter(text):
                end += 1
                total = best[end - length] + score
                if total > best[end]:
                    best[end], start[end], last[end] = total, end - length, piece
        else:
            done = 0  # positions up to here have their best score

            def as_bytes(upto: int) -> None:
                nonlocal done
                while done < upto:
                    done += 1
                    if text[done - 1] not in self.single and best[done - 1] + self.unknown > best[done]:
                        best[done], start[done], last[done] = best[done - 1] + self.unknown, done - 1, -1

            for end, (length, score, piece) in self.automaton.iter(text):
                end += 1
                as_bytes(end - 1)
                total = best[end - length] + score
                if total > best[end]:
                    best[end], start[end], last[end] = total, end - length, piece
            as_bytes(n)
        out: list[int] = []
        at = end = n
        while at:
            if last[at] < 0:
                if self.has_bytes:
                    out.extend(self.byte_ids[b] for b in reversed(text[start[at] : at].encode()))
                elif not out or out[-1] != self.unk or last[end] >= 0:
                    out.append(self.unk)  # unknown characters in a row are one piece
            else:
                out.append(last[at])
            end, at = at, start[at]
        return out[::-1]

    def normal(self, text: str) -> str:
        """The text as the model's normaliser leaves it."""
        if self.first:
            out, at = [], 0
            while m := self.first.search(text, at):
                key = next((k for k in self.by_first[m[0]] if text.startswith(k, m.start())), None)
                out += [text[at : m.start()], m[0] if key is None else self.map[key]]
                at = m.start() + len(key or m[0])
            text = "".join([*out, text[at:]])
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text

    def encode(self, text: str) -> bytes:
        """Ids as int32 bytes."""
        if self.first or self.squeeze:
            text = self.normal(text)
        if not text:
            return b""
        escaped = (_SPACE if self.prefix else "") + text.replace(" ", _SPACE)
        if not self.by_word:
            return np.array(self.viterbi(escaped), np.int32).tobytes()
        cache, out = self.cache, []
        # each word with the run of U+2581 before it
        for word in self.units.findall(escaped):
            ids = cache.get(word)
            if ids is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                ids = np.array(self.viterbi(word), np.int32).tobytes()
                if len(word) <= 64:
                    cache[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids.tolist()])
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_codecs: list[tuple[dict, Codec]] = []


def _codec(shared) -> Codec:
    """The codec of a broadcast model: each Python worker keeps the last one."""
    model = shared.value
    if not _codecs or _codecs[0][0] is not model:
        _codecs[:] = [(model, Codec(model))]
    return _codecs[0][1]


def load(spark, path: str = DEFAULT_MODEL):
    """The model at that path, as a broadcast: a vocabulary file, of a size that doesn't depend on the data. Spark's own readers read it, from any store they can reach."""
    if "://" in path:
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as f:
            raw = f.read()
    return spark.sparkContext.broadcast(read_model(raw))


def encode_column(model):
    """A pandas UDF from text to ids."""

    @F.pandas_udf("array<int>")
    def encode(texts):
        import pandas as pd

        codec = _codec(model)
        return pd.Series([None if t is None else np.frombuffer(codec.encode(t), np.int32) for t in texts])

    return encode


def decode_column(model):
    """A pandas UDF from ids to text."""

    @F.pandas_udf("string")
    def decode(ids):
        import pandas as pd

        codec = _codec(model)
        return pd.Series([None if x is None else codec.decode(np.asarray(x)) for x in ids])

    return decode


def encode_documents(docs: DataFrame, model=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes (byte pieces among them), ids_hash, round_trip, and the columns to keep: a row for each row of docs."""
    shared = model or load(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        is_byte = np.zeros(len(codec.bytes_of), np.int64)
        is_byte[codec.byte_ids] = 1
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else np.frombuffer(codec.encode(t), np.int32) for t in texts]
                some = [np.zeros(0, np.int32) if x is None else x for x in ids]
                h = [int(np.bitwise_xor.reduce(mix((x.astype(np.uint64) + np.uint64(1)) * (mix(np.arange(len(x), dtype=np.uint64)) | np.uint64(1))))) if len(x) else 0 for x in some]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": pa.array([len(x) for x in some], pa.int64()), "n_bytes": pa.array([int(is_byte[x].sum()) for x in some], pa.int64()),
                    "ids_hash": pa.array(np.array(h, np.uint64).view(np.int64)), "round_trip": pa.array([None if t is None else codec.decode(x) == t for t, x in zip(texts, some, strict=True)], pa.bool_()),
                    **{c: part.column(2 + i) for i, c in enumerate(keep)},
                })

    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, n_bytes long, ids_hash long, round_trip boolean" + more)
