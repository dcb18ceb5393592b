"""Token counts by offset-mapped attribution: each document is encoded once as a whole, and its tokens are dealt to the document's fields or sections.

The encoder is a byte-level BPE whose ids have a fixed byte length each, so the ids' running length sum gives every token's span in the document's bytes. Sections are
spans of the same bytes. Both are sorted, so the interval join is one binary search of all token ends among all section ends.

A token that crosses a border is allotted by the rule given:
- "start": to the section that holds its first byte (whole tokens; the counts add up to the document's tokens);
- "majority": to the section that holds most of its bytes, the earlier one in a tie (adds up too);
- "split": in parts, by bytes (the parts add up to the document's tokens, up to rounding).
`crossing` counts the tokens that reach from a section into a later one, by where they start.

A document's sections are its lines (the line end belongs to the line before it), or the fields given, joined by one line end each.

Cases: null or empty text has one section of 0 tokens (number 0, span 0 to 0); repeated rows are counted alike, each by itself; a null doc_id is kept; extra columns are ignored, whatever their names; an empty table gives no rows; a text is encoded whole,
however long, runs of blanks of any length among it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text before the merges of this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "split")

_encoders: list[tuple[dict, object, np.ndarray]] = []


def load(spark: SparkSession, path: str = DEFAULT_VOCABULARY):
    """The vocabulary file's ranks as a broadcast; its size doesn't depend on the data."""
    if "://" in path:
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as f:
            raw = f.read()
    return spark.sparkContext.broadcast({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)})


def _encoder(shared) -> tuple[object, np.ndarray]:
    """The encoder of a broadcast vocabulary and its ids' byte lengths: each Python worker keeps the last one."""
    import tiktoken

    ranks = shared.value
    if not _encoders or _encoders[0][0] is not ranks:
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        _encoders[:] = [(ranks, tiktoken.Encoding("shared", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length)]
    return _encoders[0][1:]


#: What the pattern's \s stands for.
_BLANK = r"[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A longer run of blanks is encoded apart from its neighbours: the pattern's matcher keeps a state for each of its blanks.
LONG_RUN = 100_000
_RUN = re.compile(f"{_BLANK}{{{LONG_RUN},}}")


def encode(encoding, text: str) -> list[int]:
    """The ids of encoding.encode_ordinary(text), for runs of blanks of any length. The pattern takes a run of blanks before another character as all of them but the last, and at the text's end as a whole: there
    the text can be cut, and the piece has nothing left for the pattern to do but the merges."""
    out, at = [], 0
    for m in _RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        if at < m.start():
            out += encoding.encode_ordinary(text[at : m.start()])
        out += _merged(encoding, text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def _merged(encoding, piece: str) -> list[int]:
    return encoding._encode_single_piece(piece)


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; both given by their ends in order, starting from 0 and covering the same bytes."""
    n = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    crossing = np.bincount(first[first != last], minlength=n)
    if rule == "start" or not len(token_ends):
        return np.bincount(first, minlength=n).astype(np.float64), crossing
    whole = np.bincount(first[first == last], minlength=n).astype(np.float64)
    begin = np.concatenate([[0], section_ends[:-1]])
    for i in np.flatnonzero(first != last):
        a, b = first[i], last[i] + 1
        share = np.minimum(section_ends[a:b], token_ends[i]) - np.maximum(begin[a:b], starts[i])
        if rule == "majority":
            whole[a + int(share.argmax())] += 1
        else:
            whole[a:b] += share / (token_ends[i] - starts[i])
    return whole, crossing


def _line_ends(raw: bytes) -> np.ndarray:
    """Ends of the lines, each with its line end; at least one."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def section_counts(docs: DataFrame, fields: list[str] | None = None, rule: str = "start", vocabulary=None) -> DataFrame:
    """doc_id, section (from 0), start, end (bytes), n_tokens, crossing, doc_tokens: a row for each section of each document.

    fields: the columns that make up a document, one section each (null counts as empty); without it, the lines of text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = vocabulary or load(docs.sparkSession)
    columns = fields or ["text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length = _encoder(shared)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [[t or "" for t in part.column(i + 1).to_pylist()] for i in range(len(columns))]
                rows, n_sections, starts, ends, tokens, crossing, total = [], [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = [t[i] for t in texts]
                    whole = "\n".join(own)
                    raw = whole.encode()
                    if fields:
                        cut = np.cumsum([len(t.encode()) + 1 for t in own])
                        cut[-1] -= 1
                    else:
                        cut = _line_ends(raw)
                    spans = np.cumsum(length[np.array(encode(encoding, whole), np.int64)])
                    n, over = attribute(spans, cut, rule)
                    rows.append(np.full(len(cut), i))
                    n_sections.append(np.arange(len(cut)))
                    starts.append(np.concatenate([[0], cut[:-1]]))
                    ends.append(cut)
                    tokens.append(n)
                    crossing.append(over)
                    total.append(np.full(len(cut), len(spans)))
                join = lambda x: pa.array(np.concatenate(x))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0).take(join(rows)), "section": join(n_sections), "start": join(starts), "end": join(ends), "n_tokens": join(tokens), "crossing": join(crossing), "doc_tokens": join(total)})

    return docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in columns]).mapInArrow(count, "doc_id long, section long, start long, end long, n_tokens double, crossing long, doc_tokens long")
