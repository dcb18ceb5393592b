"""Benchmark decontamination: every passage of every document queries a BM25 inverted index of the test items.

The index holds, for each term, its postings (item, impact) in item order, with the largest impact of each block of BLOCK items (block
maxima). Impacts are BM25 term scores over the item's own full score, so one threshold says how much of an item a
passage holds. An item of more than PIECE words is indexed in pieces of about equal length, each retrieved by itself. Passages are windows of words, each overlapping the next by half, twice as long as the longest piece or longer.

A passage is dropped early when its terms' largest impacts, then its terms' block maxima, cannot reach the threshold; the
rest run block-max WAND, which retrieves every item at or above it. Each retrieved (document, item) is verified on the whole
document: shares of the question's and of the answer's word trigrams that it holds. The answer of an item is its last sentence or line, or, if
it has one only, its last third of words; the question is what stands before.

The test items are indexed in blocks of at most INDEX_ITEMS items and INDEX_WORDS words. With more than one block, each block's result is written before its index is given up and the next one built, so driver and executors hold
one index at a time, however large the benchmark is. Documents are read once for each block and nothing is shuffled. Document frequencies, mean length and window are those of the whole benchmark (statistics()), so scores and
what is found don't depend on where blocks end.

Cases: null or word-less items and texts match nothing; an item of fewer than LEAST_WORDS words is found where all its words stand in a row (short="sequence"), or only in texts that have no other words (short="whole"); repeated items are found each under its own
item_id; rows that repeat a doc_id give rows each; a null doc_id is returned as null; a text is searched whole, however long (a pass over one takes some 40 bytes of memory a byte of it); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, chunks, materialise, mix, row_of, span_hashes, spans, string_buffer

THRESHOLD = 0.6
QUESTION_OVERLAP = 0.6
ANSWER_OVERLAP = 0.6
K1, B = 1.2, 0.75
BLOCK = 2
WINDOW = 128
PIECE = 256
LEAST_WORDS = 5
INDEX_ITEMS = 20_000
INDEX_WORDS = 2_000_000
#: Entries of the block maxima's matrix, at most.
DENSE = 1 << 24
_FILTER_BITS = 20


def _words(text: str) -> np.ndarray:
    data, offs = string_buffer(pa.array([text]))
    return span_hashes(data, *spans(data, offs, WORD_BYTES))


def _grams(words: np.ndarray, n: int = 3) -> np.ndarray:
    """Hashes of the word trigrams; of all words if they are fewer."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(31) + words[k : len(words) - n + 1 + k])
    return out


def _parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of question and answer."""
    pieces = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if len(_words(p))]
    if len(pieces) > 1:
        return _words(" ".join(pieces[:-1])), _words(pieces[-1])
    words = _words(text)
    cut = len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


@dataclass(frozen=True)
class Statistics:
    """Of the whole benchmark, in pieces: how many, their mean length, the longest, and document frequencies by term (terms ascending): those that an index asks for."""

    pieces: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]


def _pieces(words: np.ndarray) -> list[np.ndarray]:
    return np.array_split(words, -(-len(words) // PIECE))


def _own_statistics(pieces: list[np.ndarray]) -> Statistics:
    """Those of pieces that are the whole benchmark."""
    terms, df = np.unique(np.concatenate([np.unique(p) for p in pieces]) if pieces else np.zeros(0, np.uint64), return_counts=True)
    return Statistics(len(pieces), float(np.mean([len(p) for p in pieces])) if pieces else 1.0, max([0, *(len(p) for p in pieces)]), terms, df)


class Index:
    """Inverted index of some items, as arrays; statistics: the whole benchmark's, from its terms (without: these items are all)."""

    def __init__(self, item_ids: list, texts: list[str], statistics: Callable[[np.ndarray], Statistics] | None = None) -> None:
        words = [_words(t or "") for t in texts]
        keep = [i for i, w in enumerate(words) if len(w)]
        self.item_ids = [item_ids[i] for i in keep]
        words = [words[i] for i in keep]
        self.parts = [tuple(np.unique(_grams(p)) for p in _parts(texts[i])) for i in keep]
        self.short = [tuple(min(3, len(p)) for p in _parts(texts[i])) for i in keep]
        self.n_words = [len(w) for w in words]
        self.in_a_row = [_grams(w, len(w)) if len(w) < LEAST_WORDS else None for w in words]
        pieces = [_pieces(w) for w in words]
        self.owner = [i for i, ps in enumerate(pieces) for _ in ps]  # the item of each piece; below, an item is a piece
        words = [p for ps in pieces for p in ps]
        n = len(words)
        length = np.array([len(w) for w in words], np.float64)
        pairs = [np.unique(w, return_counts=True) for w in words]
        term = np.concatenate([t for t, _ in pairs]) if n else np.zeros(0, np.uint64)
        tf = np.concatenate([c for _, c in pairs]).astype(np.float64) if n else np.zeros(0)
        item = np.repeat(np.arange(n), [len(t) for t, _ in pairs]) if n else np.zeros(0, np.int64)
        order = np.lexsort((item, term))
        term, tf, item = term[order], tf[order], item[order]
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        whole = statistics(self.terms) if statistics else _own_statistics(words)
        self.window = max(WINDOW, 2 * whole.longest)
        df, df_all = np.diff(self.first), whole.of(self.terms)
        idf = np.log1p((whole.pieces - df_all + 0.5) / (df_all + 0.5))
        norm = K1 * (1 - B + B * length[item] / max(1.0, whole.mean))
        impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm)
        own = np.bincount(item, weights=impact, minlength=n)
        self.impact, self.item = impact / own[item], item
        self.most = np.maximum.reduceat(self.impact, self.first[:-1]) if len(term) else np.zeros(0)
        self.blocks = -(-n // BLOCK)
        # block maxima by (term, block of items), in that order
        key = np.repeat(np.arange(len(df)), df) * max(1, self.blocks) + item // BLOCK
        self.block_key, at = np.unique(key, return_index=True)
        self.block_most = np.maximum.reduceat(self.impact, at) if len(key) else np.zeros(0)
        self.block_first = np.searchsorted(self.block_key, np.arange(len(df) + 1) * max(1, self.blocks))
        self.block_of = self.block_key % max(1, self.blocks)
        self.dense = None  # the block maxima as a matrix, where that is small
        if len(df) * self.blocks <= DENSE:
            self.dense = np.zeros((len(df), self.blocks), np.float32)
            self.dense.reshape(-1)[self.block_key] = self.block_most
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.terms >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are terms, and which."""
        maybe = np.flatnonzero(self.filter[(words >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[maybe]), max(0, len(self.terms) - 1))
        hit = self.terms[at] == words[maybe] if len(self.terms) else np.zeros(0, bool)
        return maybe[hit], at[hit]

    def block_bounds(self, term: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """For each run term[cut[i]:cut[i+1]], the largest sum of the terms' maxima in one block."""
        if self.dense is not None:
            step = max(1, (1 << 22) // max(1, self.blocks))  # pairs at a time, so that the sums stay small
            out, i = [np.zeros(0)], 0
            while i + 1 < len(cut):
                j = max(i + 1, int(np.searchsorted(cut, cut[i] + step, "right")) - 1)
                out.append(np.add.reduceat(self.dense[term[cut[i] : cut[j]]], cut[i:j] - cut[i], axis=0).max(axis=1))
                i = j
            return np.concatenate(out)
        out = np.zeros(len(cut) - 1)
        for i in range(len(out)):
            at = np.concatenate([np.arange(self.block_first[t], self.block_first[t + 1]) for t in term[cut[i] : cut[i + 1]]])
            out[i] = np.bincount(self.block_of[at], weights=self.block_most[at], minlength=self.blocks).max()
        return out

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts over these terms add up to the threshold, by block-max WAND."""
        ends = [int(self.first[t + 1]) for t in terms]
        at = [int(self.first[t]) for t in terms]
        most = [float(self.most[t]) for t in terms]
        items, impacts = self.item, self.impact
        slack = threshold - 1e-9
        found = []

        def skip(i: int, target: int) -> None:
            at[i] += int(np.searchsorted(items[at[i] : ends[i]], target))

        live = [i for i in range(len(terms)) if at[i] < ends[i]]
        while live:
            live.sort(key=lambda i: items[at[i]])
            total, pivot = 0.0, None
            for i in live:
                total += most[i]
                if total >= slack:
                    pivot = int(items[at[i]])
                    break
            if pivot is None:
                break
            upto = [i for i in live if items[at[i]] <= pivot]
            block = pivot // BLOCK
            bound = 0.0
            for i in upto:
                lo, hi = int(self.block_first[terms[i]]), int(self.block_first[terms[i] + 1])
                k = lo + int(np.searchsorted(self.block_of[lo:hi], block))
                bound += float(self.block_most[k]) if k < hi and self.block_of[k] == block else 0.0
            if bound >= slack:
                if int(items[at[upto[0]]]) == pivot:
                    score = sum(float(impacts[at[i]]) for i in upto)
                    if score >= slack:
                        found.append((pivot, score))
                    for i in upto:
                        at[i] += 1
                else:
                    for i in upto:
                        skip(i, pivot)
            else:  # no item of this block before the next list can reach it
                later = [int(items[at[i]]) for i in live if items[at[i]] > pivot]
                target = min([(block + 1) * BLOCK, *later])
                for i in upto:
                    skip(i, max(target, pivot + 1))
            live = [i for i in live if at[i] < ends[i]]
        return found

    def search(self, data: np.ndarray, offs: np.ndarray, threshold: float, question: float, answer: float, short: str = "sequence") -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of the verified leaks in a chunk of texts."""
        starts, ends = spans(data, offs, WORD_BYTES)
        words = span_hashes(data, starts, ends)
        rows = row_of(offs, starts)
        first = np.searchsorted(rows, np.arange(len(offs)))
        at, term = self.find(words)
        if not len(at):
            return
        half = self.window // 2
        row = rows[at]
        part = (at - first[row]) // half
        last = (np.diff(first)[row] - 1) // half
        base = np.concatenate([[0], np.cumsum(np.diff(first) // half + 1)])  # a number for each window
        own, before = (part < last) | (part == 0), part > 0
        key = np.concatenate([(base[row] + part)[own], (base[row] + part - 1)[before]])
        key = np.sort(key.astype(np.uint64) << np.uint64(24) | np.concatenate([term[own], term[before]]).astype(np.uint64))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        window, term = (key >> np.uint64(24)).astype(np.int64), (key & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        bound = np.add.reduceat(self.most[term], cut)
        cut = np.append(cut, len(window))
        hits: dict[tuple[int, int], float] = {}
        live = bound >= threshold
        pairs = np.repeat(live, np.diff(cut))
        term, window, cut = term[pairs], window[pairs], np.concatenate([[0], np.cumsum(np.diff(cut)[live])])
        for k in np.flatnonzero(self.block_bounds(term, cut) >= threshold - 1e-5):
            terms = term[cut[k] : cut[k + 1]]
            r = int(np.searchsorted(base, window[cut[k]], "right")) - 1
            for piece, score in self.wand(terms, threshold):
                item = self.owner[piece]
                hits[r, item] = max(score, hits.get((r, item), 0.0))
        for (r, item), score in sorted(hits.items()):
            own_words = words[first[r] : first[r + 1]]
            n, row_of_words = self.n_words[item], self.in_a_row[item]
            if row_of_words is not None and not (np.isin(row_of_words, _grams(own_words, n)).all() if short == "sequence" else len(own_words) == n):
                continue
            share = [float(np.isin(p, _grams(own_words, n)).mean()) if len(p) else 1.0 for p, n in zip(self.parts[item], self.short[item], strict=True)]
            if share[0] >= question and share[1] >= answer:
                yield r, item, score, *share


def statistics(benchmark: DataFrame) -> Callable[[np.ndarray], Statistics]:
    """The whole benchmark's Statistics by the terms that are asked for (one index's). Frequencies are a table, added up by term; the driver gets those of an index and three numbers."""
    spark = benchmark.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = [p for t in b.column(0).to_pylist() for w in [_words(t or "")] if len(w) for p in _pieces(w)]
            own = _own_statistics(pieces)
            nothing = pa.nulls(len(own.terms), pa.int64())
            yield pa.RecordBatch.from_pydict({"term": pa.array(own.terms.view(np.int64)), "df": pa.array(own.df, pa.int64()), "pieces": nothing, "words": nothing, "longest": nothing})
            yield pa.RecordBatch.from_pydict({"term": pa.nulls(1, pa.int64()), "df": pa.nulls(1, pa.int64()), "pieces": pa.array([own.pieces], pa.int64()), "words": pa.array([sum(map(len, pieces))], pa.int64()), "longest": pa.array([own.longest], pa.int64())})

    rows = benchmark.select("text").mapInArrow(count, "term long, df long, pieces long, words long, longest long")
    table = materialise(rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "pieces", "words")], F.max("longest").alias("longest")), "benchmark")
    total = table.where("term is null").first()
    pieces = total["pieces"] if total else 0

    def of(terms: np.ndarray) -> Statistics:
        asked = spark.createDataFrame(pa.table({"term": terms.view(np.int64)})) if len(terms) else table.select("term").limit(0)
        found = asked.join(table.where("term is not null"), "term").select("term", "df").toArrow()
        term, df = found.column("term").to_numpy().view(np.uint64), found.column("df").to_numpy()
        order = np.argsort(term)
        return Statistics(pieces, total["words"] / pieces if pieces else 1.0, total["longest"] if pieces else 0, term[order], df[order])

    return of


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """An index for each block of items; the items stream through the driver in order of id, a block at a time."""
    ids, texts, words, whole = [], [], 0, None
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").split())
        if ids and (len(ids) >= INDEX_ITEMS or words + n > INDEX_WORDS):
            whole = whole or statistics(benchmark)
            yield Index(ids, texts, whole)
            ids, texts, words = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        words += n
    if ids:
        yield Index(ids, texts, whole)


def _passes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Each index, and whether it is the only one."""
    held, more = None, False
    for index in indexes(benchmark):
        if held is not None:
            more = True
            yield held, False
        held = index
    if held is not None:
        yield held, not more


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP, answer: float = ANSWER_OVERLAP, short: str = "sequence") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each test item that a document holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for index, alone in _passes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for b in batches:
                for lo, hi, data, offs in chunks(*string_buffer(b.column(1))):
                    if rows := list(ix.search(data, offs, threshold, question, answer, short)):
                        r, item, *rest = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(r)), pa.array([ix.item_ids[i] for i in item], pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema)
        if not alone:
            found = materialise(found, "leaks")
            shared.destroy()
        out = out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP, answer: float = ANSWER_OVERLAP, short: str = "sequence") -> DataFrame:
    """The documents that hold no test item; the filter runs in the scan."""
    spark = docs.sparkSession
    for index, alone in _passes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def leaked(texts, shared=shared):
            import pandas as pd

            out = np.zeros(len(texts), bool)
            for lo, _, data, offs in chunks(*string_buffer(pa.array(texts, pa.string()))):
                for r, *_ in shared.value.search(data, offs, threshold, question, answer, short):
                    out[lo + r] = True
            return pd.Series(out)

        docs = docs.where(~leaked(F.coalesce("text", F.lit(""))))
        if not alone:
            docs = materialise(docs, "clean")
            shared.destroy()
    return docs
