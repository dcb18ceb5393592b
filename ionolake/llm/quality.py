"""Quality classifier from weak labels: overlapping heuristic labellers vote, expectation-maximisation estimates how accurate each is, and a hashed linear scorer
learns the posterior labels.

Each labeller says good (1), bad (0) or nothing (2) of a text. Votes are one number a text, and only the counts of the vote patterns (at most 3^L) reach the driver, where
EM runs over them: given the class, labellers are taken as independent, each with its own accuracy on bad and on good texts; what a labeller says nothing of carries no evidence. The posterior of a pattern is the
label of its texts. A linear scorer over hashed features of the text (byte trigrams, word shapes and sizes) is then fitted to posteriors of a sample of about TRAIN_ROWS
texts, drawn by the hash of the id with a share for each pattern, so rare patterns are learned too. It scores every whole text.

keep is score >= KEEP. The labels table takes no part in training; tests hold the scores against it.

Cases: null or word-less texts have all votes bad and score by their features alone; rows of null doc_id are scored but not learned from; repeated rows are scored alike;
an empty table gives no rows; extra columns are ignored. With one pattern only, every text gets its posterior as label. A vote pattern that the model hasn't seen gets its posterior from the accuracies, as the others do. Texts are read
whole, however long (some 70 bytes of memory a byte of the longest).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, chunks, mix, row_of, span_hashes, spans, string_buffer, sums_by_row

TRAIN_ROWS = 6_000
BUCKETS = 1 << 12
KEEP = 0.85
LABELLERS = ("symbols", "word_length", "repeated_words", "vocabulary", "length", "sentences", "digits", "separators")
#: What EM starts from and is held to, in texts' shares: a good text sets a labeller off in FALSE_ALARM of all cases (with the weight of PRIOR_WEIGHT of all texts), and BAD of the texts are bad.
FALSE_ALARM, PRIOR_WEIGHT, BAD = 0.01, 0.2, 0.15
#: Punctuation of ordinary prose: . , ; : ! ? ' " ( ) -
_PUNCTUATION = [46, 44, 59, 58, 33, 63, 39, 34, 40, 41, 45]
_BLOCK = 1 << 19


def votes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of LABELLERS votes for each text of a chunk."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    share = lambda mask: sums_by_row(mask.astype(np.int64), offs) / size
    starts, ends = spans(data, offs, WORD_BYTES)
    rows = row_of(offs, starts)
    first = np.searchsorted(rows, np.arange(n + 1))
    words = np.maximum(np.diff(first), 1)
    h = span_hashes(data, starts, ends)
    key = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    distinct = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)
    after = np.concatenate([np.zeros(min(1, len(h)), bool), (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])])
    echo = np.bincount(rows[after], minlength=n) / words
    mean = sums_by_row(ends - starts, first) / words
    letters = share(WORD_BYTES[data])
    spaces = share((data == 32) | (data == 10))
    symbols = 1 - letters - spaces - share(np.isin(data, _PUNCTUATION))
    stops = share(np.isin(data, [46, 33, 63]))
    bars = share(data == 124)
    digits = share((data >= 48) & (data <= 57))
    none = np.diff(first) == 0
    few = np.diff(first) < 5
    out = np.full((n, len(LABELLERS)), 2, np.int64)

    def say(k: int, bad: np.ndarray, good: np.ndarray) -> None:
        out[good, k] = 1
        out[bad | none, k] = 0

    say(0, symbols > 0.05, symbols < 0.02)
    say(1, (mean > 14) | (mean < 1.5), (mean > 2.5) & (mean < 9))
    say(2, echo > 0.15, (echo < 0.05) & ~few)
    say(3, (words >= 40) & (distinct / words < 0.25), (words >= 10) & (distinct / words > 0.4))
    say(4, none, words >= 20)
    say(5, words > np.maximum(150, 300 * stops * size), (stops * size >= 1) & (words < 60 * stops * size))
    say(6, digits > 0.2, digits < 0.05)
    say(7, bars > 0.02, bars == 0)
    return out


def _features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Root-scaled shares of hashed byte trigrams and word shapes, a row (float32, length 1) for each text."""
    n = len(offs) - 1
    x = data.astype(np.uint64)
    rows = np.repeat(np.arange(n), np.diff(offs))
    # classes of bytes: what matters to quality more than which letter it is
    kind = np.arange(256, dtype=np.uint64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 65, 97, 48, 97
    shape = kind[data]
    out = np.zeros(n * BUCKETS, np.float32)
    for salt, code in ((1, x), (2, shape)):
        if len(code) < 4:
            continue
        gram = code[:-2] | code[1:-1] << np.uint64(8) | code[2:] << np.uint64(16)
        if salt == 2:
            gram = gram[:-1] | code[3:] << np.uint64(24)
        inside = rows[: len(gram)] == rows[len(x) - len(gram) :]
        bucket = (mix(gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(64 - 12)).astype(np.int64)
        out += np.bincount((rows[: len(gram)] * BUCKETS + bucket)[inside], minlength=n * BUCKETS).astype(np.float32)
    starts, ends = spans(data, offs, WORD_BYTES)
    wrow = row_of(offs, starts)
    h = span_hashes(data, starts, ends)
    same = np.concatenate([np.zeros(min(1, len(h)), bool), (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])])
    extra = np.minimum(ends - starts, 30) + 40 * same
    out += np.bincount(wrow * BUCKETS + (mix(extra.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(3)) >> np.uint64(52)).astype(np.int64), minlength=n * BUCKETS).astype(np.float32)
    out = out.reshape(n, BUCKETS)
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out, out=out)


def _code(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def _decode(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def posterior(patterns: np.ndarray, accuracies: np.ndarray, bad: float) -> np.ndarray:
    """The probability of good for vote patterns, from the labellers' accuracies and the share of bad texts."""
    bad_votes, good_votes = (patterns == 0).astype(np.float64), (patterns == 1).astype(np.float64)
    log = [np.log(p) + bad_votes @ np.log(q) + good_votes @ np.log(1 - q) for p, q in ((bad, accuracies[:, 0]), (1 - bad, 1 - accuracies[:, 1]))]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of 0, 1, 2) and their counts: the posterior of good by pattern, accuracies [labeller, 2] (how often a labeller that says
    something of a bad (of a good) text is right), and the share of bad texts. Priors hold the classes to their meaning: without them, EM may split texts by another trait, such as length."""
    n = counts.sum()
    bad_votes, any_votes = (patterns == 0).astype(np.float64), (patterns != 2).astype(np.float64)
    hit = np.full(patterns.shape[1], 0.4)
    alarm = np.full(patterns.shape[1], FALSE_ALARM)
    bad = BAD
    post = np.zeros(len(patterns))
    for _ in range(steps):
        before = post
        post = posterior(patterns, np.stack([hit, 1 - alarm], axis=1), bad)
        w_bad, w_good = counts * (1 - post), counts * post
        hit = (w_bad @ bad_votes + 0.4 * 0.02 * n) / (w_bad @ any_votes + 0.02 * n)
        alarm = (w_good @ bad_votes + FALSE_ALARM * PRIOR_WEIGHT * n) / (w_good @ any_votes + PRIOR_WEIGHT * n)
        bad = (w_bad.sum() + BAD * PRIOR_WEIGHT * n) / (n + PRIOR_WEIGHT * n)
        if np.abs(post - before).max() < 1e-9:
            break
    accuracies = np.stack([hit, 1 - alarm], axis=1)
    return posterior(patterns, accuracies, bad), accuracies, bad


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic regression on soft labels, by Nesterov's accelerated gradient; x holds float32 rows."""
    weight, bias = np.zeros(x.shape[1], np.float32), 0.0
    look, look_bias = weight.copy(), bias
    w = (w / w.sum()).astype(np.float32)
    for k in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ look + look_bias, -30, 30)))
        g = w * (p - y).astype(np.float32)
        new, new_bias = look - 6.0 * (x.T @ g + 1e-5 * look), look_bias - 2.0 * float(g.sum())
        momentum = k / (k + 3)
        look, look_bias = new + momentum * (new - weight), new_bias + momentum * (new_bias - bias)
        weight, bias = new, new_bias
    return np.append(weight, np.float32(bias))


def vote_codes(docs: DataFrame) -> DataFrame:
    """doc_id, pattern (the votes as one number): a row for each row of docs."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(*string_buffer(b.column(1)), _BLOCK):
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "pattern": pa.array(_code(votes(data, offs)).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(vote, "doc_id long, pattern int")


def train(docs: DataFrame) -> dict | None:
    """The model: posterior by pattern, accuracies of the labellers, and the scorer's weights; None for an empty table."""
    spark = docs.sparkSession
    counted = vote_codes(docs).groupBy("pattern").count().toArrow()  # at most 3^len(LABELLERS) rows
    if not counted.num_rows:
        return None
    code, count = counted.column("pattern").to_numpy(), counted.column("count").to_numpy()
    o = np.argsort(code)
    code, count = code[o], count[o]
    post, accuracies, bad = estimate(_decode(code), count)
    each = TRAIN_ROWS / len(code)
    # half of the sample in proportion, half alike for every pattern
    share = np.minimum(1, (TRAIN_ROWS / 2) / count.sum() + each / 2 / count)
    table = spark.sparkContext.broadcast((code, post, share))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, posts, shares = table.value
        for b in batches:
            u = b.column(0).to_numpy()
            for lo, hi, data, offs in chunks(*string_buffer(b.column(1)), _BLOCK):
                at = np.searchsorted(codes, _code(votes(data, offs)))
                for i in np.flatnonzero(u[lo:hi] < shares[at]):
                    f = _features(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
                    yield pa.RecordBatch.from_pydict({"place": pa.array(u[lo + i : lo + i + 1]), "x": pa.array([f.astype(np.float16).tobytes()], pa.binary()), "y": pa.array([posts[at[i]]]), "w": pa.array([1 / shares[at[i]]])})

    u = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000_007)) / 1_000_000_007).alias("u")
    got = docs.where("doc_id is not null").select(u, "text").mapInArrow(draw, "place double, x binary, y double, w double").toArrow()
    if not got.num_rows:
        weights = np.zeros(BUCKETS + 1, np.float32)
    else:
        got = got.sort_by([("place", "ascending"), ("y", "ascending")])
        x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
        weights = _fit(x, got.column("y").to_numpy(), np.sqrt(got.column("w").to_numpy()))
    return {"patterns": code, "posterior": post, "accuracies": accuracies, "bad": bad, "weights": weights}


def score(docs: DataFrame, model: dict | None, keep: float = KEEP) -> DataFrame:
    """doc_id, pattern, posterior (of the votes), score (of the linear scorer), keep: a row for each row of docs."""
    schema = "doc_id long, pattern int, posterior double, score double, keep boolean"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, data, offs in chunks(*string_buffer(b.column(1)), _BLOCK):
                code = _code(votes(data, offs))
                seen, at = np.unique(code, return_inverse=True)
                good = posterior(_decode(seen), m["accuracies"], m["bad"])[at]
                s = np.concatenate([_features(data[offs[i] : offs[min(i + 500, hi - lo)]], offs[i : min(i + 500, hi - lo) + 1] - offs[i]) @ m["weights"][:-1] for i in range(0, hi - lo, 500)])
                p = 1 / (1 + np.exp(-np.clip(s + m["weights"][-1], -30, 30)))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "pattern": pa.array(code.astype(np.int32)), "posterior": pa.array(good), "score": pa.array(p.astype(np.float64)), "keep": pa.array(p >= keep)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))
