"""Language ID by a string kernel: presence of byte n-grams of 1 to N (blended spectrum), normalised, Nystrom landmarks, and
one-versus-rest kernel ridge regression.

The kernel of two texts is the number of n-gram buckets that both hold over the root of the product of how many each holds. The
landmarks are texts of the training sample; a text's kernel values against them, times one matrix (the Nystrom map and the
ridge solution of every language together), are its scores: two matrix products for a block of texts.

Training takes at most about PER_LANG documents of each language: ids whose hash falls under a share that is set from each language's
count, which is joined to the rows as a table. This sample is written once. Its landmarks (LANDMARKS in all, or one a language if there are more languages) reach the driver as presence bits;
the sums of the regression (landmarks x landmarks, and languages x landmarks) are added up in the tasks and then by Spark, so what the driver holds grows with the languages' names and
landmarks only: some 10 KB a language. Every text is scored whole.

Cases: texts that are null or without a letter are `und` with score 0; rows of null doc_id or lang are scored but not learned from; ties go to the
first language in order of name; with nothing to learn from, every text is `und`. Repeated rows are scored alike; an empty table gives no rows; extra columns are ignored or kept, whatever their names. A text
is never cut, however long (a pass over one takes some 60 bytes of memory a byte of it); very long texts hold most n-grams of their script, so that their scores draw near to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, fold_of, materialise, mix, string_buffer

N_MAX = 4
BUCKETS = 1 << 13
PER_LANG = 600
LANDMARKS = 192
RIDGE = 1e-3
#: Languages up to which their counts are broadcast.
BROADCAST_LANGS = 100_000
_BLOCK = 1 << 19


def _presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 (float32) for each text: the buckets of its n-grams, digits and ASCII punctuation read as spaces."""
    letters = np.arange(256, dtype=np.uint64)
    letters[:128] = 32
    for a in (65, 97):
        letters[a : a + 26] = np.arange(97, 123)
    x = letters[data]
    rows = np.repeat(np.arange(len(offs) - 1) * BUCKETS, np.diff(offs))
    end = np.repeat(offs[1:], np.diff(offs))
    out = np.zeros((len(offs) - 1) * BUCKETS, np.float32)
    code = np.zeros(len(x), np.uint64)
    at = np.arange(len(x))
    for n in range(1, N_MAX + 1):
        code = code[: len(x) - n + 1] * np.uint64(256) + x[n - 1 :] if n > 1 else x
        bucket = (mix(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(51)).astype(np.int64)
        inside = at[: len(code)] + n <= end[: len(code)]
        out[(rows[: len(code)] + bucket)[inside]] = 1
    return out.reshape(-1, BUCKETS)


def _has_letter(text: str) -> F.Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def _unpack(raw: list[bytes]) -> np.ndarray:
    return _unit(np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BUCKETS // 8), axis=1).astype(np.float32))


def solve(landmarks: np.ndarray, gram: np.ndarray, sums: np.ndarray, n: float) -> np.ndarray:
    """The matrix from kernel values against the landmarks (rows) to scores. gram: the weighted sum of kernel values' outer products; sums: of each language (row) the weighted sum of kernel values; n: the weights' sum.

    Ridge regression on the Nystrom features z = k @ root, whose inner products stand for the kernel."""
    values, vectors = np.linalg.eigh(landmarks.astype(np.float64) @ landmarks.T.astype(np.float64))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    a = np.linalg.solve(root.T @ gram @ root + RIDGE * n * np.eye(root.shape[1]), root.T @ sums.T)
    return (root @ a).astype(np.float32)


def train(docs: DataFrame, learn):
    """Landmarks (transposed), matrix and language names from the rows of docs where learn holds; None if there are none."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", learn.alias("learn")).where("learn and lang is not null").where(_has_letter("text"))
    counts = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    if counts.count() <= BROADCAST_LANGS:
        counts = F.broadcast(counts)
    place = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_003)) / 1_000_003).alias("place")
    drawn = rows.select("lang", "text", place).join(counts, "lang").where(F.col("place") * F.col("n") < PER_LANG)
    # n: how many are drawn of the language, about
    drawn = materialise(drawn.select("lang", "text", "place", F.least("n", F.lit(PER_LANG)).cast("double").alias("n")), "drawn")
    names = [r["lang"] for r in drawn.select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return None

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
        for b in batches:
            for lo, hi, data, offs in chunks(*string_buffer(b.column(1)), _BLOCK):
                for k in range(0, hi - lo, 500):  # a presence row is 32 KB while it is made, however short its text
                    cut = offs[k : k + 501]
                    yield b, lo + k, _presence(data[cut[0] : cut[-1]], cut - cut[0])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, x in presence(batches):
            yield pa.RecordBatch.from_pydict({"lang": b.column(0).slice(at, len(x)), "bits": pa.array([p.tobytes() for p in np.packbits(x.astype(bool), axis=1)], pa.binary())})

    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))  # of at most about PER_LANG rows
    marks = drawn.withColumn("rank", first).where(F.col("rank") <= max(1, LANDMARKS // len(names))).select("lang", "text").mapInArrow(bits, "lang string, bits binary")
    landmarks = _unpack(sorted(r["bits"] for r in marks.toLocalIterator()))
    shared = spark.sparkContext.broadcast((landmarks, names))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each landmark (its row of the gram matrix) and each language met (-1 - its number)."""
        marks, names = shared.value
        number = {k: i for i, k in enumerate(names)}
        gram, sums, weight = np.zeros((len(marks), len(marks))), {}, 0.0
        for b, at, x in presence(batches):
            k = (_unit(x) @ marks.T).astype(np.float64)
            w = 1 / b.column(2).slice(at, len(x)).to_numpy()
            gram += (k * w[:, None]).T @ k
            weight += float(w.sum())
            for i, lang in enumerate(b.column(0).slice(at, len(x)).to_pylist()):
                sums[number[lang]] = sums.get(number[lang], 0) + w[i] * k[i]
        if weight:
            keys, values = [*range(len(marks)), *(-1 - i for i in sums)], [*gram, *sums.values()]
            for i in range(0, len(keys), 500):
                part = values[i : i + 500]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[i : i + 500], pa.int32()), "x": pa.array([v.tobytes() for v in part], pa.binary()), "w": pa.array([weight if k == 0 else 0.0 for k in keys[i : i + 500]])})

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, np.float64) for v in sorted(t.column("x").to_pylist())], axis=0)
        return pa.table({"key": t.column("key")[:1], "x": pa.array([total.tobytes()], pa.binary()), "w": pa.array([float(sum(t.column("w").to_pylist()))])})

    schema = "key int, x binary, w double"
    summed = drawn.select("lang", "text", "n").mapInArrow(add_up, schema).groupBy("key").applyInArrow(add, schema)
    gram, sums, weight = np.zeros((len(landmarks), len(landmarks))), np.zeros((len(names), len(landmarks))), 0.0
    for r in summed.toLocalIterator():
        (gram if r["key"] >= 0 else sums)[r["key"] if r["key"] >= 0 else -1 - r["key"]] = np.frombuffer(r["x"], np.float64)
        weight += r["w"]
    return np.ascontiguousarray(landmarks.T), solve(landmarks, gram, sums, weight), names


def identify(docs: DataFrame, model, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and its score added under those names (replacing columns of such names), by a model of train()."""
    if model is None:
        return docs.withColumns({lang_name: F.lit("und"), score_name: F.lit(0.0)})
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        landmarks, matrix, names = shared.value
        col = pa.array(texts, pa.string())
        best, score = np.zeros(len(col), np.int64), np.zeros(len(col))
        for lo, hi, data, offs in chunks(*string_buffer(col), _BLOCK):
            for k in range(lo, hi, 500):
                end = min(hi, k + 500)
                cut = offs[k - lo : end - lo + 1]
                x = _presence(data[cut[0] : cut[-1]], cut - cut[0])
                s = (x @ landmarks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) @ matrix
                best[k:end] = s.argmax(axis=1)
                score[k:end] = np.clip(s.max(axis=1), 0, 1)
        return pd.DataFrame({"lang": np.array(names, dtype=object)[best], "score": score})

    held = "_predicted"
    while held in docs.columns:
        held += "_"
    known = _has_letter("text")
    out = docs.withColumn(held, predict(F.coalesce("text", F.lit(""))))
    return out.withColumns({lang_name: F.when(known, F.col(f"{held}.lang")).otherwise("und"), score_name: F.when(known, F.col(f"{held}.score")).otherwise(0.0)}).drop(held)


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from the documents that are not held out."""
    learn = F.coalesce(fold_of("doc_id") != 0, F.lit(False))
    out = identify(docs.select("doc_id", "text"), train(docs, learn))
    return out.select(F.col("doc_id").cast("long"), F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
