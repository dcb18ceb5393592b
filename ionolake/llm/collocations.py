"""Phrase collocations by PCY/DHP hashing: phrases whose words stand together more often than their parts would by chance.

Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces, and those at blanks into words; everything is counted per language. One pass over the texts for each length:
pass k counts the phrases of k words exactly and, while it has them in hand, adds up the phrases of k + 1 words in hashed buckets. A phrase of k + 1 words is counted in the next pass only if its bucket
reached the least count (PCY) and both phrases of k words in it did (Apriori). What prunes reaches the tasks as two bitmaps of one fixed size, whatever the corpus: the buckets, and the hashed phrases of the
last pass. Both only let through too much, never too little; the exact counts decide. Buckets of k + 1 words take in only what passed both tests at k words (DHP).

Plan: a pass is a scan, and each task adds up its own counts before anything is shuffled, so a frequent word or phrase is one row a task (or one for each FLUSH different phrases), not one an occurrence.
The best of a language are ranked in two steps, first within shares of its phrases. Of bucket counts each task keeps one byte a bucket (they stop at the least count), added up piece by piece, 64 tasks at a time.

Scores are exact: whole numbers of 38 digits, so any count up to 10^16 is right. Cuts of a phrase: see score().

Cases: a null text is empty; an empty text, or one of blanks and punctuation, has no words; a null language is `und`; repeated rows count as often as they stand there; a text of any length is counted whole
(one of more than SEGMENT bytes in segments that see the next words, so memory doesn't grow with it, but for a single word); without documents there are no rows; extra columns are ignored, whatever their names.
Phrases are told apart within a batch by 128 bits of hash, from there on by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, chunks, materialise, mix, row_of, span_hashes, spans, string_buffer

LONGEST = 5
LEAST = 100
TOP = 2000
#: Buckets and places of both bitmaps: 2^22, half a MB each.
BITS = 22
#: Different phrases that a task holds before it passes on their counts.
FLUSH = 200_000
#: Bytes of text that are worked on at once.
SEGMENT = 1 << 20
_PIECE = 1 << 14
_SHARES = 64

#: What ends a piece, and what ends a word within one.
ENDS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"
_WORD = np.ones(256, bool)
_WORD[[ord(c) for c in ENDS + BLANKS]] = False
_END = np.zeros(256, np.int64)
_END[[ord(c) for c in ENDS]] = 1


def _next(data: np.ndarray, at: int, word: bool) -> int:
    """The first place from at on that is (or isn't) part of a word; the end without one."""
    step = 256
    while at < len(data):
        hit = np.flatnonzero(_WORD[data[at : at + step]] == word)
        if len(hit):
            return at + int(hit[0])
        at, step = at + step, step * 2
    return len(data)


def _segments(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, bytes that own their words): short rows together, a long row in segments; a segment sees LONGEST - 1 words more than it owns."""
    for lo, hi, part, off in chunks(data, offs, SEGMENT):
        if hi - lo > 1 or len(part) <= 2 * SEGMENT:
            yield lo, part, off, len(part)
            continue
        at = 0
        while at < len(part):
            cut = _next(part, min(len(part), at + SEGMENT), False)
            end = cut
            for _ in range(LONGEST - 1):
                end = _next(part, _next(part, end, True), False)
            yield lo, part[at:end], np.array([0, end - at]), cut - at
            at = cut


def _words(data: np.ndarray, offs: np.ndarray, owned: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Starts and ends of the words, their rows, the number of each one's piece, and how many words are owned."""
    starts, ends = spans(data, offs, _WORD)
    rows = row_of(offs, starts)
    piece = np.cumsum(_END[data])[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (rows[1:] != rows[:-1])
    return starts, ends, rows, np.cumsum(new), int(np.searchsorted(starts, owned))


def _gram(words: np.ndarray, of_lang: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hashes of the k words from each place on, of its language; places too near the end are left out."""
    n = max(0, len(words) - k + 1)
    h = of_lang[:n] + np.uint64(salt)
    for j in range(k):
        h = mix((h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15))
    return h


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _hash_text(data: bytes) -> int:
    a = np.frombuffer(data, np.uint8)
    return int(span_hashes(a, np.array([0]), np.array([len(a)]))[0]) if len(a) else 0


def _scan(k: int, bits: int, least: int, known, buckets):
    """The task of pass k: known, buckets: broadcast bitmaps of phrases of k - 1 words and of buckets of k words (none for k = 1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: dict[tuple[str, bytes], int] = {}
        table = np.zeros(1 << bits, np.uint8) if k < LONGEST else None
        lang_hash: dict[str, int] = {}
        task = TaskContext.get().partitionId()
        may = [np.unpackbits(b.value).view(bool) if b is not None else None for b in (known, buckets)]

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in counts], pa.string()), "phrase": pa.array([x for _, x in counts], pa.binary()), "n": pa.array(list(counts.values()), pa.int64()), "piece": pa.nulls(len(counts), pa.int32()), "task": pa.nulls(len(counts), pa.int32()), "at": pa.nulls(len(counts), pa.binary()), "sums": pa.nulls(len(counts), pa.binary())})
            counts.clear()
            return out

        def take(langs: list[str], data: np.ndarray, offs: np.ndarray, owned: int) -> None:
            starts, ends, rows, run, n_own = _words(data, offs, owned)
            words = span_hashes(data, starts, ends)
            low = LOWER[data].tobytes()
            of_lang = np.array([lang_hash.setdefault(x, _hash_text(x.encode())) for x in langs], np.uint64)[rows] if len(rows) else np.zeros(0, np.uint64)
            whole = run[: len(run) - k + 1] == run[k - 1 :] if len(run) >= k else np.zeros(0, bool)
            h = _gram(words, of_lang, k, k)
            ok = whole.copy()
            if k > 1:
                part = may[0][_place(_gram(words, of_lang, k - 1, k - 1), bits)]
                ok &= part[: len(ok)] & part[1 : len(ok) + 1] & may[1][_place(h, bits)]
            at = np.flatnonzero(ok[:n_own])
            if table is not None and len(ok) > 1:
                both = np.flatnonzero(ok[:-1][:n_own] & ok[1:][:n_own] & (run[: len(run) - k] == run[k:])[:n_own])
                b, c = np.unique(_place(_gram(words, of_lang, k + 1, k + 1)[both], bits), return_counts=True)
                table[b] = np.minimum(table[b] + c, least).astype(np.uint8)
            if not len(at):
                return
            second = mix((h[at] ^ np.uint64(0x51ED270B7F4A7C15)) + _gram(mix(words + np.uint64(0xD1B54A32D192ED03)), of_lang, k, 99)[at])
            order = np.lexsort((second, h[at]))
            a, b = h[at][order], second[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            for i, c in zip(at[order[first]].tolist(), np.diff(np.append(first, len(a))).tolist(), strict=True):
                phrase = b" ".join(low[starts[j] : ends[j]] for j in range(i, i + k))
                key = langs[rows[i]], phrase
                counts[key] = counts.get(key, 0) + c

        for batch in batches:
            langs = [x if x is not None else "und" for x in batch.column(0).to_pylist()]
            for lo, data, offs, owned in _segments(*string_buffer(batch.column(1))):
                take(langs[lo : lo + len(offs) - 1], data, offs, owned)
                if len(counts) >= FLUSH:
                    yield counted()
        yield counted()
        for p in range(0, 1 << bits, _PIECE) if table is not None else []:
            if (x := table[p : p + _PIECE]).any():
                yield _sums(x, p // _PIECE, task // 64)

    return scan


def _sums(x: np.ndarray, piece: int, task: int) -> pa.RecordBatch:
    """A piece of a bucket table: places and bytes where few are set, else the bytes."""
    some = np.flatnonzero(x)
    at = some.astype(np.uint16).tobytes() if 3 * len(some) < len(x) else None
    return pa.RecordBatch.from_pydict({"lang": pa.nulls(1, pa.string()), "phrase": pa.nulls(1, pa.binary()), "n": pa.nulls(1, pa.int64()), "piece": pa.array([piece], pa.int32()), "task": pa.array([task], pa.int32()), "at": pa.array([at], pa.binary()), "sums": pa.array([(x[some] if at is not None else x).tobytes()], pa.binary())})


_SCAN = "lang string, phrase binary, n long, piece int, task int, at binary, sums binary"


def _bitmap_of_buckets(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """The buckets that reach the least count, as bits. The driver gets one bit a bucket, 2^bits in all."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(_PIECE, np.int64)
        for at, sums in zip(t.column("at").to_pylist(), t.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(sums, np.uint8)
            if at is None:
                total[: len(x)] += x
            else:
                total[np.frombuffer(at, np.uint16)] += x
        return pa.table({"piece": t.column("piece")[:1], "task": pa.array([t.column("task")[0].as_py() // 64], pa.int32()), "at": pa.nulls(1, pa.binary()), "sums": pa.array([np.minimum(total, least).astype(np.uint8).tobytes()], pa.binary())})

    def reached(t: pa.Table) -> pa.Table:
        return pa.table({"piece": t.column("piece")[:1], "bits": pa.array([np.packbits(np.frombuffer(add(t).column("sums")[0].as_py(), np.uint8) >= least).tobytes()], pa.binary())})

    parts = rows.where("piece is not null").select("piece", "task", "at", "sums")
    for _ in range(2):
        parts = parts.groupBy("piece", "task").applyInArrow(add, "piece int, task int, at binary, sums binary")
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in parts.groupBy("piece").applyInArrow(reached, "piece int, bits binary").collect():
        x = np.frombuffer(r["bits"], np.uint8)[: len(out)]
        out[r["piece"] * _PIECE // 8 :][: len(x)] = x
    return out


def _bitmap_of_phrases(frequent: DataFrame, k: int, bits: int) -> np.ndarray:
    """Where the frequent phrases of k words are hashed to, as bits."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = np.array([_hash_text(w) for w in phrase.split(b" ")], np.uint64)
                found.add(int(_place(_gram(words, np.full(len(words), _hash_text(lang.encode()), np.uint64), k, k), bits)[0]))
            yield pa.RecordBatch.from_pydict({"place": pa.array(sorted(found), pa.int32())})

    out = np.zeros(max(8, 1 << bits), bool)
    out[frequent.select("lang", "phrase").mapInArrow(places, "place int").distinct().toArrow().column("place").to_numpy()] = True
    return np.packbits(out)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of the phrases of 1 to longest words that occur at least so often, and (lang, n), all words of each language. least is at most 255."""
    assert 1 <= least <= 255 and 2 <= longest <= LONGEST and 3 <= bits <= 30
    spark = docs.sparkSession
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    known = buckets = None
    found, total = [], None
    for k in range(1, longest + 1):
        pass_rows = materialise(rows.mapInArrow(_scan(k, bits, least, known, buckets), _SCAN), f"phrases{k}")
        counted = pass_rows.where("piece is null")
        if k == 1:
            total = materialise(counted.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        frequent = materialise(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("k", F.lit(k)), f"frequent{k}")
        found.append(frequent)
        if k < longest:
            known = spark.sparkContext.broadcast(_bitmap_of_phrases(frequent, k, bits))
            buckets = spark.sparkContext.broadcast(_bitmap_of_buckets(pass_rows, bits, least))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("lang", F.decode("phrase", "UTF-8").alias("phrase"), "k", "f"), total


def score(frequent: DataFrame, total: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score: of each phrase of two words or more, the cut into a first part (l) and a rest (r) with the lowest floor(1000 a n / (l r)); of equal ones the first cut."""
    words = F.split("phrase", " ")
    cuts = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("_cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "_cut", F.array_join(F.slice("_w", F.lit(1), F.col("_cut")), " ").alias("_first"), F.array_join(F.slice("_w", F.col("_cut") + 1, F.col("k")), " ").alias("_rest"))
    of = lambda part, count: frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    met = cuts.join(of("_first", "l"), ["lang", "_first"]).join(of("_rest", "r"), ["lang", "_rest"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    met = met.withColumns({"_over": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "_under": wide("l") * wide("r")})
    best = met.withColumn("score", F.expr("_over div _under")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "_cut", "k", "a", "l", "r", "n")).alias("x"))
    return best.select("lang", "phrase", "x.k", "x.a", "x.l", "x.r", "x.n", "x.score")


def without_parts(scored: DataFrame, frequent: DataFrame) -> DataFrame:
    """scored without phrases that stand in a longer one as often as anywhere. A phrase in a longer one of equal count stands so in one with one word more as well, so its neighbours by a word are all that is asked."""
    words = F.split("phrase", " ")
    longer = frequent.where("k > 2").select("lang", F.col("f").alias("_f"), F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k")), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    return scored.join(most, ["lang", "phrase"], "left").where(~F.coalesce(F.col("_f") >= F.col("a"), F.lit(False))).drop("_f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases, highest score first, then most frequent, then by their bytes."""
    frequent, total = frequent_phrases(docs, least=least, bits=bits)
    kept = without_parts(score(frequent, total), frequent)
    order = (F.desc("score"), F.desc("a"), "phrase")
    share = F.pmod(F.xxhash64("phrase"), F.lit(_SHARES))
    best = kept.withColumn("_share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, [z FOR z IN string_split_regex(piece, '[\\x20\\x09]+') IF z <> ''] AS ws FROM p),
tot AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w WHERE len(ws) > 0 GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM c JOIN tot ON tot.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
lo AS (SELECT lang, f, k, string_split(phrase, ' ') AS ws FROM f WHERE k > 2),
sub AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS f FROM (SELECT lang, f, k, ws, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM lo)) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN sub ON sub.lang = b.lang AND sub.phrase = b.phrase WHERE coalesce(100 * sub.f < 100 * b.a, TRUE))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000"""
