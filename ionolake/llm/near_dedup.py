"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is its weighted set of five-word shingles (all its words as one shingle when it has fewer).
The weight of a shingle is TF-IDF in damped form: (1 + ln tf) * (1 + IDF_SHARE * ln((1+N)/(1+df)) / ln(1+N)),
rounded to steps of 1/32 of its logarithm. The damping keeps the shingles that a large group of copies
shares (whose df is that group's size) from losing their say against the few that an edit made unique.
Document frequencies cover all documents, hashed into 2^22 counters, so the table is of one size for any corpus;
a collision raises a df and lowers a weight, alike in every document.

Plan: one pass counts df, one pass makes a K-sample ICWS signature of each document (192 bytes).
Documents of equal word sequence are one text from then on, told apart by 128 bits of hash of that sequence and named by 64 of them (or by others, where two sequences share those). Texts meet in BANDS keys of
ROWS samples each. First each bucket links its members to its least id, and those whose signature denies that link go on
to the least id left, for ROUNDS rounds. Pairs whose signatures agree enough are verified by their exact weighted Jaccard similarity,
from the whole texts, and the verified links are closed to components by alternating large-star and small-star steps.
That joins large groups of copies by few links. Each bucket that still holds more than one component is then compared across components, in blocks of
about BLOCK by BLOCK members, within tasks: the members of its largest component with all others, and those others with each other: only members that come near one of another component get a longer signature of FINE samples (a byte each), and
only pairs whose long signatures agree as those of the threshold do are verified: first each text's best partner of another component, then all others whose components still differ, each pair from
the first band that its texts share. So two texts that share a bucket are in one class by verified links or have been compared. With m members in
a bucket's largest component and k outside it, that is k (m + k) comparisons of signatures, and 2 k m / BLOCK + k k / BLOCK rows: a large group of copies with a few strays costs little; k texts that no link joins, in
one bucket, cost their square.

Cases: null or word-less texts are in a class of their own; rows that repeat a doc_id are one document, all of whose texts count (near_duplicates() gives the id its texts' least class, one_of_each()
treats each text by itself); rows of null doc_id are not compared and have no class; a text is never cut, however long (a pass over one takes some 30 bytes of memory a byte of it); an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_BYTES, chunks, materialise, mix, row_of, span_hashes, spans, string_buffer

K = 48
BANDS = 24
ROWS = 5
ROUNDS = 2
#: Members of a bucket that are compared with each other, or with another block of it, at once.
BLOCK = 256
#: Partners of a text that are listed in one row.
PARTNERS = 256
SHINGLE = 5
THRESHOLD = 0.8
#: A pair goes on if this share of its samples agrees: 3.5 standard errors under the threshold.
ESTIMATE = 0.6
#: Samples of the long signatures, a byte each, and the share that must agree for a threshold: 3.5 standard errors under it, and chance agreement of bytes on top.
FINE = 512


def fine_share(threshold: float) -> float:
    low = threshold - 3.5 * math.sqrt(threshold * (1 - threshold) / FINE)
    return low + (1 - low) / 256


IDF_SHARE = 0.25
DF_BITS = 22
ID_BITS = 22
#: Ids up to which the texts wanted are picked by a broadcast join.
BROADCAST_IDS = 200_000
#: Bytes of text of one numpy pass: a pass takes some 40 times as much memory.
_CHUNK = 1 << 19
#: Comparisons of samples that are made in one step.
_AT_ONCE = 1 << 20
STEP = 1 / 32
_POOL = 4096
_LEVELS = 160
_DF_PIECE = 1 << 14


@lru_cache(maxsize=1)
def _icws_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables that stand for ICWS's random draws, the same everywhere: -ln(u) of 16 bits (two make c ~ Gamma(2,1)), and, by weight
    level and pool place (r ~ Gamma(2,1), b ~ U(0,1)), the factor exp(-r (floor(ln w / r + b) - b + 1)) and that floor, mixed."""
    rng = np.random.default_rng(20)
    minus_log = (-np.log((np.arange(65536) + 0.5) / 65536)).astype(np.float32)
    r = rng.gamma(2.0, 1.0, _POOL)
    b = rng.random(_POOL)
    t = np.floor(np.arange(_LEVELS)[:, None] * STEP / r + b)
    factor = np.exp(-r * (t - b + 1)).astype(np.float32).ravel()
    marks = (mix((t.astype(np.int64).astype(np.uint64) + np.uint64(77)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).ravel()
    seeds = rng.integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1)
    subsets = np.array([rng.permutation(K)[:ROWS] for _ in range(BANDS)])
    fine = rng.integers(1, 1 << 63, FINE, dtype=np.uint64) | np.uint64(1)
    return minus_log, factor, marks, seeds, subsets, fine


def _shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: the distinct (row, shingle) pairs in order: row, 44-bit hash, tf; and two hashes of each row's word sequence."""
    starts, ends = spans(data, offs, WORD_BYTES)
    words, rows = span_hashes(data, starts, ends), row_of(offs, starts)
    n_rows, n = len(offs) - 1, len(words)
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    at = np.arange(n) - first[rows] if n else np.zeros(0, np.int64)
    total = np.diff(first)
    full = np.zeros(n, np.uint64)
    short = total[rows] < SHINGLE if n else np.zeros(0, bool)
    for k in range(SHINGLE):  # a multiplier for each place; the words of a short text all count into its one shingle
        there = np.zeros(n, np.uint64)
        there[: max(0, n - k)] = words[k:]
        there[at + k >= total[rows]] = 0
        full += there * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED27 * (k + 1) & (2**64 - 1))
    keep = (at + SHINGLE <= total[rows]) | (short & (at == 0)) if n else np.zeros(0, bool)
    h = mix(full[keep])
    key = (rows[keep].astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    key.sort()
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    tf = np.diff(np.append(new, len(key)))
    key = key[new]
    same = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        z = mix(words ^ np.uint64(salt)) * (mix(at.astype(np.uint64) + np.uint64(salt & 0xFFFFFFFF)) | np.uint64(1))
        total_z = np.concatenate([np.zeros(1, np.uint64), np.cumsum(z)])
        same.append(mix((total_z[first[1:]] - total_z[first[:-1]]) + total.astype(np.uint64)).view(np.int64))
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), tf, same[0], same[1]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44 - DF_BITS)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 2 and 4 bytes each."""
    most = int(counts.max(initial=0))
    return counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int32).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.int32}[len(raw) // _DF_PIECE])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by hashed shingle, and the number of documents. Each task adds up a table of one fixed size;
    the tables are added piece by piece, 64 tasks at a time, then 64 of those sums at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        df, n = np.zeros(1 << DF_BITS, np.int32), 0
        for b in batches:
            for _, _, data, offs in chunks(*string_buffer(b.column(0)), _CHUNK):
                n += len(offs) - 1
                h = np.sort(_bucket(_shingles(data, offs)[1]))
                at = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
                df[h[at]] += np.diff(np.append(at, len(h))).astype(np.int32)
        task = TaskContext.get().partitionId()
        for k in range(0, 1 << DF_BITS, _DF_PIECE) if n else []:
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k // _DF_PIECE], pa.int32()), "task": pa.array([task // 64], pa.int32()), "df": pa.array([_packed(df[k : k + _DF_PIECE])], pa.binary()), "n": pa.array([n], pa.int64())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(_DF_PIECE, np.int64)
        for x in t.column("df"):
            total += _unpacked(x.as_py())
        first = pa.array([t.column("task")[0].as_py() // 64], pa.int32())
        return pa.table({"piece": t.column("piece")[:1], "task": first, "df": pa.array([_packed(np.minimum(total, 2**31 - 1))], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    schema = "piece int, task int, df binary, n long"
    parts = docs.select("text").mapInArrow(count, schema)
    for _ in range(2):
        parts = parts.groupBy("piece", "task").applyInArrow(add, schema)
    pieces = parts.groupBy("piece").applyInArrow(add, schema).collect()
    df = np.zeros(1 << DF_BITS, np.int32)
    for p in pieces:
        df[p["piece"] * _DF_PIECE : (p["piece"] + 1) * _DF_PIECE] = _unpacked(p["df"])
    return df, pieces[0]["n"] if pieces else 0


def _idf_levels(df: np.ndarray, n: int) -> np.ndarray:
    """Log weight of a shingle's IDF part, in steps, by counter."""
    share = np.log((1 + n) / (1.0 + np.minimum(df, n))) / math.log(2 + n)
    return np.rint(np.log1p(IDF_SHARE * share) / STEP).astype(np.uint8)


def _levels(idf: np.ndarray, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
    return np.minimum(idf[_bucket(h)] + np.rint(np.log1p(np.log(tf)) / STEP).astype(np.int64), _LEVELS - 1)


def samples(h: np.ndarray, level: np.ndarray, cuts: np.ndarray, seeds: np.ndarray) -> Iterator[np.ndarray]:
    """For each seed, the ICWS sample (uint32) of each set: elements h with log weights of so many steps, the sets being the runs that begin at cuts."""
    minus_log, factor, marks = _icws_tables()[:3]
    base, low = level * _POOL, h & np.uint64(0xFFFFFFFF)
    for seed in seeds:
        z = h * seed
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xD6E8FEB86659FD93)
        place = base + (z >> np.uint64(52)).astype(np.int64)
        a = (minus_log[(z >> np.uint64(36)) & np.uint64(0xFFFF)] + minus_log[(z >> np.uint64(20)) & np.uint64(0xFFFF)]) * factor[place]
        best = (a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (low ^ marks[place])
        yield np.minimum.reduceat(best, cuts).astype(np.uint32)


def _signed(data: np.ndarray, offs: np.ndarray, idf: np.ndarray, seeds: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: each row's signature, distinct shingles, and two hashes of its word sequence."""
    rows, h, tf, h1, h2 = _shingles(data, offs)
    first = np.searchsorted(rows, np.arange(len(offs)))
    some = np.flatnonzero(np.diff(first))
    sig = np.zeros((len(offs) - 1, len(seeds)), kind)
    if len(some):
        for k, x in enumerate(samples(h, _levels(idf, h, tf), first[some], seeds)):
            sig[some, k] = x.astype(kind)
    return sig, np.diff(first), h1, h2


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, h1, h2 (of the word sequence), n (distinct shingles), sig (K uint32 samples), text_key; idf: a broadcast of _idf_levels()."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _icws_tables()[3]
        for b in batches:
            for lo, hi, data, offs in chunks(*string_buffer(b.column(2)), _CHUNK):
                sig, n, h1, h2 = _signed(data, offs, idf.value, seeds, np.uint32)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "text_key": b.column(1).slice(lo, hi - lo), "h1": pa.array(h1), "h2": pa.array(h2), "n": pa.array(n), "sig": pa.array([x.tobytes() for x in sig], pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), _text_key(), "text").where("doc_id is not null").mapInArrow(sign, "doc_id long, text_key long, h1 long, h2 long, n long, sig binary")


def _text_key() -> Column:
    """Tells apart the texts of one doc_id."""
    return F.xxhash64("text").alias("text_key")


def _band_keys(reps: DataFrame) -> DataFrame:
    """id, key, band: a row for each of the BANDS keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subsets = _icws_tables()[4]
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, K).astype(np.uint64)
            out = np.zeros((len(sig), BANDS), np.uint64)
            for j, s in enumerate(subsets):
                z = np.full(len(sig), j + 1, np.uint64)
                for c in s:
                    z = mix(z * np.uint64(0x9E3779B97F4A7C15) + sig[:, c] + np.uint64(1))
                out[:, j] = z
            yield pa.RecordBatch.from_pydict({"id": pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), "key": pa.array(out.view(np.int64).ravel()), "band": pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig)))})

    return reps.select("id", "sig").mapInArrow(keys, "id long, key long, band int")


def _agree(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (id, lead) with the share of equal samples as est."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, K) for c in (2, 3))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "lead": b.column(1), "est": pa.array((x == y).mean(axis=1))})

    own, lead = reps.select("id", "sig"), reps.select(F.col("id").alias("lead"), F.col("sig").alias("lead_sig"))
    return pairs.join(own, "id").join(lead, "lead").select("id", "lead", "sig", "lead_sig").mapInArrow(share, "id long, lead long, est double")


def _candidates(keys: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs (id, lead), lead < id, of a bucket's members and its first leads, whose signatures agree enough."""
    found = None
    for k in range(ROUNDS):
        leads = keys.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("m")).where("m > 1").drop("m")
        met = keys.join(leads, "key").where("id > lead")
        agreed = materialise(_agree(met.select("id", "lead").distinct(), reps).where(F.col("est") >= ESTIMATE).select("id", "lead"), f"agreed{k}")
        found = agreed if found is None else found.unionByName(agreed)
        if k + 1 < ROUNDS:  # those that the bucket's least id didn't match meet among themselves
            keys = materialise(met.join(agreed, ["id", "lead"], "left_anti").select("id", "key"), f"keys{k}")
    return found.distinct()


def _blocks(held: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """x, y, band, members: blocks of a bucket that are to be compared; held: key, band, id, root, block, large, rest, sig (and extra). Blocks of the largest component have numbers below 0, and meet each of the other blocks;
    those meet each other and themselves."""
    large = F.transform(F.sequence(-F.col("large"), F.lit(-1)), lambda i: F.struct(i.alias("x"), F.col("block").alias("y")))
    rest = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda i: F.struct(F.least(F.col("block"), i).alias("x"), F.greatest(F.col("block"), i).alias("y")))
    dealt = held.withColumn("at", F.explode(F.when(F.col("block") < 0, rest).otherwise(F.concat(large, rest))))
    return dealt.select("key", "band", "at.x", "at.y", F.struct("id", "root", "block", "sig", *extra).alias("member")).groupBy("key", "band", "x", "y").agg(F.collect_list("member").alias("members")).select("x", "y", "band", "members")


def _agreeing(members: pa.StructArray, x: int, y: int, least: float, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places u, v of members of block x and of block y whose roots differ and whose signatures agree in a share of at least least, how many samples agree, and all ids."""
    ids, roots, block = (members.field(k).to_numpy() for k in range(3))
    sig = np.frombuffer(b"".join(members.field(3).to_pylist()), kind).reshape(len(ids), -1)
    p, q = np.flatnonzero(block == x), np.flatnonzero(block == y)
    if len(p) * len(q) * sig.shape[1] <= _AT_ONCE:  # most buckets are small
        same = (sig[p][:, None, :] == sig[q][None, :, :]).sum(axis=2, dtype=np.uint16)
    else:
        left, right = np.ascontiguousarray(sig[p].T), np.ascontiguousarray(sig[q].T)
        same = np.zeros((len(p), len(q)), np.uint16)
        for k in range(sig.shape[1]):
            same += left[k][:, None] == right[k]
    u, v = np.nonzero((same >= least * sig.shape[1]) & (roots[p][:, None] != roots[q]))
    return p[u], q[v], same[u, v].astype(np.int64), ids


def _near(held: DataFrame, least: float) -> DataFrame:
    """id: the members that agree so much with a member of another component."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                u, v, _, ids = _agreeing(members.values, x, y, least, np.uint32)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[np.unique(np.concatenate([u, v]))])})

    return _blocks(held).mapInArrow(near, "id long").distinct()


def _best(held: DataFrame, least: float) -> DataFrame:
    """id, lead: of each member, the one of another component that agrees best with it by long signatures."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                u, v, agree, ids = _agreeing(members.values, x, y, least, np.uint8)
                a, b, agree = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([agree, agree])
                o = np.lexsort((ids[b], -agree, a))
                a, b, agree = a[o], b[o], agree[o]
                top = np.flatnonzero(np.diff(a, prepend=-1))
                yield pa.RecordBatch.from_pydict({"a": pa.array(ids[a[top]]), "b": pa.array(ids[b[top]]), "agree": pa.array(agree[top])})

    top = _blocks(held).mapInArrow(best, "a long, b long, agree long").groupBy("a").agg(F.max(F.struct("agree", "b"))["b"].alias("b"))
    return top.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("lead")).distinct()


def _all_pairs(held: DataFrame, least: float) -> DataFrame:
    """id, lead, lead < id: the pairs of different components that agree so much by long signatures, each from the first of the bands that its members share; held has the short signature too."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subsets = _icws_tables()[4]
        for b in batches:
            for x, y, band, members in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                u, v, _, ids = _agreeing(members.values, x, y, least, np.uint8)
                short = np.frombuffer(b"".join(members.values.field(4).to_pylist()), np.uint32).reshape(len(ids), -1)
                once = u < v if x == y else np.ones(len(u), bool)
                u, v = u[once], v[once]
                for k in range(0, len(u), 10_000):
                    p, q = u[k : k + 10_000], v[k : k + 10_000]
                    here = (short[p] == short[q])[:, subsets].all(axis=2).argmax(axis=1) == band
                    p, q = ids[p[here]], ids[q[here]]
                    yield pa.RecordBatch.from_pydict({"id": pa.array(np.maximum(p, q)), "lead": pa.array(np.minimum(p, q))})

    return _blocks(held, ("short",)).mapInArrow(pairs, "id long, lead long")


def _mixed(keys: DataFrame, root: DataFrame) -> DataFrame:
    """key, band, id, root, block, large, rest of the members of buckets that hold more than one component: how many blocks its largest component and the other members make, and each one's block."""
    held = keys.join(root, "id", "left").select("key", "band", "id", F.coalesce("root", "id").alias("root"))
    parts = held.groupBy("key", "root").agg(F.count("*").alias("m"))
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    mixed = parts.groupBy("key").agg(F.sum("m").alias("all"), F.max(F.struct("m", "root")).alias("most")).where(F.col("all") > F.col("most.m"))
    mixed = mixed.select("key", F.col("most.root").alias("largest"), blocks(F.col("most.m")).alias("large"), blocks(F.col("all") - F.col("most.m")).alias("rest"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    return held.join(mixed, "key").withColumn("block", F.when(F.col("root") == F.col("largest"), -1 - place("large")).otherwise(place("rest"))).drop("largest")


def _remaining(keys: DataFrame, reps: DataFrame, docs: DataFrame, idf, links: DataFrame, root: DataFrame, threshold: float, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and root after all members of each bucket have been compared with those of its other components; checked: pairs that are verified or refuted already."""
    held = materialise(_mixed(keys, root), "mixed")
    near = materialise(_near(held.join(reps.select("id", "sig"), "id"), ESTIMATE), "near")
    near = reps.join(near, "id")
    fine = materialise(_fine(docs, near.select("id", "doc", "h1", "h2"), idf).join(near.select("id", F.col("sig").alias("short")), "id"), "fine")
    held = materialise(held.drop("root").join(fine.select("id"), "id"), "mixed")
    for find in (_best, _all_pairs):
        now = held.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
        pairs = materialise(find(now.join(fine, "id"), fine_share(threshold)).join(checked, ["id", "lead"], "left_anti"), "rest")
        checked = checked.unionByName(pairs)
        new = materialise(_verified(pairs, reps, docs, idf, threshold), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            # the components so far stand for their links
            root = components(root.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(new.select(F.col("id").alias("u"), F.col("lead").alias("v"))))
    return links, root


def _id_place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def _id_bits(ids: DataFrame) -> np.ndarray:
    """Which of 2^ID_BITS places a value of the one column hashes to: keeps most other texts out of the join's shuffle, and is of one size for any input."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.unique(_id_place(b.column(0).to_numpy())).astype(np.int32))})

    out = np.zeros(1 << ID_BITS, bool)
    out[ids.mapInArrow(places, "place int").distinct().toArrow().column("place").to_numpy()] = True
    return out


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, doc and more) with text: all texts of each doc; those of other hashes than id's are for the caller to leave out."""
    ids = wanted.select("doc").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # no Python beside the join and what follows it
        return wanted.join(texts.join(F.broadcast(ids), "doc", "left_semi"), "doc").drop("doc")
    bits = docs.sparkSession.sparkContext.broadcast(_id_bits(ids))

    @F.pandas_udf("boolean")
    def hit(ids):
        import pandas as pd

        return pd.Series(bits.value[_id_place(ids.to_numpy())])

    return wanted.join(texts.where(hit("doc")), "doc").drop("doc")


def _is(b: pa.RecordBatch, lo: int, hi: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which of the texts from lo to hi are those that columns 1 and 2 name."""
    return (b.column(1).slice(lo, hi - lo).to_numpy() == h1) & (b.column(2).slice(lo, hi - lo).to_numpy() == h2)


def _fine(docs: DataFrame, wanted: DataFrame, idf) -> DataFrame:
    """id, sig (FINE bytes) of the texts in wanted (id, doc, h1, h2)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _icws_tables()[5]
        for b in batches:
            for lo, hi, data, offs in chunks(*string_buffer(b.column(3)), _CHUNK):
                sig, _, h1, h2 = _signed(data, offs, idf.value, seeds, np.uint8)
                ids = b.column(0).slice(lo, hi - lo)
                own = np.flatnonzero(_is(b, lo, hi, h1, h2))
                yield pa.RecordBatch.from_pydict({"id": ids.take(pa.array(own)), "sig": pa.array([sig[i].tobytes() for i in own], pa.binary())})

    return _texts_of(docs, wanted).select("id", "h1", "h2", "text").mapInArrow(sign, "id long, sig binary").dropDuplicates(["id"])


def _vectors(docs: DataFrame, wanted: DataFrame, idf) -> DataFrame:
    """id, share, leads, is_lead, h (sorted uint32 hashes), w (levels) of the texts in wanted (id, doc, h1, h2, share, leads, is_lead)."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(*string_buffer(b.column(6)), _CHUNK):
                rows, h, tf, h1, h2 = _shingles(data, offs)
                level = _levels(idf.value, h, tf).astype(np.uint8)
                first = np.searchsorted(rows, np.arange(hi - lo + 1))
                short = h.astype(np.uint32)
                own = np.flatnonzero(_is(b, lo, hi, h1, h2))
                hs, ws = [], []
                for i in own:
                    x = short[first[i] : first[i + 1]]
                    o = np.argsort(x, kind="stable")
                    hs.append(x[o].tobytes())
                    ws.append(level[first[i] : first[i + 1]][o].tobytes())
                take = pa.array(own + lo)
                yield pa.RecordBatch.from_pydict({"id": b.column(0).take(take), "share": b.column(3).take(take), "leads": b.column(4).take(take), "is_lead": b.column(5).take(take), "h": pa.array(hs, pa.binary()), "w": pa.array(ws, pa.binary())})

    return _texts_of(docs, wanted).select("id", "h1", "h2", "share", "leads", "is_lead", "text").mapInArrow(vectors, "id long, share int, leads array<long>, is_lead boolean, h binary, w binary")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (id, lead) of at least that weighted Jaccard similarity, with it as similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.exp(np.arange(_LEVELS) * STEP)
        for b in batches:
            sims = np.zeros(b.num_rows)
            for i, (h1, w1, h2, w2) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)):
                x, y = np.frombuffer(h1, np.uint32), np.frombuffer(h2, np.uint32)
                wx, wy = weight[np.frombuffer(w1, np.uint8)], weight[np.frombuffer(w2, np.uint8)]
                if not len(x) or not len(y):
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                hit = x[at] == y
                both = np.minimum(wx[at[hit]], wy[hit]).sum()
                sims[i] = both / (wx.sum() + wy.sum() - both)
            keep = pa.array(sims >= threshold)
            out = pa.RecordBatch.from_pydict({"id": b.column(0), "lead": b.column(1), "similarity": pa.array(sims)})
            yield out.filter(keep)

    # an id's partners in shares of about PARTNERS, a row each; its first share stands for it as a lead too, so that a text makes its vector once
    many = pairs.groupBy("id").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares"))
    dealt = pairs.select("id", "lead").join(many, "id").select("id", F.pmod(F.xxhash64("lead"), F.col("shares")).cast("int").alias("share"), "lead")
    rows = dealt.unionByName(pairs.select(F.col("lead").alias("id"), F.lit(0).alias("share"), F.lit(None).cast("long").alias("lead")))
    leads = rows.groupBy("id", "share").agg(F.collect_set("lead").alias("leads"), F.max(F.col("lead").isNull()).alias("is_lead"))
    wanted = materialise(leads.join(reps.select("id", "doc", "h1", "h2"), "id").select("id", "doc", "h1", "h2", "share", "leads", "is_lead"), "leads")
    vectors = materialise(_vectors(docs, wanted, idf).dropDuplicates(["id", "share"]), "vectors")
    own = vectors.where(F.size("leads") > 0).select("id", F.explode("leads").alias("lead"), "h", "w")
    lead = vectors.where("is_lead").select(F.col("id").alias("lead"), F.col("h").alias("lead_h"), F.col("w").alias("lead_w"))
    return own.join(lead, "lead").select("id", "lead", "h", "w", "lead_h", "lead_w").mapInArrow(compare, "id long, lead long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """id, root: the least id that each linked id (u, v of links) reaches. Large-star and small-star steps in turn until neither changes a link;
    both only take a minimum by id and join it back, so a hub's links are never gathered."""
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        edges = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def _named(signed: DataFrame) -> DataFrame:
    """id, doc (the least doc_id), sig, h1, h2 of each text. Its id is h1, or, where an earlier h2 shares that, a hash of both."""
    texts = signed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sig")).alias("x"))
    first = F.row_number().over(Window.partitionBy("h1").orderBy("h2")) == 1
    return texts.select(F.when(first, F.col("h1")).otherwise(F.xxhash64("h1", "h2")).alias("id"), F.col("x.doc_id").alias("doc"), "x.sig", "h1", "h2")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, text_key, root and alone (which name the class), class_id, n_links, copies: a row for each text of each doc_id."""
    spark = docs.sparkSession
    df, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(_idf_levels(df, n))
    signed = materialise(signatures(docs, idf), "signatures")
    # a text without words is a class of its own
    signed = signed.withColumn("alone", F.when(F.col("n") == 0, F.col("doc_id")))
    texts = signed.groupBy("h1", "h2", "alone").agg(F.min("doc_id").alias("doc"), F.countDistinct("doc_id").alias("copies"))
    reps = materialise(_named(signed.where("n > 0")), "reps")
    keys = materialise(_band_keys(reps), "keys")
    pairs = materialise(_candidates(keys, reps), "pairs")
    links = materialise(_verified(pairs, reps, docs, idf, threshold), "links")
    root = components(links.select(F.col("id").alias("u"), F.col("lead").alias("v")))
    links, root = _remaining(keys, reps, docs, idf, links, root, threshold, pairs)
    ends = links.select("id").unionByName(links.select(F.col("lead").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    of_text = reps.select("id", "doc", "h1", "h2").join(root, "id", "left").join(ends, "id", "left").select("h1", "h2", "doc", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = of_text.groupBy("root").agg(F.min("doc").alias("class_id"))
    of_text = of_text.join(least, "root").select("h1", "h2", "root", "class_id", "n_links")
    wordy = texts.where("alone is null").join(of_text, ["h1", "h2"]).select("h1", "h2", "alone", "root", "class_id", "n_links", "copies")
    wordless = texts.where("alone is not null").select("h1", "h2", "alone", F.col("h1").alias("root"), F.col("alone").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "copies")
    known = wordy.unionByName(wordless)
    known = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("alone").alias("k3"), "root", "class_id", "n_links", "copies")
    s = signed.select("doc_id", "text_key", "h1", "h2", "alone").distinct()
    return s.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("alone").eqNullSafe(F.col("k3"))).select("doc_id", "text_key", "root", "alone", "class_id", "n_links", "copies")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each doc_id: doc_id, class_id (the least doc_id of its class), n_links (verified links of its text), copies (documents of the same word sequence)."""
    return _classes(docs, threshold).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.max("copies").alias("copies"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: of its least doc_id. Texts of one doc_id that are no copies of each other all stay if that doc_id is the least of each one's class; rows of null doc_id stay."""
    kept = _classes(docs, threshold).where("doc_id = class_id").groupBy("root", "alone").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    kept = kept.select(F.col("x.doc_id").alias("_kept_id"), F.col("x.text_key").alias("_kept_text"))
    keyed = docs.withColumns({"_id_of_row": F.col("doc_id").cast("long"), "_text_of_row": F.xxhash64("text")})
    held = keyed.join(kept, (F.col("_id_of_row") == F.col("_kept_id")) & (F.col("_text_of_row") == F.col("_kept_text")), "left_semi").dropDuplicates(["_id_of_row", "_text_of_row"])
    return held.select(*docs.columns).unionByName(docs.where("doc_id is null"))
