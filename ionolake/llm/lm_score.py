"""Language-model scores by logistic context mixing over hashed byte contexts.

A text is its bytes with A-Z lower-cased and one end byte. Each byte is coded as eight binary decisions. For every order
1 to ORDERS, the last bytes and the bits already known of this byte are hashed to a slot of that order's table, whose counts of
zeros and ones give a bit probability. The predictions are stretched, combined by a weight vector that a gate picks (the bit's place
and how many orders have seen their context), squashed, and refined by an adaptive probability map over (known bits, stretched
prediction). total bits / bytes is bits_per_byte; score is the text's log10 probability.

Counts come from every training document: byte (ORDERS+1)-grams are counted in each task, summed by Spark, and turned into slots with
the grams in context order, so each task meets a context once. The tables have 2^SLOT_BITS slots an order however large the corpus
is, and are broadcast. The mixer's weights and the map (some thousand numbers) learn from every counted gram, as often as it occurs; there
each occurrence is taken out of the counts before it is predicted, as if it had not been seen. A gate's weights are a logistic
regression: STEPS passes over the grams sum its gradient and a bound of its curvature (Jaakkola and Jordan's, so that no step loses) in each
task, Spark adds them, and the driver solves a system of ORDERS + 1 unknowns a gate; a last pass sums the map. What is learned is rounded, so that the order of sums doesn't show in it.
After that everything is frozen, so a text's score doesn't depend on its neighbours or its partition.

A byte's probability depends on its last ORDERS bytes alone, so scoring keeps the grams it has evaluated in a table of fixed size,
which a Python worker keeps over its tasks; what is kept is what is returned, so a score doesn't depend on it. The nodes of
half a byte share 16 neighbouring slots, so a gram reads two places of each order's table.

The base score needs each token's training count. Tokens of at least 1/2^20 of all (so at most 2^20 of them) are broadcast; the others are
joined as (row, token) pairs, and summed back by row.

Cases: null text is the empty text (one end token); null doc_id is in no held-out fold and not learned from; rows that repeat
are scored alike and counted as often as they occur; with no training token N and V are 0 and the base is 0 for each token's c+0.5 over 0.5; an empty table gives no rows; extra columns are ignored, whatever their names;
a text is scored whole, however long, and equal grams of it are evaluated once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TOKEN_BYTES, chunks, fold_of, materialise, mix, row_of, span_hashes, spans, string_buffer, sums_by_row

ORDERS = 6
SLOT_BITS = 22
#: Passes over the counted grams that the mixer's weights take, and how far each goes: with less than twice the bound's own step none loses.
STEPS = 4
STRIDE = 1.9
#: Occurrences that a gate's first weights, and a cell of the map, count for.
PRIOR = 50
HEAVY_BITS = 20
_MAP = 24
_HELD_OUT = 1
_END = np.uint64(0x5EED)
_GRAM_PIECE = 3 << 20
_MEMO_BITS = 21
_CHUNK = 1 << 19
_SCORED_AT_ONCE = 1 << 14
_DIGITS = 6
#: Pairs of a gate's inputs: the upper triangle, by row.
_PAIRS = [(i, j) for i in range(ORDERS + 1) for j in range(i, ORDERS + 1)]
_SLOPES = ORDERS + 1 + len(_PAIRS)
_PIECE_BITS = 16


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A gram for each byte and each row's end: the last byte in the highest of ORDERS places, the byte itself in the lowest; and each row's first gram."""
    n, rows = len(data), len(offs) - 1
    pad = ORDERS + 1  # before each row ORDERS zero bytes, after it the end byte, zero too
    out = np.zeros(n + rows * pad, np.uint64)
    shift = np.repeat(np.arange(rows), np.diff(offs)) * pad + ORDERS
    out[np.arange(n) + shift] = LOWER[data]
    full = np.zeros(len(out), np.uint64)
    full |= out
    for k in range(1, ORDERS + 1):
        full[k:] |= out[:-k] << np.uint64(8 * (ORDERS + 1 - k))
    keep = np.ones(len(out), bool)
    begin = offs[:-1] + np.arange(rows) * pad
    for k in range(ORDERS):
        keep[begin + k] = False
    return full[keep], offs + np.arange(rows + 1)


def _group(order: int, gram: np.ndarray, nibble: np.ndarray | int) -> np.ndarray:
    """A slot of that order's table for (context of that order, nibble): 0 before the byte's first half is known, 16 and more (16 plus that half) after it."""
    context = gram >> np.uint64(8 * (ORDERS + 1 - order))
    z = (context << np.uint64(8) | np.uint64(nibble)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)
    return (mix(z) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slots(order: int, gram: np.ndarray, node: np.ndarray, bit: int) -> np.ndarray:
    """The slot of (context of that order, node) in that order's table; the 15 nodes of half a byte share 16 neighbouring slots."""
    if bit < 4:
        return _group(order, gram, 0) ^ node.astype(np.int64)
    known = np.uint64(bit - 4)
    low = np.uint64((1 << (bit - 4)) - 1)
    return _group(order, gram, node >> known) ^ (node & low | np.uint64(1) << known).astype(np.int64)


def _count_unique(x: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often (or the sum of w)."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    if w is not None:
        o = np.argsort(x, kind="stable")
        x, w = x[o], w[o]
    else:
        x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[at], np.diff(np.append(at, len(x))) if w is None else np.add.reduceat(w, at)


class _Counter:
    """Counts of uint64 keys, emitted whenever so many distinct ones are held: memory stays bounded."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, x: np.ndarray) -> None:
        self.held.append(_count_unique(x))
        self.size += len(self.held[-1][0])
        if self.size > 3 * _GRAM_PIECE // 4:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self.held = [_count_unique(np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held]))]
            self.size = len(self.held[0][0])
        return self.held[0] if self.held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _training_counts(docs: DataFrame) -> DataFrame:
    """kind (0 token, 1 gram), k (hash or gram), c, over all training documents; a task hands on each key about once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (_Counter(), _Counter())

        def out(kind: int, counter: _Counter) -> Iterator[pa.RecordBatch]:
            k, c = counter.merge()
            for at in range(0, len(k), 100_000):
                part = k[at : at + 100_000]
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(part), kind, np.int8)), "k": pa.array(part.view(np.int64)), "c": pa.array(c[at : at + 100_000])})
            counter.held, counter.size = [], 0

        for b in batches:
            for _, _, data, offs in chunks(*string_buffer(b.column(0)), _CHUNK):
                kinds[0].add(np.append(span_hashes(data, *spans(data, offs, TOKEN_BYTES)), np.full(len(offs) - 1, _END)))
                kinds[1].add(_grams(data, offs)[0])
            for kind, counter in enumerate(kinds):
                if counter.size > _GRAM_PIECE // 2:
                    yield from out(kind, counter)
        for kind, counter in enumerate(kinds):
            yield from out(kind, counter)

    learned = docs.where(fold_of("doc_id") != _HELD_OUT).select("text")
    return learned.mapInArrow(count, "kind byte, k long, c long").groupBy("kind", "k").agg(F.sum("c").alias("c"))


def _slot_pieces(grams: DataFrame) -> DataFrame:
    """piece, codes: the 2^_PIECE_BITS slots of each piece of the tables (order * 2^SLOT_BITS + slot), as their codes of zeros, then of ones.

    Grams come sorted by context, so a task holds a context's counts together. A task hands on its non-empty slots as packed
    arrays by piece; these are added 64 tasks at a time."""

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], task: int) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        place, n0, n1 = (np.concatenate(x) for x in zip(*held, strict=True))
        o = np.argsort(place, kind="stable")
        place, n0, n1 = place[o], n0[o], n1[o]
        at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        place, n0, n1 = place[at], np.add.reduceat(n0, at), np.add.reduceat(n1, at)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(place >> _PIECE_BITS) != 0]))
        ends = np.append(cuts[1:], len(place))
        rows = [(int(place[i] >> _PIECE_BITS), task, _pack(place[i:j], n0[i:j], n1[i:j])) for i, j in zip(cuts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["piece", "task", "slots"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size = TaskContext.get().partitionId() // 64, [], 0
        low = np.uint64(0xFF)
        for b in batches:
            gram, c = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().astype(np.int64)
            for order in range(1, ORDERS + 1):
                short = (gram >> np.uint64(8 * (ORDERS + 1 - order)) << np.uint64(8)) | (gram & low)
                seen, total = _count_unique(short, c)
                whole = (seen >> np.uint64(8) << np.uint64(8 * (ORDERS + 1 - order))) | (seen & low)
                sym = seen & low
                for bit in range(8):
                    node = (np.uint64(1) << np.uint64(bit)) | (sym >> np.uint64(8 - bit))
                    one = ((sym >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
                    key = (seen & ~low) | node  # ascending, as seen is
                    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
                    if len(at):
                        n1, n = np.add.reduceat(total * one, at), np.add.reduceat(total, at)
                        held.append((_slots(order, whole[at], node[at], bit) + ((order - 1) << SLOT_BITS), n - n1, n1))
                        size += len(at)
            if size > _GRAM_PIECE // 2:
                yield from flush(held, task)
                held, size = [], 0
        yield from flush(held, task)

    def total(t: pa.Table, last: bool) -> pa.Table:
        n = np.zeros((2, 1 << _PIECE_BITS), np.int64)
        for raw in t.column("slots"):
            for k, (place, count) in enumerate(_unpack(raw.as_py())):
                n[k, place] += count
        out = np.rint(8 * np.log2(1 + n)).clip(0, 255).astype(np.uint8).tobytes() if last else _pack(np.flatnonzero(n.any(axis=0)), *n[:, n.any(axis=0)])
        return pa.table({"piece": t.column("piece")[:1], "task": pa.array([0], pa.int32()), "slots": pa.array([out], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        return total(t, False)

    def finish(t: pa.Table) -> pa.Table:
        return total(t, True)

    schema = "piece int, task int, slots binary"
    ordered = grams.repartitionByRange("k").sortWithinPartitions("k").select("k", "c").mapInArrow(nodes, schema)
    return ordered.groupBy("piece", "task").applyInArrow(add, schema).groupBy("piece").applyInArrow(finish, schema)


def _pack(place: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> bytes:
    """Slots and counts of one piece: places within it, counts up to 254 as bytes, the others after them in full."""
    out = [np.int32(len(place)).tobytes(), (place & ((1 << _PIECE_BITS) - 1)).astype(np.uint16).tobytes()]
    out += [np.minimum(n, 255).astype(np.uint8).tobytes() for n in (n0, n1)]
    return b"".join(out + [n[n > 254].astype(np.int64).tobytes() for n in (n0, n1)])


def _unpack(raw: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    m = int(np.frombuffer(raw, np.int32, 1)[0])
    place, at, out = np.frombuffer(raw, np.uint16, m, 4).astype(np.int64), 4 + 4 * m, []
    for k in range(2):
        n = np.frombuffer(raw, np.uint8, m, 4 + (2 + k) * m).astype(np.int64)
        over = np.flatnonzero(n == 255)
        n[over] = np.frombuffer(raw, np.int64, len(over), at)
        at += 8 * len(over)
        out.append((place, n))
    return out


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


#: What a slot's code (8 log2(1 + n), rounded) stands for; exact for n under 11.
_COUNT = np.rint(2.0 ** (np.arange(256) / 8) - 1)


class Mixer:
    """The model. codes: counts of zeros and of ones by order and slot, kept side by side as one number; weights by gate; map by (known bits, bucket)."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = np.ascontiguousarray(np.moveaxis(codes, 0, -1)).view("<u2")[..., 0]
        n0, n1 = _COUNT[None, :], _COUNT[:, None]
        self.stretched = np.where(n0 + n1 > 0, np.log((n1 + 0.4) / (n0 + 0.4)), 0).ravel().astype(np.float32)
        self.sure = self._sure(n0 + n1).ravel()
        # the same with one zero less, then with one one less
        less = [(np.maximum(n0 - (1 - bit), 0), np.maximum(n1 - bit, 0)) for bit in (0, 1)]
        self.stretched_less = np.concatenate([np.where(a + b > 0, np.log((b + 0.4) / (a + 0.4)), 0).ravel() for a, b in less]).astype(np.float32)
        self.sure_less = np.concatenate([self._sure(a + b).ravel() for a, b in less])
        self.weights, self.map = self.first()
        self._memo: _Memo | None = None

    @staticmethod
    def _sure(n: np.ndarray) -> np.ndarray:
        return np.minimum(np.log2(n + 1) / 1.5, 7).astype(np.uint8)

    @staticmethod
    def _gate(bit: int, seen: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """By the bit's place, how many orders have seen their context, and how often the longest of them has."""
        return (bit * (ORDERS + 1) + seen) * 8 + sure

    @staticmethod
    def _buckets(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = np.clip(s, -11.4, 11.4) + (_MAP - 1) / 2
        lo = f.astype(np.int64)  # f is positive
        return lo, f - lo

    @staticmethod
    def first() -> tuple[np.ndarray, np.ndarray]:
        """Weights and map before anything is learned."""
        weights = np.full((64 * (ORDERS + 1), ORDERS + 1), 0.35, np.float64)
        weights[:, ORDERS] = 0
        return weights, np.tile(_squash((np.arange(_MAP) - (_MAP - 1) / 2) / 1.0), (256, 1))

    def adopt(self, weights: np.ndarray, map_: np.ndarray) -> Mixer:
        """The model with these; what it remembers of others is dropped."""
        if not (np.array_equal(weights, self.weights) and np.array_equal(map_, self.map)):
            self.weights, self.map, self._memo = weights, map_, None
        return self

    def _inputs(self, gram: np.ndarray, less: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit: the node, the bit, the stretched predictions by order (until the next bit) and the gate. less: with the bit itself taken out of the counts."""
        sym = (gram & np.uint64(0xFF)).astype(np.int64)
        stretched, sure_of = (self.stretched_less, self.sure_less) if less else (self.stretched, self.sure)
        x = np.empty((ORDERS, len(gram)), np.float32)
        for half in (0, 4):
            groups = [_group(order, gram, 0 if half == 0 else 16 | (sym >> 4).astype(np.uint64)) for order in range(1, ORDERS + 1)]
            for bit in range(half, half + 4):
                node, one = 1 << bit | sym >> (8 - bit), sym >> (7 - bit) & 1
                local = 1 << (bit - half) | node & ((1 << (bit - half)) - 1)
                sure, seen = np.zeros(len(gram), np.uint8), np.zeros(len(gram), np.uint8)
                for k in range(ORDERS):
                    pair = self.codes[k].take(groups[k] ^ local).astype(np.intp)
                    if less:
                        pair |= one << 16
                    stretched.take(pair, out=x[k], mode="clip")
                    here = sure_of.take(pair)
                    np.copyto(sure, here, where=here > 0)
                    seen += x[k] != 0
                yield node, one, x, self._gate(bit, seen.astype(np.intp), sure)

    @staticmethod
    def _mixed(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """weights: by input, then gate."""
        s = weights[ORDERS].take(gate)
        for k in range(ORDERS):
            s += x[k] * weights[k].take(gate)
        return s

    def slopes(self, gram: np.ndarray, c: np.ndarray) -> np.ndarray:
        """By gate, over these grams, each c times: the gradient of the log probability by weight, then a bound of its negated curvature by pair of weights (upper triangle)."""
        weights, n = np.ascontiguousarray(self.weights.T, np.float32), len(self.weights)
        out = np.zeros((n, _SLOPES))
        for _, one, x, gate in self._inputs(gram, less=True):
            s = self._mixed(weights, x, gate)
            half = np.maximum(np.abs(s), 1e-3) / 2
            error, curve = c * (one - _squash(s)), c * (np.tanh(half) / (4 * half))
            rows = [*x, np.ones(len(gram), np.float32)]
            for k, (i, j) in enumerate(_PAIRS, ORDERS + 1):
                if i == j:
                    out[:, i] += np.bincount(gate, error * rows[i], n)
                    scaled = curve * rows[i]
                out[:, k] += np.bincount(gate, scaled * rows[j], n)
        return out

    def stepped(self, slopes: np.ndarray) -> np.ndarray:
        """The weights after a step by these; a gate's first weights count for PRIOR occurrences."""
        start = self.first()[0]
        curve = np.zeros((len(start), ORDERS + 1, ORDERS + 1))
        for k, (i, j) in enumerate(_PAIRS, ORDERS + 1):
            curve[:, i, j] = curve[:, j, i] = slopes[:, k]
        curve += PRIOR * np.eye(ORDERS + 1)
        step = np.linalg.solve(curve, (slopes[:, : ORDERS + 1] - PRIOR * (self.weights - start))[:, :, None])[:, :, 0]
        return np.round(self.weights + STRIDE * step, _DIGITS)

    def cells(self, gram: np.ndarray, c: np.ndarray) -> np.ndarray:
        """By known bits, over these grams, each c times: the occurrences in each bucket of the map, then how many of them are ones."""
        weights = np.ascontiguousarray(self.weights.T, np.float32)
        out = np.zeros((2, 256 * _MAP))
        for node, one, x, gate in self._inputs(gram, less=True):
            lo, part = self._buckets(self._mixed(weights, x, gate))
            lo += node * _MAP
            for at, share in ((lo, c * (1 - part)), (lo + 1, c * part)):
                out[0] += np.bincount(at, share, 256 * _MAP)
                out[1] += np.bincount(at, share * one, 256 * _MAP)
        return np.hstack(out.reshape(2, 256, _MAP))

    def mapped(self, cells: np.ndarray) -> np.ndarray:
        """The map of these cells; its first value counts for PRIOR occurrences."""
        return np.round((PRIOR * self.first()[1] + cells[:, _MAP:]) / (PRIOR + cells[:, :_MAP]), _DIGITS)

    def learn(self, gram: np.ndarray, c: np.ndarray | None = None) -> None:
        """What train() does, on grams at hand."""
        c = np.ones(len(gram)) if c is None else c
        for _ in range(STEPS):
            self.adopt(self.stepped(self.slopes(gram, c)), self.map)
        self.adopt(self.weights, self.mapped(self.cells(gram, c)))

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        weights = np.ascontiguousarray(self.weights.T, np.float32)
        flat_map = self.map.ravel().astype(np.float32)
        out = np.ones(len(gram))
        for node, one, x, gate in self._inputs(gram):
            s = self._mixed(weights, x, gate)
            lo, part = self._buckets(s)
            lo += node * _MAP
            refined = flat_map.take(lo) * (1 - part) + flat_map.take(lo + 1) * part
            p = np.clip((_squash(s) + refined) / 2, 1e-6, 1 - 1e-6)
            out *= np.where(one, p, 1 - p)
        return np.log10(out)

    def memo(self) -> _Memo:
        """This process's memo of the model's scores: it lasts over the tasks that a Python worker runs."""
        if self._memo is None:
            self._memo = _Memo(self)
        return self._memo


class _Memo:
    """Scores of grams by a direct-mapped table of fixed size."""

    def __init__(self, model: Mixer) -> None:
        self.model = model
        self.keys = np.full(1 << _MEMO_BITS, np.uint64(2**64 - 1), np.uint64)
        self.values = np.zeros(1 << _MEMO_BITS, np.float32)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        at = (mix(gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        out = self.values[at].astype(np.float64)
        miss = np.flatnonzero(self.keys[at] != gram)
        if len(miss):
            new, back = np.unique(gram[miss], return_inverse=True)
            value = np.concatenate([self.model.log10(new[k : k + _SCORED_AT_ONCE]) for k in range(0, len(new), _SCORED_AT_ONCE)]).astype(np.float32)  # as it is kept, so that a score doesn't depend on what came before
            out[miss] = value[back]
            self.keys[at[miss]], self.values[at[miss]] = gram[miss], value[back]
        return out


def _summed(grams: DataFrame, model, weights: np.ndarray, map_: np.ndarray, what: str, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the model's slopes() or cells() over all grams: a task hands on a row for each gate or node."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out, held, size = getattr(model.value.adopt(weights, map_), what), np.zeros(shape), [], 0

        def taken() -> np.ndarray:
            k, c = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.argsort(k)  # like contexts together
            return of(k[o].view(np.uint64), c[o].astype(np.float64))

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= _SCORED_AT_ONCE:
                out += taken()
                held, size = [], 0
        if held:
            out += taken()
        at = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x) for x in out[at].T)], names=names)

    names = ["at", *(f"x{k}" for k in range(shape[1]))]
    rows = grams.mapInArrow(sums, "at int, " + ", ".join(f"{x} double" for x in names[1:])).groupBy("at").agg(*[F.sum(x).alias(x) for x in names[1:]]).toArrow()
    total = np.zeros(shape)
    total[rows.column("at").to_numpy()] = np.stack([rows.column(x).to_numpy() for x in names[1:]], axis=1)
    return total


def train(counts: DataFrame):
    """From the counts of _training_counts(): the model as a broadcast that has learned nothing yet, and the weights and map to adopt()."""
    grams = counts.where("kind = 1").select("k", "c")
    codes = np.zeros(((ORDERS << SLOT_BITS) >> _PIECE_BITS, 1 << _PIECE_BITS, 2), np.uint8)
    for r in _slot_pieces(grams).select("piece", "slots").toLocalIterator():
        codes[r["piece"]] = np.frombuffer(r["slots"], np.uint8).reshape(2, -1).T
    model = Mixer(np.moveaxis(codes.reshape(ORDERS, -1, 2), -1, 0))
    shared = counts.sparkSession.sparkContext.broadcast(model)
    weights, map_ = model.first()
    for _ in range(STEPS):
        weights = model.adopt(weights, map_).stepped(_summed(grams, shared, weights, map_, "slopes", (len(weights), _SLOPES)))
    map_ = model.mapped(_summed(grams, shared, weights, map_, "cells", (256, 2 * _MAP)))
    return shared, weights, map_


def _scored(docs: DataFrame, trained, heavy) -> DataFrame:
    """By row: doc_id, held_out, n_tokens, n_bytes, score, and what the broadcast token counts give of the base (known, log_sum); rest and rest_n: the other tokens."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.value.adopt(weights, map_).memo()
        keys, logs = heavy.value
        for b in batches:
            for lo, hi, data, offs in chunks(*string_buffer(b.column(2)), _CHUNK):
                gram, begin = _grams(data, offs)
                total = sums_by_row(memo(gram), begin)
                starts, ends = spans(data, offs, TOKEN_BYTES)
                h, rows = span_hashes(data, starts, ends), row_of(offs, starts)
                h, rows = np.append(h, np.full(hi - lo, _END)), np.append(rows, np.arange(hi - lo))
                n_tokens = np.bincount(rows, minlength=hi - lo)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                known = np.bincount(rows[hit], minlength=hi - lo)
                log_sum = np.bincount(rows[hit], weights=logs[at[hit]] if len(keys) else None, minlength=hi - lo)
                h, rows = h[~hit], rows[~hit]
                o = np.lexsort((h, rows))
                h, rows = h[o], rows[o]
                new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]))
                times = np.diff(np.append(new, len(h))).astype(np.int32)
                cuts = pa.array(np.searchsorted(rows[new], np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column(0).slice(lo, hi - lo), "held_out": b.column(1).slice(lo, hi - lo), "n_tokens": pa.array(n_tokens), "n_bytes": pa.array(np.diff(offs)), "score": pa.array(total),
                    "known": pa.array(known), "log_sum": pa.array(log_sum.astype(np.float64)), "rest": pa.ListArray.from_arrays(cuts, pa.array(h[new].view(np.int64))), "rest_n": pa.ListArray.from_arrays(cuts, pa.array(times)),
                })

    model, weights, map_ = trained
    held = F.coalesce(fold_of("doc_id") == _HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_bytes long, score double, known long, log_sum double, rest array<long>, rest_n array<int>")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte: a row for each row of docs."""
    spark = docs.sparkSession
    counts = materialise(_training_counts(docs), "counts")
    tokens = counts.where("kind = 0").select("k", "c")
    sums = tokens.agg(F.sum("c"), F.count("*")).first()
    n, v = sums[0] or 0, sums[1]
    floor = max(1, n >> HEAVY_BITS)
    often = tokens.where(F.col("c") > floor).toArrow()  # fewer than 2^HEAVY_BITS rows: each is over 1/2^HEAVY_BITS of n
    keys, logs = often.column("k").to_numpy().view(np.uint64), np.log10(often.column("c").to_numpy() + 0.5)
    o = np.argsort(keys)
    heavy = spark.sparkContext.broadcast((keys[o], logs[o]))
    scored = materialise(_scored(docs, train(counts), heavy).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", F.col("x.rest").alias("k"), F.col("x.rest_n").alias("times"))
    c = F.coalesce("c", F.lit(0))
    light = tokens.where(F.col("c") <= floor)
    rest = rest.join(light, "k", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("log_rest"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known_rest"))
    per_token = math.log10(n + 0.5 * (v + 1))
    return scored.drop("rest", "rest_n").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("log_rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        "score", "n_bytes", (-F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
