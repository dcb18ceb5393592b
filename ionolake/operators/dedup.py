"""Duplicate suppression with the stronger-report rule: within the window of its key's last forwarded row (the anchor), a row is a duplicate, unless it is the first with a report or reports stronger;
what is forwarded becomes the anchor. A row without a report counts as 0 in comparisons, and a report after it always passes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.store import stored


def primary(df: DataFrame, keys: list[str], prefer_stronger: bool = True, order: tuple[str, str] = ("t", "event_id"), report: str = "report") -> DataFrame:
    """Rows that the rule forwards where all rows of a key lie within the window: keys that hold the minute, and windows of a minute or more. Windows over the key in place of a fold, no Python, one shuffle.

    From the first report of 0 or more on, rows without a report (they count as 0) never pass, and a report passes if it beats all before it. Before that all reports are negative: a row without a report
    beats and replaces them, so it passes after a report (and as the first row), and a report passes if it beats those since the last row without."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r, first = F.col(report), F.row_number().over(w) == 1
    before = F.max(r).over(w.rowsBetween(Window.unboundedPreceding, -1))
    held = df.withColumns({"_first": first, "_before": before})
    if not prefer_stronger:
        return held.where(F.col("_first") | (r.isNotNull() & F.col("_before").isNull())).drop("_first", "_before")
    held = held.withColumns({"_after_report": F.coalesce(F.lag(r.isNotNull()).over(w), F.lit(False)), "_nulls": F.count_if(r.isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    since = F.max(r).over(Window.partitionBy(*keys, "_nulls").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("_since", since)
    late = F.coalesce(F.col("_before") >= 0, F.lit(False))
    passes = F.when(r.isNull(), F.col("_first") | (F.col("_after_report") & ~late)).when(late, r > F.col("_before")).otherwise(F.col("_since").isNull() | (r > F.col("_since")))
    return held.where(passes).drop("_first", "_before", "_after_report", "_nulls", "_since")


#: A slice's length in windows: each slice sees one window of rows before it.
_SLICE = 20


class _Anchor:
    """The last forwarded row of a key."""

    def __init__(self, window: int, prefer_stronger: bool) -> None:
        self.window, self.prefer_stronger = window, prefer_stronger
        self.at: int | None = None
        self.value, self.reported = 0, False

    def set(self, t: int | None, r: int | None) -> None:
        self.at, self.value, self.reported = t, r or 0, r is not None

    def forwards(self, t: int, r: int | None) -> bool:
        """Whether the row goes on, and is the anchor from then on."""
        if self.at is None or abs(t - self.at) >= self.window or (r is not None and not self.reported) or (self.prefer_stronger and (r or 0) > self.value):
            self.set(t, r)
            return True
        return False


def _slices(n_keys: int, window: int, prefer_stronger: bool):
    """Of rows (keys, slice, t, id, r, halo, and what else they have) in order: those forwarded for certain (kind 0), those that depend on what came before their slice (1), and each slice's last certain anchor (2)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchor, sure = None, _Anchor(window, prefer_stronger), False
        recent: deque[tuple[int, int]] = deque()  # times and values of the window before, values falling
        ends: list[tuple] = []

        def closed(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            if ends:
                given = {n_keys + 1: [x[1] for x in ends], n_keys + 3: [x[2] for x in ends]} | {j: [x[0][j] for x in ends] for j in range(n_keys + 1)}
                cols = [pa.array(given[j], f.type) if j in given else pa.nulls(len(ends), f.type) for j, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([2] * len(ends), pa.int32())], names=[*schema.names, "_kind"])
                ends.clear()

        for b in batches:
            kinds: list[int | None] = []
            for *key, t, _, r, halo in zip(*(b.column(j).to_pylist() for j in range(n_keys + 5)), strict=True):
                if key != group:
                    if sure:
                        ends.append((group, anchor.at, anchor.value if anchor.reported else None))
                    group, sure = key, False
                    recent.clear()
                while recent and recent[0][0] <= t - window:
                    recent.popleft()
                v = r or 0
                start = not recent or (prefer_stronger and r is not None and v > recent[0][1])
                while recent and recent[-1][1] <= v:
                    recent.pop()
                recent.append((t, v))
                if halo:
                    kinds.append(None)
                elif start:
                    sure = True
                    anchor.set(t, r)
                    kinds.append(0)
                elif sure:
                    kinds.append(0 if anchor.forwards(t, r) else None)
                else:
                    kinds.append(1)
            kept = pa.array([k is not None for k in kinds])
            out = b.filter(kept)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([k for k in kinds if k is not None], pa.int32())], names=[*b.schema.names, "_kind"])
            schema = b.schema
            yield from closed(schema)
        if sure:
            ends.append((group, anchor.at, anchor.value if anchor.reported else None))
            yield from closed(schema)

    return fold


def _open_rows(n_keys: int, window: int, prefer_stronger: bool):
    """Of a key's rows that depend on earlier slices (kind 1) and its slices' anchors (2), in order: the rows that are forwarded."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchor = None, _Anchor(window, prefer_stronger)
        for b in batches:
            kept = []
            kinds = b.column(b.num_columns - 1).to_pylist()
            for *key, _, t, _, r, kind in zip(*(b.column(j).to_pylist() for j in range(n_keys + 4)), kinds, strict=True):
                if key != group:
                    group = key
                    anchor.set(None, None)
                if kind == 2:
                    anchor.set(t, r)
                kept.append(kind == 1 and anchor.forwards(t, r))
            yield b.filter(pa.array(kept, pa.bool_()))

    return fold


def secondary(df: DataFrame, keys: list[str], window: int, prefer_stronger: bool = True, order: tuple[str, str] = ("t", "event_id"), report: str = "report", pass_through: str | None = None) -> DataFrame:
    """Rows that the anchor rule forwards. pass_through: SQL of rows that are always forwarded; rows without a time are, too.

    The anchor depends on what was forwarded, so rows are folded in order. Some rows are forwarded whatever the anchor is: those with no row of their key within the window before them, and reports
    that beat all rows there (the anchor is one of them, or older). So a key is cut into slices of time, spread over the tasks, each with the window before it: from the first such row on, a slice is folded by itself, in one pass.
    Only the rows before it wait for the slices before: they and each slice's last anchor, few of a key's rows, are folded by key in a second pass. Rows are shuffled once. A key whose reports are all equal and leave no gap has no
    such rows: it is sorted and streamed through one task, with one anchor held, never gathered."""
    t, row_id = order
    always = f"coalesce({pass_through}, false) or {t} is null" if pass_through else f"{t} is null"
    length = _SLICE * window
    own = [f"_key{i}" for i in range(len(keys))]
    # the row itself as a struct, whatever its columns
    x = df.where(f"not ({always})").select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.floor(F.col(t) / length).cast("long").alias("_slice"), F.col(t).cast("long").alias("_t"), F.col(row_id).cast("long").alias("_id"), F.col(report).cast("long").alias("_r"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    here = F.struct(F.col("_slice").alias("_at"), F.lit(False).alias("_halo"))
    after = F.struct((F.col("_slice") + 1).alias("_at"), F.lit(True).alias("_halo"))
    x = x.withColumn("_place", F.explode(F.when(F.col("_t") > (F.col("_slice") + 1) * length - window, F.array(here, after)).otherwise(F.array(here))))
    x = x.select(*own, F.col("_place._at").alias("_slice"), "_t", "_id", "_r", F.col("_place._halo").alias("_halo"), F.when(~F.col("_place._halo"), F.col("_row")).alias("_row"))
    names = [*own, "_slice", "_t", "_id", "_r", "_halo", "_row"]
    schema = T.StructType([*x.select(*names).schema.fields, T.StructField("_kind", T.IntegerType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    dealt = x.repartition(*own, "_slice").sortWithinPartitions(*own, "_slice", "_t", "_id")
    found = stored(dealt.mapInArrow(_slices(len(keys), window, prefer_stronger), schema), "slices")
    rest = found.where("_kind > 0").repartition(*own).sortWithinPartitions(*own, "_slice", "_kind", "_t", "_id")
    late = rest.mapInArrow(_open_rows(len(keys), window, prefer_stronger), schema)
    kept = found.where("_kind = 0").select("_row.*").unionByName(late.select("_row.*"))
    return kept.unionByName(df.where(always))


def stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """processed, duplicates: one row."""
    n = before.agg(F.count("*").alias("processed")).crossJoin(after.agg(F.count("*").alias("_kept")))  # one row by one row
    return n.select("processed", (F.col("processed") - F.col("_kept")).alias("duplicates"))
