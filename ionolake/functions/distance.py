"""Call distances that know how a mode confuses characters: edit distance whose substitutions cost what the characters' codes differ by."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Morse code of letters, digits and the slash.
MORSE = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789/", ".- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. ----- .---- ..--- ...-- ....- ..... -.... --... ---.. ----. -..-.".split(), strict=True))
#: Teleprinter code (ITA2), after the shift that it needs.
BAUDOT = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789/", (
    "L00011 L11001 L01110 L01001 L00001 L01101 L11010 L10100 L00110 L01011 L01111 L10010 L11100 L01100 L11000 L10110 L10111 L01010 L00101 L10000 L00111 L11110 L10011 L11101 L10101 L10001 "
    "F10110 F10111 F10011 F00001 F01010 F10000 F10101 F00111 F00110 F11000 F11101"
).split(), strict=True))
UNKNOWN_COST = 2


def _edits(a: str, b: str, sub) -> int:
    """Least cost to turn a into b: one for a character more or less, sub(x, y) for another."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (0 if x == y else sub(x, y)))
    return row[-1]


@dataclass(frozen=True)
class Weights:
    """What the edits of codes cost: a sign more or less, a sign for another, and what a whole difference of codes is scaled to."""

    insert_delete: int = 1
    substitute: int = 2
    scale: int = 2


@lru_cache(maxsize=None)
def code_cost(code: str, x: str, y: str, weights: Weights = Weights()) -> int:
    """What a character costs for another: the edits between their codes over the longer code's length and one, scaled and rounded up."""
    table = MORSE if code == "morse" else BAUDOT
    if x == y:
        return 0
    if x not in table or y not in table:
        return UNKNOWN_COST
    p, q = table[x], table[y]
    edits = _edits(p, q, lambda *_: weights.substitute / weights.insert_delete) * weights.insert_delete
    return max(1, math.ceil(edits / (max(len(p), len(q)) + 1) * weights.scale))


def call_distance(a: str, b: str, model: str = "plain", weights: Weights = Weights()) -> int:
    return _edits(a, b, (lambda *_: 1) if model == "plain" else lambda x, y: code_cost(model, x, y, weights))


def register(spark: SparkSession) -> None:
    """call_distance(a, b, model) for SQL; model is plain, morse or baudot."""

    @F.pandas_udf("long")
    def distance(a, b, m):
        import pandas as pd

        return pd.Series([None if p is None or q is None else call_distance(p, q, k or "plain") for p, q, k in zip(a, b, m, strict=True)], dtype="Int64")

    spark.udf.register("call_distance", distance)


def model_of(mode: Column | str) -> Column:
    """morse for CW, baudot for RTTY, plain for the rest."""
    m = F.upper(F.col(mode) if isinstance(mode, str) else mode)
    return F.when(m == "CW", "morse").when(m == "RTTY", "baudot").otherwise("plain")


@lru_cache(maxsize=1 << 15)
def _known_pair(a: str, b: str, model: str, weights: Weights) -> int:
    """call_distance, which a worker keeps for the pairs that it met last."""
    return call_distance(a, b, model, weights)


def with_distance(df: DataFrame, a: str, b: str, mode: str, out: str = "distance", weights: Weights = Weights()) -> DataFrame:
    """df with the distance of two call columns under the mode's model. Plain distances are native; keyed ones run in Python, in the tasks that hold the rows: df is neither read twice nor shuffled, and a worker works a pair out once while it keeps it."""

    @F.pandas_udf("long")
    def keyed(x, y, m):
        import pandas as pd

        return pd.Series([None if k is None or p is None or q is None else _known_pair(p, q, k, weights) for p, q, k in zip(x, y, m, strict=True)], dtype="Int64")

    model = model_of(mode)
    return df.withColumn("_keyed", keyed(a, b, F.when(model != "plain", model))).withColumn(out, F.coalesce("_keyed", F.levenshtein(F.col(a), F.col(b)).cast("long"))).drop("_keyed")
