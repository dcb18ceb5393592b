"""Table functions for SQL: parse_spot_line(line) and prefix_lookup(call)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

PARSED = "de_call string, khz double, dx_call string, mode string, report int, hhmm string, comment string"


@udtf(returnType=PARSED)
class ParseSpotLine:
    """A row for a feed's line that is a spot, none for other lines."""

    def eval(self, line: str):
        from ..sources.feeds import parse_line

        got = parse_line(line) if line is not None else None
        if got is not None:
            yield tuple(got.get(c.split()[0]) for c in PARSED.split(", "))


def register(spark: SparkSession, prefixes: DataFrame | None = None, prefix: str = "prefix") -> None:
    """Makes parse_spot_line(line) known to the session's SQL, and prefix_lookup(call), if a table of prefixes is given: the row of it whose key is the call's longest prefix, or none.

    Both stand in FROM, with LATERAL where they take columns. prefix_lookup is SQL itself: a call is spread into its prefixes, which meet the table in an equi-join, so Spark plans it as any other."""
    spark.udtf.register("parse_spot_line", ParseSpotLine)
    if prefixes is None:
        return
    prefixes.createOrReplaceTempView("prefix_table")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in prefixes.schema]
    fields = ", ".join(f"x.`{f.name}`" for f in prefixes.schema)
    row = ", ".join(f"'{f.name}', p.`{f.name}`" for f in prefixes.schema)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION prefix_lookup(of_call STRING) RETURNS TABLE ({", ".join(kinds)}) RETURN
        SELECT {fields} FROM (SELECT max_by(named_struct({row}), length(p.`{prefix}`)) AS x
          FROM (SELECT explode(transform(sequence(1, greatest(length(of_call), 1)), n -> substr(upper(trim(of_call)), 1, n))) AS k) s JOIN prefix_table p ON p.`{prefix}` = s.k) WHERE x IS NOT NULL"""
    )
