"""Joins on keys of which one may stand in any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted(rows: DataFrame, table: DataFrame, on: str | list[str], by: str | list[str], salts: int = SALTS, how: str = "inner") -> DataFrame:
    """rows joined with a small table on columns of which one value may stand in any share of the rows.

    Rows of one value are spread over salts by other columns, and the table is repeated for each salt.
    """
    on, by = ([x] if isinstance(x, str) else x for x in (on, by))
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")
