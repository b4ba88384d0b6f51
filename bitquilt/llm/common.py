"""Joins and random draws shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces that a hot key is split into.
SALTS = 32


def hex_number(text: Column, digits: int = 12) -> Column:
    """The leading hex digits of md5(text) as a number; also to be had in other SQL engines."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """rows join table on `key` (unique in `table`) when any key may hold a large share of `rows`.

    Rows are dealt to (key, salt); the table's row is copied to the salts that occur, at most SALTS times, so no task
    gets more than a fraction of a hot key and rare keys are not copied at all.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    wanted = salted.select(key, "_salt").where(F.col(key).isNotNull()).distinct()
    return salted.join(wanted.join(table, key), [key, "_salt"], how).drop("_salt")
