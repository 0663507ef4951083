"""A filter of bounded size for long keys: it lets every wanted key through, and few others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^24 bits in at most 2^18 rows of 64, whatever the number of keys. With very many keys it lets more through; what
#: follows has to be exact.
BITS = 24


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def marked(df: DataFrame, key: Column, wanted: DataFrame, column: str, name: str) -> DataFrame:
    """df with a column `name`: whether its key, a long, may be among wanted[column]. The bits of the wanted keys are
    broadcast as rows of 64, so nothing of df is shuffled or leaves the JVM."""
    word, bit, bits = f"{name}_word", f"{name}_bit", f"{name}_bits"
    known = wanted.select(_place(F.col(column)).alias(bit)).groupBy(F.shiftright(bit, 6).alias(word)).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST({bit} & 63 AS INT))")).alias(bits))
    placed = df.withColumn(bit, _place(key)).withColumn(word, F.shiftright(bit, 6))
    is_set = F.coalesce(F.expr(f"shiftrightunsigned({bits}, CAST({bit} & 63 AS INT)) & 1L = 1L"), F.lit(False))
    return placed.join(F.broadcast(known), word, "left").withColumn(name, is_set).drop(word, bit, bits)


def likely(df: DataFrame, key: Column, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of df whose key may be among wanted[column]."""
    return marked(df, key, wanted, column, "_likely").where("_likely").drop("_likely")
