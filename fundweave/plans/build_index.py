"""The whole build: tables to chunks to stored vectors, and its renewal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fundweave import fixed_values as fv
from fundweave.functions.vectors import Embedder
from fundweave.operators import chunks as ch
from fundweave.sources import vector_table as vt


def build(
    holdings: DataFrame | None,
    trades: DataFrame | None,
    path: str,
    embed: Embedder | None = None,
    **packing,
) -> DataFrame:
    """Publish the vectors of both tables below ``path`` and return their statistics. A table without rows empties its
    namespace, one that isn't given keeps its vectors. Until all rows are written, readers see the index as it was."""
    made = ch.build_chunks(holdings, trades, **packing)
    named = [name for name, df in ((fv.HOLDINGS, holdings), (fv.TRADES, trades)) if df is not None]
    vt.publish(vt.to_vectors(made, embed), path, named)
    return vt.table_stats(vt.published(made.sparkSession, path))


def renew(
    stored: DataFrame,
    before: DataFrame,
    rows: DataFrame,
    embed: Embedder | None = None,
    **packing,
) -> DataFrame:
    """The next snapshot after ``rows`` changed; only differing funds are packed and embedded.

    ``before`` holds the fingerprints of the rows ``stored`` was made from.
    """
    changed = vt.changed_funds(before, vt.fingerprints(rows))
    affected = rows.join(changed.filter("change <> 'gone'").select("namespace", "fund"), ["namespace", "fund"], "left_semi")
    rebuilt = vt.to_vectors(ch.chunk_rows(affected, **packing), embed)
    return vt.replace_funds(stored, changed, rebuilt)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return vt.published(spark, path).filter(F.col("embedding").isNotNull())
