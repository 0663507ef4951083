"""From table rows to chunks: text, packing and chunk metadata."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fundweave import fixed_values as fv
from fundweave.functions import text as tx
from fundweave.functions.tokens import TokenCounter, estimate_tokens
from fundweave.operators.packing import add_overlap, pack, pack_pieces

KEYS = ["namespace", "fund"]


def _optional(df: DataFrame, name: str, kind: str, inside: str = "") -> Column:
    return F.col(inside + name) if name in df.columns else F.lit(None).cast(kind)


def _holdings_columns(holdings: DataFrame, inside: str = "") -> dict[str, Column]:
    """The text of a position and what the chunk metadata needs, out of its columns."""
    return {
        "text": tx.holdings_text(holdings, inside),
        "security_type": _optional(holdings, "SecurityTypeName", "string", inside),
        "trade_type": F.lit(None).cast("string"),
        "pl_row": F.col(f"{inside}PL_YTD") != 0,
        "row_year": F.year(_optional(holdings, "AsOfDate", "date", inside)),
    }


def _trades_columns(trades: DataFrame, inside: str = "") -> dict[str, Column]:
    """The same for a trade."""
    return {
        "text": tx.trades_text(trades, inside),
        "security_type": _optional(trades, "SecurityType", "string", inside),
        "trade_type": _optional(trades, "TradeTypeName", "string", inside),
        "pl_row": F.lit(None).cast("boolean"),
        "row_year": F.lit(None).cast("int"),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def holdings_rows(holdings: DataFrame) -> DataFrame:
    """One text per position together with what the chunk metadata needs."""
    return holdings.filter("PortfolioName is not null").select(
        F.lit(fv.HOLDINGS).alias("namespace"), F.col("PortfolioName").alias("fund"), "row_ord", *_named(_holdings_columns(holdings)))


def trades_rows(trades: DataFrame, fund: str = "PortfolioName") -> DataFrame:
    """The same for trades; ``fund`` names the column they are packed by."""
    return trades.filter(F.col(fund).isNotNull()).select(
        F.lit(fv.TRADES).alias("namespace"), F.col(fund).alias("fund"), "row_ord", *_named(_trades_columns(trades)))


Late = Callable[[DataFrame], DataFrame]


def _unrendered(df: DataFrame, namespace: str, fund: str, names: list[str], columns: Callable[..., dict[str, Column]]) -> tuple[DataFrame, Late]:
    used = F.struct(*(name for name in dict.fromkeys(names) if name in df.columns))
    rows = df.filter(F.col(fund).isNotNull()).select(
        F.lit(namespace).alias("namespace"), F.col(fund).alias("fund"), "row_ord", used.alias("_cells"))
    return rows, lambda sorted_rows: sorted_rows.select(
        *(c for c in sorted_rows.columns if c != "_cells"), *_named(columns(df, "_cells.")))


def unrendered_holdings(holdings: DataFrame) -> tuple[DataFrame, Late]:
    """The positions before their text is made, and what makes it: together holdings_rows.

    Packing sorts rows by range, which runs all that stands before it twice and in no more tasks than the files give. Texts
    are made after it, once.
    """
    names = [*tx.places(fv.HOLDINGS_ROW), "SecurityTypeName", "PL_YTD", "AsOfDate"]
    return _unrendered(holdings, fv.HOLDINGS, "PortfolioName", names, _holdings_columns)


def unrendered_trades(trades: DataFrame, fund: str = "PortfolioName") -> tuple[DataFrame, Late]:
    """The same for trades."""
    return _unrendered(trades, fv.TRADES, fund, [*tx.places(fv.TRADES_ROW), "SecurityType", "TradeTypeName"], _trades_columns)


def _counted(rows: DataFrame, count_tokens: TokenCounter) -> DataFrame:
    return rows.withColumn("n_tokens", count_tokens(F.col("text")))


def _finish(count_tokens: TokenCounter, late: Late | None, needed: list[str] | None = None) -> Late:
    """Texts and tokens are made after the sort; a tokenizer would run twice before it. Rows keep what is ``needed`` of them."""
    def finish(rows: DataFrame) -> DataFrame:
        counted = _counted(late(rows) if late else rows, count_tokens)
        return counted if needed is None else counted.select(*KEYS, "row_ord", "n_tokens", *needed)

    return finish


def pack_rows(
    rows: DataFrame,
    overlap_tokens: int = fv.OVERLAP_TOKENS,
    count_tokens: TokenCounter = estimate_tokens,
    late: Late | None = None,
    **packing,
) -> DataFrame:
    """Rows with their token and chunk numbers. ``late`` makes the texts of unrendered rows."""
    return add_overlap(pack(rows, KEYS, late=_finish(count_tokens, late), **packing), KEYS, overlap_tokens)


def _types(piece: Column, name: str, most: int | None) -> Column:
    """All types of a chunk in alphabetical order, or the first ``most`` of them."""
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(piece, lambda r: r[name]))))
    return found if most is None else F.slice(found, 1, most)


#: What each column that describes a chunk needs of its rows; the others need nothing but their number and tokens.
_NEEDED = {"text": "text", "security_types": "security_type", "trade_types": "trade_type", "has_pl": "pl_row", "year": "row_year"}


def describe(pieces: DataFrame, most_types: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row per chunk: text in row order and metadata, or only those ``columns`` of it."""
    piece = F.col("piece")
    is_holdings = F.col("namespace") == fv.HOLDINGS
    described = {
        "chunk_id": lambda: tx.chunk_id(F.col("namespace"), F.col("fund"), F.col("chunk_no")),
        "text": lambda: F.array_join(F.transform(piece, lambda r: r["text"]), "\n"),
        "n_tokens": lambda: F.aggregate(piece, F.lit(0).cast("bigint"), lambda n, r: n + r["n_tokens"]),
        "row_count": lambda: F.size(piece).cast("bigint"),
        "security_types": lambda: _types(piece, "security_type", most_types),
        "trade_types": lambda: F.when(~is_holdings, _types(piece, "trade_type", most_types)),
        "has_pl": lambda: F.when(is_holdings, F.exists(piece, lambda r: F.coalesce(r["pl_row"], F.lit(False)))),
        "year": lambda: F.when(is_holdings, F.coalesce(F.get(piece, F.lit(0))["row_year"], F.lit(fv.DEFAULT_YEAR))),
    }
    return pieces.select(*KEYS, "chunk_no", *(made().alias(name) for name, made in described.items() if columns is None or name in columns))


def chunk_rows(
    rows: DataFrame,
    overlap_tokens: int = fv.OVERLAP_TOKENS,
    count_tokens: TokenCounter = estimate_tokens,
    late: Late | None = None,
    columns: list[str] | None = None,
    **packing,
) -> DataFrame:
    """Pack prepared rows, or unrendered ones with their ``late``, and describe the chunks. Given ``columns``, only these are
    described, and no more is stored of the rows than they need: Spark can't see through the packing what is used later."""
    if overlap_tokens <= 0:
        needed = None if columns is None else [name for column, name in _NEEDED.items() if column in columns]
        return describe(pack_pieces(rows, KEYS, late=_finish(count_tokens, late, needed), **packing), columns=columns)
    packed = pack_rows(rows, overlap_tokens, count_tokens, late, **packing)
    whole_row = F.struct(*(c for c in packed.columns if c not in (*KEYS, "chunk_no")))
    pieces = packed.groupBy(*KEYS, "chunk_no").agg(F.sort_array(F.collect_list(whole_row)).alias("piece"))
    return describe(pieces, columns=columns)


def build_chunks(holdings: DataFrame | None, trades: DataFrame | None, **packing) -> DataFrame:
    """Chunks of every fund in both tables."""
    parts = []
    if holdings is not None:
        parts.append(unrendered_holdings(holdings))
    if trades is not None:
        parts.append(unrendered_trades(trades))
    # each by itself: both texts in one compiled method are more than the JVM compiles, and ten times slower
    return reduce(DataFrame.unionByName, (chunk_rows(rows, late=late, **packing) for rows, late in parts))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Chunks per namespace and overall (null namespace)."""
    return chunks.rollup("namespace").agg(F.count("*").alias("chunks"))


def quality_report(chunks: DataFrame, max_tokens: int = fv.CHUNK_TOKENS) -> DataFrame:
    """How many chunks break each rule."""
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("without_text"),
        F.count_if(F.col("fund").isNull()).alias("without_fund"),
        F.count_if(F.col("row_count") < 1).alias("without_rows"),
        F.count_if((F.col("n_tokens") > max_tokens) & (F.col("row_count") > 1)).alias("over_limit"),
    )
