"""Per-fund and whole-table statistics.

Each table is aggregated once per grouping; Catalyst drops the measures a
caller does not select. Rows without a fund belong to no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fundweave import fixed_values as fv
from fundweave.functions.text import number_text
from fundweave.session import shared_folder

FUND = "PortfolioName"


def money_sum(name: str) -> Column:
    """Sum of a column of amounts, the same whatever the order of rows.

    An amount counts with all its digits, as it is written, up to 18 of them behind the point. NaN counts as missing.
    Amounts from 10^9 on, whose 17 digits leave eight behind the point, are added apart, so many of them fit. Infinite
    amounts and those of 10^20 or more are added as doubles to what the others make: an infinite one gives an infinite
    sum, two of unlike sign NaN. Only several finite ones of 10^20 or more can differ in their last digits with the
    order of rows.
    """
    value = "nanvl(cast(`" + name.replace("`", "``") + "` as double), null)"

    def exact_sum(kind: str, which: str) -> Column:
        """Of some values as decimals. The filter keeps others from touching the sum, the case from being cast."""
        return F.expr(f"sum(case when {which} then try_cast({value} as {kind}) end) filter (where {which})")

    small = exact_sum("decimal(38,18)", f"abs({value}) < 1e9D")
    large = exact_sum("decimal(28,8)", f"abs({value}) >= 1e9D and abs({value}) < 1e20D")
    vast = F.expr(f"sum({value}) filter (where abs({value}) >= 1e20D)")
    some, many = F.coalesce(small, F.lit(0)), F.coalesce(large, F.lit(0))
    narrow = (some.cast("decimal(37,18)") + many.cast("decimal(37,18)")).cast("double")
    # Of a sum of 10^18 or more, six places decide the nearest double.
    wide = (some.cast("decimal(38,6)") + many.cast("decimal(38,6)")).cast("double")
    total = F.when((F.abs(some) < 1e18) & (F.abs(many) < 1e18), narrow).otherwise(wide)
    return F.when(vast.isNotNull(), vast + total).when(small.isNotNull() | large.isNotNull(), total)


def _with_fund(df: DataFrame) -> DataFrame:
    return df.filter(F.col(FUND).isNotNull())


def holdings_by_fund(holdings: DataFrame) -> DataFrame:
    """Row counts and profit sums of every fund, in one pass."""
    return (
        _with_fund(holdings).groupBy(FUND).agg(
            F.count("*").alias("holdings_count"),
            F.count_if(F.col("Qty") != 0).alias("nonzero_holdings"),
            money_sum("PL_YTD").alias("pl_ytd"),
            (money_sum("PL_YTD") / F.count("PL_YTD")).alias("avg_pl_ytd"),
            money_sum("PL_QTD").alias("pl_qtd"),
            money_sum("PL_MTD").alias("pl_mtd"),
            money_sum("PL_DTD").alias("pl_dtd"),
        )
    )


def trades_by_fund(trades: DataFrame) -> DataFrame:
    kind = F.col("TradeTypeName")
    return (
        _with_fund(trades).groupBy(FUND).agg(
            F.count("*").alias("trade_count"),
            F.count_if(kind == "Buy").alias("buy_trades"),
            F.count_if(kind == "Sell").alias("sell_trades"),
            money_sum("TotalCash").alias("total_cash"),
        )
    )


def pl_metrics(by_fund: DataFrame) -> DataFrame:
    """Long form: one row per metric and fund."""
    return by_fund.select(
        FUND,
        F.col("pl_ytd").alias("PL_YTD"), F.col("pl_qtd").alias("PL_QTD"),
        F.col("pl_mtd").alias("PL_MTD"), F.col("pl_dtd").alias("PL_DTD"),
    ).unpivot(FUND, ["PL_YTD", "PL_QTD", "PL_MTD", "PL_DTD"], "metric", "amount")


def rank_funds(by_fund: DataFrame, measure: str) -> DataFrame:
    """Positions 1..n of funds, largest first, equal values in fund order."""
    return rank_many(by_fund, measure, FUND)


def rank_many(grouped: DataFrame, measure: str, name: str) -> DataFrame:
    """Positions 1..n of any number of groups, without gathering them in one task.

    The groups are sorted over range partitions and kept in a checkpoint, so that
    every partition's length and every row's place in it stay as they are; a
    position is the place plus the lengths of the partitions before.
    """
    shared_folder(grouped.sparkSession)
    order = [F.col(measure).desc(), F.col(name).asc()]
    low = (1 << 33) - 1  # an increasing id is the partition number above 33 bits of row number
    placed = (
        grouped.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()).checkpoint()
        .withColumn("_part", F.shiftright("_at", 33))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lengths = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    offsets = lengths.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(
        *grouped.columns, (F.col("_before") + F.col("_at").bitwiseAND(low) + 1).alias("rank"))


def top_funds(by_fund: DataFrame, measure: str, n: int = fv.TOP_FUNDS) -> DataFrame:
    return by_fund.orderBy(F.col(measure).desc(), F.col(FUND).asc()).limit(n)


def trade_types(trades: DataFrame) -> list[str]:
    """The distinct trade types, refused beyond Spark's own pivot limit."""
    limit = int(trades.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = (
        _with_fund(trades).select("TradeTypeName").where("TradeTypeName is not null")
        .distinct().limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(f"more than {limit} trade types; raise spark.sql.pivotMaxValues")
    return sorted(row[0] for row in rows)


def trade_type_matrix(trades: DataFrame, types: list[str]) -> DataFrame:
    """One row per fund, one count column per type, zero where there is none."""
    counted = _with_fund(trades).where(F.col("TradeTypeName").isNotNull())
    return counted.groupBy(FUND).pivot("TradeTypeName", types).count().na.fill(0, types)


def trade_type_counts(trades: DataFrame) -> DataFrame:
    """Long zero-filled form of the matrix: each fund with trades of a known type, and each type, however many there are.

    The types are listed once and repeated for each fund; what was counted is joined to that. Nothing is pivoted, and
    nothing runs before the result is asked for.
    """
    known = _with_fund(trades).where(F.col("TradeTypeName").isNotNull())
    counted = known.groupBy(FUND, "TradeTypeName").agg(F.count("*").alias("trades"))
    types = counted.agg(F.collect_set("TradeTypeName").alias("_types"))
    every = counted.select(FUND).distinct().join(types, F.lit(True)).select(FUND, F.explode("_types").alias("TradeTypeName"))
    return every.join(counted, [FUND, "TradeTypeName"], "left").na.fill(0, ["trades"])


def fund_summary(holdings: DataFrame, trades: DataFrame, fund: str | None = None) -> DataFrame:
    """Both tables' statistics side by side; either side may be missing."""
    if fund is not None:
        holdings = holdings.filter(F.col(FUND) == fund)
        trades = trades.filter(F.col(FUND) == fund)
    left = holdings_by_fund(holdings).select(FUND, "holdings_count", "pl_ytd", "avg_pl_ytd")
    right = trades_by_fund(trades).select(FUND, "trade_count", "buy_trades", "sell_trades")
    return left.join(right, FUND, "full")


def summary_text(summary: DataFrame) -> DataFrame:
    """The summary as lines; a fund known to neither table gets the fixed notice."""
    fund = F.col(FUND)
    held, traded = F.col("holdings_count").isNotNull(), F.col("trade_count").isNotNull()
    lines = F.concat_ws(
        "\n",
        F.when(held, F.concat(F.lit("Fund: "), fund)),
        F.when(held, F.concat(F.lit("Holdings Count: "), F.col("holdings_count"))),
        F.when(held, F.concat(F.lit("Total P&L YTD: $"), number_text(F.col("pl_ytd"), 2))),
        F.when(held, F.concat(F.lit("Avg P&L YTD: $"), number_text(F.col("avg_pl_ytd"), 2))),
        F.when(traded, F.concat(F.lit("Trade Count: "), F.col("trade_count"))),
        F.when(traded, F.concat(F.lit("  Buy: "), F.col("buy_trades"),
                                F.lit(", Sell: "), F.col("sell_trades"))),
    )
    return summary.select(
        FUND,
        F.when(held | traded, lines).otherwise(F.concat(F.lit(fv.NO_FUND), fund)).alias("summary"),
    )


def summaries_for(funds: DataFrame, holdings: DataFrame, trades: DataFrame) -> DataFrame:
    """Summary texts of the asked ``funds`` (column PortfolioName), known or not."""
    return summary_text(funds.join(fund_summary(holdings, trades), FUND, "left"))


def holdings_totals(holdings: DataFrame) -> DataFrame:
    return holdings.agg(
        F.count("*").alias("total_rows"),
        F.countDistinct(FUND).alias("unique_funds"),
        F.countDistinct("SecurityId").alias("unique_securities"),
        money_sum("PL_YTD").alias("total_pl_ytd"),
    )


def trades_totals(trades: DataFrame) -> DataFrame:
    kind = F.col("TradeTypeName")
    return trades.agg(
        F.count("*").alias("total_rows"),
        F.countDistinct(FUND).alias("unique_funds"),
        F.count_if(kind == "Buy").alias("buy_trades"),
        F.count_if(kind == "Sell").alias("sell_trades"),
        money_sum("TotalCash").alias("total_cash"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.col(column).asc())
    )


def distinct_funds(holdings: DataFrame, trades: DataFrame) -> DataFrame:
    """Funds of either table, each reduced before the union."""
    return (
        _with_fund(holdings).select(FUND).distinct()
        .union(_with_fund(trades).select(FUND).distinct()).distinct()
    )


def funds_in_both(holdings: DataFrame, trades: DataFrame) -> DataFrame:
    """Funds of the trades table that the holdings table knows too."""
    return (
        _with_fund(trades).select(FUND).distinct()
        .join(_with_fund(holdings).select(FUND).distinct(), FUND, "left_semi")
    )
