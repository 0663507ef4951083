"""Reading and cleaning queries over the dirty view."""

from pyspark.sql import functions as F

from fundweave import fixed_values as fv
from fundweave.operators import stats
from fundweave.session import scratch_path
from fundweave.sources import csv_tables as ct
from fundweave.workload import views
from fundweave.workload.catalog import VIEWS, query

_NA = ", ".join("'" + token + "'" for token in fv.NA_TOKENS)

VIEWS["clean_v"] = f"""
  select *, case when Qty_raw not in ({_NA}) then Qty_raw end as Qty_text,
    case when OpenDate_raw not in ({_NA}) then OpenDate_raw end as Open_text,
    case when Kind_raw not in ({_NA}) then Kind_raw end as Kind_text,
    coalesce(try_cast(Qty_text as double), 0) as Qty,
    cast(try_strptime(Open_text, '%d/%m/%y') as date) as OpenDate
  from dirty_v"""


def _as_holdings(spark, sf_dir):
    return views.dirty(spark, sf_dir).select(
        "row_ord", F.col("l_suppkey").cast("string").alias("PortfolioName"),
        F.col("Qty_raw").alias("Qty"), F.col("OpenDate_raw").alias("OpenDate"),
        F.col("OpenDate_raw").alias("CloseDate"), F.col("Kind_raw").alias("SecurityTypeName"),
        F.col("Kind_raw").alias("DirectionName"),
    )


def _as_trades(spark, sf_dir):
    return views.dirty(spark, sf_dir).select(
        "row_ord", F.col("l_suppkey").cast("string").alias("PortfolioName"),
        F.col("Qty_raw").alias("Quantity"), F.col("Qty_raw").alias("Price"),
        F.col("Kind_raw").alias("TradeTypeName"), F.col("Kind_raw").alias("SecurityType"),
        F.col("Kind_raw").alias("TradeDate"), F.col("Kind_raw").alias("SettleDate"),
    )


def _through_csv(df, name):
    path = scratch_path(df.sparkSession, name)
    df.drop("row_ord").write.option("header", True).option("escape", '"').csv(path)
    return path


@query("s1_holdings_scan", """
select l_suppkey::varchar as PortfolioName, Qty, OpenDate, coalesce(Kind_text, 'Unknown') as SecurityTypeName,
  count(*) as n
from clean_v group by all""")
def holdings_scan(spark, sf_dir):
    path = _through_csv(_as_holdings(spark, sf_dir), "holdings-csv")
    loaded = ct.load_holdings(spark, path)
    return loaded.groupBy("PortfolioName", "Qty", "OpenDate", "SecurityTypeName").agg(F.count("*").alias("n"))


@query("s2_trades_scan", """
select l_suppkey::varchar as PortfolioName, Qty as Quantity, coalesce(Kind_text, 'Unknown') as TradeTypeName,
  coalesce(Kind_text, '00:00.0') as TradeDate, count(*) as n
from clean_v group by all""")
def trades_scan(spark, sf_dir):
    path = _through_csv(_as_trades(spark, sf_dir), "trades-csv")
    loaded = ct.load_trades(spark, path)
    return loaded.groupBy("PortfolioName", "Quantity", "TradeTypeName", "TradeDate").agg(F.count("*").alias("n"))


@query("s3_missing_tokens", "select row_ord, Qty_text as qty, Open_text as opened, Kind_text as kind from clean_v")
def missing_tokens(spark, sf_dir):
    df = ct.nulls_for_missing(views.dirty(spark, sf_dir))
    return df.select("row_ord", F.col("Qty_raw").alias("qty"), F.col("OpenDate_raw").alias("opened"),
                     F.col("Kind_raw").alias("kind"))


@query("s4_day_first_dates", "select row_ord, OpenDate as opened from clean_v")
def day_first_dates(spark, sf_dir):
    return views.dirty(spark, sf_dir).select("row_ord", ct.day(F.col("OpenDate_raw")).alias("opened"))


@query("s4_bad_cells", """
select count(*) as rows, 2 * cast(count(*) filter (Open_text is not null and OpenDate is null) as bigint) as bad_cells
from clean_v""")
def bad_cells(spark, sf_dir):
    return ct.cell_report(ct.clean_holdings(_as_holdings(spark, sf_dir)))


@query("p1_holdings_numbers", "select row_ord, Qty as qty from clean_v")
def holdings_numbers(spark, sf_dir):
    return ct.clean_holdings(_as_holdings(spark, sf_dir)).select("row_ord", F.col("Qty").alias("qty"))


@query("p2_trades_numbers", """
select l_suppkey::varchar as fund, sum(Qty) as quantity, sum(Qty) as price from clean_v group by 1""")
def trades_numbers(spark, sf_dir):
    df = ct.clean_trades(_as_trades(spark, sf_dir))
    return df.groupBy(F.col("PortfolioName").alias("fund")).agg(
        F.sum("Quantity").alias("quantity"), F.sum("Price").alias("price"))


@query("p3_unknown_types", """
select coalesce(Kind_text, 'Unknown') as kind, count(*) as n from clean_v group by 1""")
def unknown_types(spark, sf_dir):
    df = ct.clean_holdings(_as_holdings(spark, sf_dir))
    return df.groupBy(F.col("DirectionName").alias("kind")).agg(F.count("*").alias("n"))


@query("p4_missing_trade_dates", """
select coalesce(Kind_text, '00:00.0') as settled, count(*) as n from clean_v group by 1""")
def missing_trade_dates(spark, sf_dir):
    df = ct.clean_trades(_as_trades(spark, sf_dir))
    return df.groupBy(F.col("SettleDate").alias("settled")).agg(F.count("*").alias("n"))


@query("p5_open_label", """
select row_ord, coalesce(strftime(OpenDate, '%Y-%m-%d %H:%M:%S'), 'Open') as close_label, OpenDate is null as is_open
from clean_v""")
def open_label(spark, sf_dir):
    return ct.clean_holdings(_as_holdings(spark, sf_dir)).select("row_ord", "close_label", "is_open")


@query("p15_absent_columns", """
select l_suppkey::varchar as fund, count(*) as n, sum(Qty) as qty from clean_v group by 1""")
def absent_columns(spark, sf_dir):
    narrow = _as_holdings(spark, sf_dir).select("PortfolioName", "Qty")
    return ct.clean_holdings(narrow).groupBy(F.col(stats.FUND).alias("fund")).agg(
        F.count("*").alias("n"), F.sum("Qty").alias("qty"))
