"""Statistics queries over holdings and trades."""

from pyspark.sql import functions as F

from fundweave.operators import context as cx, stats
from fundweave.workload import views
from fundweave.workload.catalog import VIEWS, query

VIEWS["held_v"] = """
  select PortfolioName, count(*) as holdings_count, count(*) filter (Qty <> 0) as nonzero_holdings,
    cast(sum(PL_dec) as double) as pl_ytd, cast(sum(PL_dec) as double) / count(*) as avg_pl_ytd,
    cast(sum(PL_QTD_dec) as double) as pl_qtd, cast(sum(PL_MTD_dec) as double) as pl_mtd,
    cast(sum(PL_DTD_dec) as double) as pl_dtd
  from holdings_v group by 1"""
VIEWS["traded_v"] = """
  select PortfolioName, count(*) as trade_count, count(*) filter (TradeTypeName = 'Buy') as buy_trades,
    count(*) filter (TradeTypeName = 'Sell') as sell_trades,
    cast(sum(cast(TotalCash as decimal(18,4))) as double) as total_cash
  from trades_v group by 1"""
VIEWS["summary_v"] = """
  select coalesce(h.PortfolioName, t.PortfolioName) as PortfolioName, holdings_count, pl_ytd, avg_pl_ytd,
    trade_count, buy_trades, sell_trades
  from held_v h full join traded_v t on h.PortfolioName = t.PortfolioName"""

_FUND = "NATION_3"


def _held(spark, sf_dir):
    return stats.holdings_by_fund(views.holdings(spark, sf_dir, securities=False))


def _traded(spark, sf_dir):
    return stats.trades_by_fund(views.trades(spark, sf_dir))


@query("a1_pl_by_fund", "select PortfolioName, pl_ytd from held_v")
def pl_by_fund(spark, sf_dir):
    return _held(spark, sf_dir).select("PortfolioName", "pl_ytd")


@query("a2_holdings_count", "select PortfolioName, holdings_count from held_v")
def holdings_count(spark, sf_dir):
    return _held(spark, sf_dir).select("PortfolioName", "holdings_count")


@query("a3_average_pl", "select PortfolioName, avg_pl_ytd from held_v")
def average_pl(spark, sf_dir):
    return _held(spark, sf_dir).select("PortfolioName", "avg_pl_ytd")


@query("a4_pl_metrics", """
select PortfolioName, 'PL_YTD' as metric, pl_ytd as amount from held_v
union all select PortfolioName, 'PL_QTD', pl_qtd from held_v
union all select PortfolioName, 'PL_MTD', pl_mtd from held_v
union all select PortfolioName, 'PL_DTD', pl_dtd from held_v""")
def pl_metrics(spark, sf_dir):
    return stats.pl_metrics(_held(spark, sf_dir))


@query("a5_trade_count", "select PortfolioName, trade_count from traded_v")
def trade_count(spark, sf_dir):
    return _traded(spark, sf_dir).select("PortfolioName", "trade_count")


@query("a6_trade_type_matrix", """
select PortfolioName, buy_trades as Buy, sell_trades as Sell, trade_count - buy_trades - sell_trades as Short
from traded_v""")
def trade_type_matrix(spark, sf_dir):
    return _matrix(views.trades(spark, sf_dir))


def _matrix(trades):
    return stats.trade_type_matrix(trades, stats.trade_types(trades))


@query("a6_trade_type_counts", """
select PortfolioName, 'Buy' as TradeTypeName, buy_trades as trades from traded_v
union all select PortfolioName, 'Sell', sell_trades from traded_v
union all select PortfolioName, 'Short', trade_count - buy_trades - sell_trades from traded_v""")
def trade_type_counts(spark, sf_dir):
    return stats.trade_type_counts(views.trades(spark, sf_dir))


@query("a7_total_cash", "select PortfolioName, total_cash from traded_v")
def total_cash(spark, sf_dir):
    return _traded(spark, sf_dir).select("PortfolioName", "total_cash")


@query("a8_holdings_statistics", "select * from held_v")
def holdings_statistics(spark, sf_dir):
    return _held(spark, sf_dir)


@query("a8_trades_statistics", "select * from traded_v")
def trades_statistics(spark, sf_dir):
    return _traded(spark, sf_dir)


@query("a9_single_fund", f"select * from summary_v where PortfolioName = '{_FUND}'")
def single_fund(spark, sf_dir):
    return stats.fund_summary(
        views.holdings(spark, sf_dir, securities=False), views.trades(spark, sf_dir), _FUND)


@query("a10_holdings_totals", """
select count(*) as total_rows, count(distinct PortfolioName) as unique_funds,
  count(distinct SecurityId) as unique_securities, cast(sum(PL_dec) as double) as total_pl_ytd
from holdings_v""")
def holdings_totals(spark, sf_dir):
    return stats.holdings_totals(views.holdings(spark, sf_dir, securities=False))


@query("a11_trades_totals", """
select count(*) as total_rows, count(distinct PortfolioName) as unique_funds,
  count(*) filter (TradeTypeName = 'Buy') as buy_trades, count(*) filter (TradeTypeName = 'Sell') as sell_trades,
  cast(sum(cast(TotalCash as decimal(18,4))) as double) as total_cash
from trades_v""")
def trades_totals(spark, sf_dir):
    return stats.trades_totals(views.trades(spark, sf_dir))


@query("a12_holding_types", "select SecurityTypeName, count(*) as n from holdings_v group by 1")
def holding_types(spark, sf_dir):
    return stats.value_counts(views.holdings(spark, sf_dir), "SecurityTypeName")


@query("a12_trade_types", "select SecurityType, count(*) as n from trades_v group by 1")
def trade_security_types(spark, sf_dir):
    return stats.value_counts(views.trades(spark, sf_dir), "SecurityType")


_DISTINCT = "select PortfolioName from holdings_v union select PortfolioName from trades_v"


@query("a13_distinct_funds", _DISTINCT)
@query("o1_fund_union", _DISTINCT)
def distinct_funds(spark, sf_dir):
    return stats.distinct_funds(views.holdings(spark, sf_dir, securities=False), views.trades(spark, sf_dir))


@query("w1_ranked_funds", """
select PortfolioName, pl_ytd, row_number() over (order by pl_ytd desc, PortfolioName) as rank from held_v""")
@query("r9_funds_by_pl", """
select PortfolioName, pl_ytd, row_number() over (order by pl_ytd desc, PortfolioName) as rank from held_v""")
def ranked_funds(spark, sf_dir):
    return stats.rank_funds(_held(spark, sf_dir).select("PortfolioName", "pl_ytd"), "pl_ytd")


@query("w1_ranked_counterparties", """
select Counterparty, cash, row_number() over (order by cash desc, Counterparty) as rank from (
  select Counterparty, cast(sum(cast(TotalCash as decimal(18,4))) as double) as cash from trades_v group by 1)""")
def ranked_counterparties(spark, sf_dir):
    """As many groups as customers: ranked over range partitions."""
    cash = views.trades(spark, sf_dir).groupBy("Counterparty").agg(stats.money_sum("TotalCash").alias("cash"))
    return stats.rank_many(cash, "cash", "Counterparty")


@query("r9_funds_by_trades", """
select PortfolioName, trade_count, row_number() over (order by trade_count desc, PortfolioName) as rank from traded_v""")
def funds_by_trades(spark, sf_dir):
    return stats.rank_funds(_traded(spark, sf_dir).select("PortfolioName", "trade_count"), "trade_count")


@query("r10_top_five_funds", "select PortfolioName, pl_ytd from held_v order by pl_ytd desc, PortfolioName limit 5")
def top_five(spark, sf_dir):
    return stats.top_funds(_held(spark, sf_dir).select("PortfolioName", "pl_ytd"), "pl_ytd")


@query("r11_top_fund", "select PortfolioName, pl_ytd from held_v order by pl_ytd desc, PortfolioName limit 1")
def top_one(spark, sf_dir):
    return stats.top_funds(_held(spark, sf_dir).select("PortfolioName", "pl_ytd"), "pl_ytd", 1)


@query("p6_one_fund", f"""
select row_ord, SecurityId, Qty as qty, cast(PL_dec as double) as pl from holdings_v where PortfolioName = '{_FUND}'""")
def one_fund(spark, sf_dir):
    df = views.holdings(spark, sf_dir, securities=False).filter(F.col("PortfolioName") == _FUND)
    return df.select("row_ord", "SecurityId", F.col("Qty").alias("qty"), F.col("PL_YTD").alias("pl"))


@query("p7_buys_and_sells", "select PortfolioName, buy_trades, sell_trades from traded_v")
def buys_and_sells(spark, sf_dir):
    return _traded(spark, sf_dir).select("PortfolioName", "buy_trades", "sell_trades")


@query("p8_nonzero_holdings", "select PortfolioName, nonzero_holdings from held_v")
def nonzero_holdings(spark, sf_dir):
    return _held(spark, sf_dir).select("PortfolioName", "nonzero_holdings")


@query("j1_funds_in_both", "select PortfolioName from traded_v semi join held_v using (PortfolioName)")
def funds_in_both(spark, sf_dir):
    return stats.funds_in_both(views.holdings(spark, sf_dir, securities=False), views.trades(spark, sf_dir))


@query("j4_fund_summaries", "select * from summary_v")
def fund_summaries(spark, sf_dir):
    return stats.fund_summary(views.holdings(spark, sf_dir, securities=False), views.trades(spark, sf_dir))


# A customer's market segment or nation may be asked for; only nations are funds.
@query("c16_summary_texts", """
, asked as (select distinct n_name as PortfolioName from nation union select distinct c_mktsegment from customer)
select PortfolioName, case when holdings_count is null and trade_count is null
    then 'No data found for ' || PortfolioName
    else concat_ws(chr(10),
      case when holdings_count is not null then 'Fund: ' || PortfolioName end,
      case when holdings_count is not null then 'Holdings Count: ' || holdings_count end,
      case when holdings_count is not null then 'Total P&L YTD: $' || format('{:,.2f}', pl_ytd) end,
      case when holdings_count is not null then 'Avg P&L YTD: $' || format('{:,.2f}', avg_pl_ytd) end,
      case when trade_count is not null then 'Trade Count: ' || trade_count end,
      case when trade_count is not null then '  Buy: ' || buy_trades || ', Sell: ' || sell_trades end) end as summary
from asked left join summary_v using (PortfolioName)""")
def summary_texts(spark, sf_dir):
    asked = (
        views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("PortfolioName"))
        .union(views.table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()
    )
    return stats.summaries_for(
        asked, views.holdings(spark, sf_dir, securities=False), views.trades(spark, sf_dir))


VIEWS["sections_v"] = """
  select
    (select '=== COMPLETE Fund Performance Rankings (Yearly P&L) ===' || chr(10)
       || 'This includes ALL funds in the dataset:' || chr(10) || chr(10)
       || string_agg(r || '. ' || PortfolioName || ': $' || format('{:,.2f}', pl_ytd), chr(10) order by r)
       || chr(10) || chr(10) || 'Total Funds: ' || count(*)
     from (select *, row_number() over (order by pl_ytd desc, PortfolioName) as r from held_v)) as ranking,
    (select chr(10) || chr(10) || '=== Holdings Count by Fund ===' || chr(10)
       || string_agg('  ' || PortfolioName || ': ' || holdings_count || ' holdings', chr(10)
                     order by holdings_count desc, PortfolioName) from held_v) as held,
    (select chr(10) || chr(10) || '=== Trade Count by Fund ===' || chr(10)
       || string_agg('  ' || PortfolioName || ': ' || trade_count || ' trades', chr(10)
                     order by trade_count desc, PortfolioName) from traded_v) as traded,
    (select chr(10) || chr(10) || '=== Total Cash by Fund ===' || chr(10)
       || string_agg('  ' || PortfolioName || ': $' || format('{:,.2f}', total_cash), chr(10)
                     order by total_cash desc, PortfolioName) from traded_v) as cash"""
VIEWS["contexts_v"] = """
  select false as wants_cash, concat_ws(chr(10), ranking, held, traded) as context from sections_v
  union all select true, concat_ws(chr(10), ranking, held, traded, cash) from sections_v"""


def contexts(spark, sf_dir):
    return cx.aggregation_contexts(_held(spark, sf_dir), _traded(spark, sf_dir))


@query("c8_aggregation_context", "select * from contexts_v")
def aggregation_context(spark, sf_dir):
    return contexts(spark, sf_dir)


VIEWS["context_lines_v"] = """
  select 0 as section, 0 as position, '=== COMPLETE Fund Performance Rankings (Yearly P&L) ===' || chr(10)
    || 'This includes ALL funds in the dataset:' || chr(10) as line
  union all select 1, 0, chr(10) || chr(10) || '=== Holdings Count by Fund ==='
  union all select 2, 0, chr(10) || chr(10) || '=== Trade Count by Fund ==='
  union all select 3, 0, chr(10) || chr(10) || '=== Total Cash by Fund ==='
  union all select 0, count(*) + 1, chr(10) || 'Total Funds: ' || count(*) from held_v
  union all select 0, r, r || '. ' || PortfolioName || ': $' || format('{:,.2f}', pl_ytd)
    from (select *, row_number() over (order by pl_ytd desc, PortfolioName) as r from held_v)
  union all select 1, row_number() over (order by holdings_count desc, PortfolioName),
    '  ' || PortfolioName || ': ' || holdings_count || ' holdings' from held_v
  union all select 2, row_number() over (order by trade_count desc, PortfolioName),
    '  ' || PortfolioName || ': ' || trade_count || ' trades' from traded_v
  union all select 3, row_number() over (order by total_cash desc, PortfolioName),
    '  ' || PortfolioName || ': $' || format('{:,.2f}', total_cash) from traded_v"""
VIEWS["context_keys_v"] = """
  select wants_cash, md5(concat_ws('-', count(*), sum(cast('0x' || substr(digest, 1, 15) as bigint)),
      sum(cast('0x' || substr(digest, 16, 15) as bigint)))) as context_key,
    cast(sum(length(line) + 1) - 1 as bigint) as chars
  from (select *, md5(section || ':' || position || ':' || line) as digest from context_lines_v)
    join (select unnest([false, true]) as wants_cash) on wants_cash or section < 3 group by wants_cash"""


@query("c8_context_lines", "select * from context_lines_v")
def context_lines(spark, sf_dir):
    return cx.context_lines(_held(spark, sf_dir), _traded(spark, sf_dir))


@query("c8_context_keys", "select * from context_keys_v")
def context_keys(spark, sf_dir):
    return cx.context_keys(context_lines(spark, sf_dir))
