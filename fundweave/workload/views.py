"""The driver tables seen as holdings, trades, documents, vectors and questions.

Every function returns a DataFrame over whole tables; ``VIEWS`` holds the same
views for the comparison engine. Row order is the order in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fundweave import fixed_values as fv
from fundweave.workload.catalog import VIEWS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds row_ord, the place of a row in all files of the table, in the order of their paths. The rows of each file are
    counted from its footer; what stands before a file is one row for each, sent to all tasks: a shuffle by file would bring
    the rows of a file into one."""
    df = df.withColumns({"_file": F.col("_metadata.file_path"), "_index": F.col("_metadata.row_index")})
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = df.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return df.join(F.broadcast(files), "_file").withColumn("row_ord", F.col("_before") + F.col("_index")).drop("_file", "_index", "_before")


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def holdings(spark: SparkSession, sf_dir: str, securities: bool = True) -> DataFrame:
    """Line items as positions; the fund is the supplier's nation.

    ``securities=False`` leaves out the columns that need the part table, and
    with them its join.
    """
    items = in_file_order(table(spark, sf_dir, "lineitem"))
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    df = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nations, F.col("s_nationkey") == F.col("n_nationkey"))
    if securities:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    shipped = F.col("l_shipdate").cast("date")
    profit = F.expr(
        "cast(cast(cast(l_extendedprice as decimal(18,2))"
        " * (cast(0.05 as decimal(4,2)) - cast(l_discount as decimal(4,2))) as decimal(18,4)) as double)"
    )
    returned = F.col("l_returnflag") == "R"
    columns = {
        "row_ord": F.col("row_ord"),
        "PortfolioName": F.col("n_name"),
        "SecurityId": F.col("l_partkey").cast("string"),
        "Qty": F.when(returned, F.lit(0.0)).otherwise(F.col("l_quantity")),
        "MV_Base": F.col("l_extendedprice"),
        "MV_Local": F.col("l_extendedprice"),
        "PL_YTD": profit,
        "PL_QTD": F.when(F.quarter(shipped) == 4, profit).otherwise(F.lit(0.0)),
        "PL_MTD": F.when(F.month(shipped) == 12, profit).otherwise(F.lit(0.0)),
        "PL_DTD": F.when(F.dayofmonth(shipped) == 31, profit).otherwise(F.lit(0.0)),
        "CustodianName": F.col("s_name"),
        "DirectionName": F.when(F.col("l_quantity") >= 25, F.lit("Long")).otherwise(F.lit("Short")),
        "AsOfDate": shipped,
        "OpenDate": shipped,
        "CloseDate": F.when(returned, shipped),
    }
    if securities:
        columns |= {
            "SecName": F.col("p_name"),
            "SecurityTypeName": F.col("p_type"),
            "Price": F.col("p_retailprice"),
            "Strategy1RefShortName": F.col("p_brand"),
        }
    return df.select(*(c.alias(n) for n, c in columns.items()))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades; the fund is the customer's nation."""
    df = (
        in_file_order(table(spark, sf_dir, "orders"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    kind = F.when(status == "F", "Buy").when(status == "O", "Sell").otherwise("Short")
    cash = F.when(status == "F", -price).otherwise(price)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return df.select(
        "row_ord",
        F.col("n_name").alias("PortfolioName"),
        kind.alias("TradeTypeName"),
        F.col("o_orderpriority").alias("SecurityType"),
        F.col("c_name").alias("Name"),
        F.col("c_name").alias("Counterparty"),
        F.col("c_mktsegment").alias("Strategy1Name"),
        F.lit("Custodian").alias("CustodianName"),
        (F.col("o_custkey") % 100).cast("double").alias("Quantity"),
        price.alias("Price"), price.alias("Principal"),
        cash.alias("TotalCash"), cash.alias("AllocationCash"),
        day.alias("TradeDate"), day.alias("SettleDate"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with broken quantity and date cells, as text."""
    return in_file_order(table(spark, sf_dir, "lineitem")).selectExpr(
        "row_ord", "l_orderkey", "l_suppkey",
        """case when l_orderkey % 17 = 0 then 'NULL' when l_orderkey % 19 = 0 then '1,234'
                when l_orderkey % 23 = 0 then 'N/A' when l_orderkey % 29 = 0 then '1.5d'
                when l_orderkey % 31 = 0 then ' 12 ' when l_orderkey % 47 = 0 then ''
                else cast(cast(l_quantity as int) as string) end as Qty_raw""",
        """case when l_orderkey % 37 = 0 then '' when l_orderkey % 41 = 0 then 'xx'
                when l_orderkey % 43 = 0 then '01/08/70' when l_orderkey % 53 = 0 then '1/8/23'
                when l_orderkey % 59 = 0 then '01/08/2023'
                else date_format(l_shipdate, 'dd/MM/yy') end as OpenDate_raw""",
        "case when l_returnflag = 'R' then null when l_returnflag = 'A' then 'n/a' else l_linestatus end as Kind_raw",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows to pack: the fund is the source, the order is the id."""
    return document_table(spark, sf_dir).select(
        F.lit("documents").alias("namespace"), F.col("source").alias("fund"),
        F.col("doc_id").alias("row_ord"), "text",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors; odd ids are trades and carry no profit flag."""
    held = F.col("vec_id") % 2 == 0
    return table(spark, sf_dir, "embeddings").select(
        F.when(held, fv.HOLDINGS).otherwise(fv.TRADES).alias("namespace"),
        F.col("vec_id").alias("chunk_id"),
        "embedding",
        F.col("label").cast("string").alias("fund"),
        F.when(held, fv.HOLDINGS).otherwise(fv.TRADES).alias("file"),
        F.when(held, F.col("vec_id") % 3 != 0).alias("has_pl"),
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector asked as a question, with all kinds of routing."""
    wanted = F.col("vec_id") % 5
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("question_id"),
        "embedding",
        F.when(wanted == 1, fv.HOLDINGS).when(wanted == 2, fv.TRADES).alias("namespace"),
        (wanted.isin(1, 3)).alias("need_pl"),
    )


TEMPLATES = [
    "In {f}, what is the largest position by market value?",
    "Give the sum of trades booked by {f} in March",
    "Is the loss of {f} bigger than last quarter?",
    "Where does {f} keep its bonds?",
    "Of every desk, which fund, {f} included, did better this year?",
    "Please rank the other funds against {f}",
    "Show cash over all funds, then for {f}",
    "Which yearly figure does {f} report?",
    "Did the sell orders of {f} end in profit?",
    "Name one holding of {f} that is short",
    "Do funds such as {f} fare worse: list the lowest P&L",
    "Whom does {f} settle with?",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks one templated question about the own nation's fund."""
    asked = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    template = F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("c_custkey") % len(TEMPLATES)).cast("int"))
    return asked.select(
        F.col("c_custkey").alias("question_id"),
        F.replace(template, F.lit("{f}"), F.col("n_name")).alias("question"),
        F.col("n_name").alias("asked_fund"),
    )


_TEMPLATE_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TEMPLATES))

VIEWS.update({
    "holdings_v": """
  select l.row_ord, n.n_name as PortfolioName, cast(l.l_partkey as varchar) as SecurityId,
    p.p_name as SecName, p.p_type as SecurityTypeName,
    case when l.l_returnflag = 'R' then 0.0::double else l.l_quantity end as Qty,
    p.p_retailprice as Price, l.l_extendedprice as MV_Base,
    cast(cast(l.l_extendedprice as decimal(18,2))
         * (cast(0.05 as decimal(4,2)) - cast(l.l_discount as decimal(4,2))) as decimal(18,4)) as PL_dec,
    case when quarter(l.l_shipdate) = 4 then PL_dec else 0 end as PL_QTD_dec,
    case when month(l.l_shipdate) = 12 then PL_dec else 0 end as PL_MTD_dec,
    case when day(l.l_shipdate) = 31 then PL_dec else 0 end as PL_DTD_dec,
    s.s_name as CustodianName, p.p_brand as Strategy1RefShortName,
    case when l.l_quantity >= 25 then 'Long' else 'Short' end as DirectionName,
    cast(l.l_shipdate as date) as OpenDate,
    case when l.l_returnflag = 'R' then cast(l.l_shipdate as date) end as CloseDate
  from (select *, row_number() over () - 1 as row_ord from lineitem) l
    join supplier s on l.l_suppkey = s.s_suppkey
    join nation n on s.s_nationkey = n.n_nationkey left join part p on l.l_partkey = p.p_partkey""",
    "trades_v": """
  select o.row_ord, n.n_name as PortfolioName,
    case o.o_orderstatus when 'F' then 'Buy' when 'O' then 'Sell' else 'Short' end as TradeTypeName,
    o.o_orderpriority as SecurityType, c.c_name as Name, c.c_name as Counterparty,
    c.c_mktsegment as Strategy1Name, 'Custodian' as CustodianName,
    cast(o.o_custkey % 100 as double) as Quantity, o.o_totalprice as Price, o.o_totalprice as Principal,
    case o.o_orderstatus when 'F' then -o.o_totalprice else o.o_totalprice end as TotalCash,
    strftime(o.o_orderdate, '%Y-%m-%d') as TradeDate
  from (select *, row_number() over () - 1 as row_ord from orders) o
    join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey""",
    "dirty_v": """
  select row_ord, l_orderkey, l_suppkey,
    case when l_orderkey % 17 = 0 then 'NULL' when l_orderkey % 19 = 0 then '1,234'
         when l_orderkey % 23 = 0 then 'N/A' when l_orderkey % 29 = 0 then '1.5d'
         when l_orderkey % 31 = 0 then ' 12 ' when l_orderkey % 47 = 0 then ''
         else cast(cast(l_quantity as int) as varchar) end as Qty_raw,
    case when l_orderkey % 37 = 0 then '' when l_orderkey % 41 = 0 then 'xx'
         when l_orderkey % 43 = 0 then '01/08/70' when l_orderkey % 53 = 0 then '1/8/23'
         when l_orderkey % 59 = 0 then '01/08/2023'
         else strftime(l_shipdate, '%d/%m/%y') end as OpenDate_raw,
    case when l_returnflag = 'R' then null when l_returnflag = 'A' then 'n/a' else l_linestatus end as Kind_raw
  from (select *, row_number() over () - 1 as row_ord from lineitem)""",
    "vectors_v": """
  select case when vec_id % 2 = 0 then 'holdings' else 'trades' end as namespace, vec_id as chunk_id,
    embedding::double[] as embedding, cast(label as varchar) as fund,
    case when vec_id % 2 = 0 then 'holdings' else 'trades' end as file,
    case when vec_id % 2 = 0 then vec_id % 3 <> 0 end as has_pl
  from embeddings""",
    "vector_questions_v": """
  select vec_id as question_id, embedding::double[] as embedding,
    case vec_id % 5 when 1 then 'holdings' when 2 then 'trades' end as namespace,
    vec_id % 5 in (1, 3) as need_pl
  from embeddings""",
    "questions_v": f"""
  select c_custkey as question_id, replace(t.tpl, '{{f}}', n_name) as question, n_name as asked_fund
  from customer join nation on c_nationkey = n_nationkey
    join (values {_TEMPLATE_ROWS}) as t(id, tpl) on c_custkey % {len(TEMPLATES)} = t.id""",
})
