"""Row texts, packing, chunk metadata, vectors and the stored table."""

from pyspark.sql import functions as F

from fundweave import fixed_values as fv
from fundweave.functions import text as tx, tokens as tk, vectors as vec
from fundweave.operators import chunks as ch
from fundweave.plans import build_index
from fundweave.session import scratch_path
from fundweave.sources import csv_tables as ct, vector_table as vt
from fundweave.workload import views
from fundweave.workload.catalog import VIEWS, query

_DASH = "chr(10)"


def _sql_row(template: str) -> str:
    """The row template as SQL; every place is a column of the view."""
    import re

    out = []
    for part in re.split(r"(\{[^}]*\})", template):
        if part.startswith("{"):
            name, _, spec = part[1:-1].partition(":")
            if spec:
                out.append(f"format('{{:{spec}}}', {name})")
            elif name == "OpenDate":
                out.append("coalesce(strftime(OpenDate, '%Y-%m-%d %H:%M:%S'), 'NaT')")
            else:
                out.append(f"coalesce({name}, 'nan')")
        elif part:
            out.append("'" + part.replace("'", "''") + "'")
    return " || ".join(out)


_HOLDINGS_SQL = _sql_row(fv.HOLDINGS_ROW).replace(
    "'{:,.2f}', PL_YTD", "'{:,.2f}', cast(PL_dec as double)").replace(
    "'{:,.2f}', PL_QTD", "'{:,.2f}', cast(PL_QTD_dec as double)")

VIEWS["holding_rows_v"] = f"""
  select 'holdings' as namespace, PortfolioName as fund, row_ord, {_HOLDINGS_SQL} as text,
    SecurityTypeName as security_type, null::varchar as trade_type, PL_dec <> 0 as pl_row, year(OpenDate) as row_year
  from holdings_v"""
VIEWS["trade_rows_v"] = f"""
  select 'trades' as namespace, PortfolioName as fund, row_ord, {_sql_row(fv.TRADES_ROW)} as text,
    SecurityType as security_type, TradeTypeName as trade_type, null::boolean as pl_row, null::bigint as row_year
  from trades_v"""
VIEWS["rows_v"] = "select * from holding_rows_v union all select * from trade_rows_v"
VIEWS["doc_rows_v"] = """
  select 'documents' as namespace, source as fund, doc_id as row_ord, text, null::varchar as security_type,
    null::varchar as trade_type, null::boolean as pl_row, null::bigint as row_year from documents"""


def _packed_views(name: str, rows: str, chunks: bool = True) -> None:
    """Greedy packing as a recursion over row numbers, all funds in step."""
    VIEWS[f"{name}_numbered_v"] = f"""
  select *, cast(ceil(length(text) / 4) as bigint) as n_tokens,
    row_number() over (partition by namespace, fund order by row_ord) as rn from {rows}"""
    VIEWS[f"{name}_steps_v"] = f"select namespace, fund, rn, n_tokens from {name}_numbered_v"
    VIEWS[f"{name}_walk_v"] = f"""
  select namespace, fund, rn, n_tokens as held, cast(0 as bigint) as chunk_no from {name}_steps_v where rn = 1
  union all
  select s.namespace, s.fund, s.rn,
    case when w.held + s.n_tokens > {fv.CHUNK_TOKENS} then s.n_tokens else w.held + s.n_tokens end,
    case when w.held + s.n_tokens > {fv.CHUNK_TOKENS} then w.chunk_no + 1 else w.chunk_no end
  from {name}_walk_v w join {name}_steps_v s on s.namespace = w.namespace and s.fund = w.fund and s.rn = w.rn + 1"""
    VIEWS[f"{name}_packed_v"] = f"""
  select r.*, w.chunk_no from {name}_numbered_v r join {name}_walk_v w using (namespace, fund, rn)"""
    if not chunks:
        return
    VIEWS[f"{name}_chunks_v"] = f"""
  select namespace, fund, chunk_no, namespace || '_' || fund || '_' || chunk_no as chunk_id,
    string_agg(text, chr(10) order by row_ord) as text, cast(sum(n_tokens) as bigint) as n_tokens,
    count(*) as row_count,
    list_sort(list_distinct(list(security_type) filter (security_type is not null)))as security_types,
    case when namespace <> 'holdings' then
      list_sort(list_distinct(list(trade_type) filter (trade_type is not null)))end as trade_types,
    bool_or(pl_row) as has_pl,
    case when namespace = 'holdings' then coalesce(first(row_year order by row_ord), {fv.DEFAULT_YEAR}) end as year
  from {name}_packed_v group by 1, 2, 3"""


_packed_views("fund", "rows_v")
_packed_views("doc", "doc_rows_v")


def document_rows(spark, sf_dir):
    empty = F.lit(None).cast("string")
    return views.documents(spark, sf_dir).withColumns({
        "security_type": empty, "trade_type": empty,
        "pl_row": F.lit(None).cast("boolean"), "row_year": F.lit(None).cast("int"),
    })


def fund_rows(spark, sf_dir):
    return ch.holdings_rows(views.holdings(spark, sf_dir)).unionByName(ch.trades_rows(views.trades(spark, sf_dir)))


def fund_chunks(spark, sf_dir, columns=None):
    return ch.build_chunks(views.holdings(spark, sf_dir), views.trades(spark, sf_dir), columns=columns)


def document_chunks(spark, sf_dir, columns=None):
    return ch.chunk_rows(document_rows(spark, sf_dir), columns=columns)


@query("c1_holdings_text", "select row_ord, text from holding_rows_v")
def holdings_text(spark, sf_dir):
    return ch.holdings_rows(views.holdings(spark, sf_dir)).select("row_ord", "text")


@query("c2_trades_text", "select row_ord, text from trade_rows_v")
def trades_text(spark, sf_dir):
    return ch.trades_rows(views.trades(spark, sf_dir)).select("row_ord", "text")


@query("c3_packed_holdings", """
select fund, row_ord, chunk_no from fund_packed_v where namespace = 'holdings'""")
def packed_holdings(spark, sf_dir):
    rows, late = ch.unrendered_holdings(views.holdings(spark, sf_dir))
    return ch.pack_rows(rows, late=late).select("fund", "row_ord", "chunk_no")


@query("c3_packed_documents", "select fund, row_ord, chunk_no, n_tokens from doc_packed_v")
def packed_documents(spark, sf_dir):
    return ch.pack_rows(document_rows(spark, sf_dir)).select(
        "fund", "row_ord", "chunk_no", F.col("n_tokens").cast("bigint").alias("n_tokens"))


VIEWS["customer_rows_v"] = f"""
  select 'trades' as namespace, Name as fund, row_ord, {_sql_row(fv.TRADES_ROW)} as text from trades_v"""
_packed_views("customer", "customer_rows_v", chunks=False)


@query("c3_packed_by_customer", "select fund, row_ord, chunk_no, n_tokens from customer_packed_v")
def packed_by_customer(spark, sf_dir):
    """Very many funds whose rows are far apart: every customer is one."""
    rows, late = ch.unrendered_trades(views.trades(spark, sf_dir), fund="Name")
    return ch.pack_rows(rows, late=late).select("fund", "row_ord", "chunk_no", F.col("n_tokens").cast("bigint").alias("n_tokens"))


_OVERLAP = 150


@query("c4_overlapping_chunks", f"""
, tails as (
  select *, sum(n_tokens) over (partition by namespace, fund, chunk_no order by row_ord desc) as tail,
    max(chunk_no) over (partition by namespace, fund) as last_no from doc_packed_v)
select fund, row_ord, chunk_no from doc_packed_v
union all select fund, row_ord, chunk_no + 1 from tails where tail <= {_OVERLAP} and chunk_no < last_no""")
def overlapping_chunks(spark, sf_dir):
    return ch.pack_rows(document_rows(spark, sf_dir), overlap_tokens=_OVERLAP).select("fund", "row_ord", "chunk_no")


@query("c5_all_chunks", """
select namespace, fund, chunk_no, n_tokens, row_count, md5(text) as digest from fund_chunks_v""")
@query("o3_all_chunks", """
select namespace, fund, chunk_no, n_tokens, row_count, md5(text) as digest from fund_chunks_v""")
def all_chunks(spark, sf_dir):
    return fund_chunks(spark, sf_dir, ["text", "n_tokens", "row_count"]).select(
        "namespace", "fund", "chunk_no", "n_tokens", "row_count", F.md5("text").alias("digest"))


@query("c6_token_counts", "select doc_id, cast(ceil(length(text) / 4) as integer) as n_tokens from documents")
def token_counts(spark, sf_dir):
    docs = views.document_table(spark, sf_dir)
    return docs.select("doc_id", tk.estimate_tokens(F.col("text")).alias("n_tokens"))


VIEWS["words_v"] = r"""
  select doc_id, unnest(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x7F]+')) as word from documents"""
VIEWS["buckets_v"] = f"""
  select doc_id, cast(cast('0x' || substr(md5(word), 1, 7) as bigint) % {fv.VECTOR_DIM} as integer) as bucket, count(*) as n
  from words_v where word <> '' group by 1, 2"""


@query("c7_hashed_vectors", "select doc_id, bucket, cast(n as double) as weight from buckets_v")
def hashed_vectors(spark, sf_dir):
    docs = views.document_table(spark, sf_dir)
    vectors = docs.select("doc_id", vec.hashed_counts()(F.col("text")).alias("v"))
    return (
        vectors.select("doc_id", F.posexplode("v").alias("bucket", "weight")).filter("weight > 0")
        .withColumn("weight", F.col("weight").cast("double"))
    )


@query("a14_chunk_metadata", """
select namespace, fund, chunk_no, row_count, array_to_string(security_types, ',') as security_types,
  array_to_string(trade_types, ',') as trade_types, has_pl, cast(year as integer) as year
from fund_chunks_v""")
def chunk_metadata(spark, sf_dir):
    return fund_chunks(spark, sf_dir, ["row_count", "security_types", "trade_types", "has_pl", "year"]).select(
        "namespace", "fund", "chunk_no", "row_count", F.array_join("security_types", ",").alias("security_types"),
        F.array_join("trade_types", ",").alias("trade_types"), "has_pl", "year")


@query("a15_chunk_texts", "select fund, chunk_no, text from doc_chunks_v")
def chunk_texts(spark, sf_dir):
    return document_chunks(spark, sf_dir, ["text"]).select("fund", "chunk_no", "text")


@query("a16_chunk_totals", """
select namespace, count(*) as chunks from (select distinct namespace, fund, chunk_no from fund_walk_v)
group by rollup (namespace)""")
def chunk_totals(spark, sf_dir):
    return ch.chunk_totals(fund_chunks(spark, sf_dir, []))


@query("e4_chunk_quality", """
select count(*) as chunks, cast(0 as bigint) as without_text, count(*) filter (fund is null) as without_fund,
  count(*) filter (row_count < 1) as without_rows, count(*) filter (n_tokens > 500 and row_count > 1) as over_limit
from doc_chunks_v""")
def chunk_quality(spark, sf_dir):
    return ch.quality_report(document_chunks(spark, sf_dir))


_NUMBERED = "select namespace, fund, chunk_no, namespace || '_' || fund || '_' || chunk_no as chunk_id from (select distinct namespace, fund, chunk_no from {}_walk_v)"


@query("w2_chunk_numbers", _NUMBERED.format("doc"))
@query("p14_chunk_ids", _NUMBERED.format("doc"))
def chunk_numbers(spark, sf_dir):
    return document_chunks(spark, sf_dir, ["chunk_id"]).select("namespace", "fund", "chunk_no", "chunk_id")


@query("p13_stored_text", "select doc_id, substr(text, 1, 1000) as text from documents")
def stored_text(spark, sf_dir):
    return views.document_table(spark, sf_dir).select("doc_id", tx.stored_text(F.col("text"), fv.STORED_TEXT_CHARS).alias("text"))


# --- the stored table: documents as stored rows, an edited copy as the incoming ones ---

def _stored(spark, sf_dir):
    return views.document_table(spark, sf_dir).select(
        F.concat(F.lit("documents_"), "doc_id").alias("chunk_id"), F.col("source").alias("fund"),
        F.when(F.col("doc_id") % 2 == 0, fv.HOLDINGS).otherwise(fv.TRADES).alias("namespace"), "text")


def _incoming(spark, sf_dir):
    """Every German or English document rewritten, and a new copy of every one."""
    edited = _stored(spark, sf_dir).join(
        views.document_table(spark, sf_dir).filter("lang in ('en', 'de')").select(
            F.concat(F.lit("documents_"), "doc_id").alias("chunk_id")), "chunk_id", "left_semi"
    ).withColumn("text", F.concat("text", F.lit(" edited")))
    return edited.unionByName(_stored(spark, sf_dir).withColumn("chunk_id", F.concat("chunk_id", F.lit("_copy"))))


VIEWS["stored_v"] = """
  select 'documents_' || doc_id as chunk_id, source as fund,
    case when doc_id % 2 = 0 then 'holdings' else 'trades' end as namespace, text, lang from documents"""
_AS_COLUMNS = "select chunk_id, fund, namespace, md5(text) as digest, length(text) as chars from"


def _digest(df):
    return df.select("chunk_id", "fund", "namespace", F.md5("text").alias("digest"),
                     F.char_length("text").cast("bigint").alias("chars"))


@query("s6_upsert", """
, incoming as (
  select chunk_id, fund, namespace, text || ' edited' as text from stored_v where lang in ('en', 'de')
  union all select chunk_id || '_copy', fund, namespace, text from stored_v)
select chunk_id, fund, namespace, md5(text) as digest, length(text) as chars from (
  select chunk_id, fund, namespace, text from stored_v anti join incoming using (namespace, chunk_id)
  union all select chunk_id, fund, namespace, text from incoming)""")
def upsert(spark, sf_dir):
    return _digest(vt.upsert(_stored(spark, sf_dir), _incoming(spark, sf_dir)))


@query("j6_rows_not_replaced", """
select chunk_id, namespace from stored_v where lang is null or lang not in ('en', 'de')""")
def rows_not_replaced(spark, sf_dir):
    incoming = _incoming(spark, sf_dir)
    return _stored(spark, sf_dir).join(incoming, vt.KEYS, "left_anti").select("chunk_id", "namespace")


@query("s7_delete_namespace", f"{_AS_COLUMNS} stored_v where namespace <> 'trades'")
def delete_namespace(spark, sf_dir):
    return _digest(vt.delete_namespace(_stored(spark, sf_dir), fv.TRADES))


@query("s8_table_stats", """
select namespace, count(*) as vectors, cast(max(len(embedding)) as integer) as dimension from vectors_v
group by rollup (namespace)""")
def table_stats(spark, sf_dir):
    return vt.table_stats(views.vectors(spark, sf_dir))


@query("s5_misfits", """
select label, count(*) as n from embeddings where len(embedding) <> 64 or label % 2 = 1 group by label""")
def misfits(spark, sf_dir):
    """Vectors of a wrong length: odd labels lose their last value first."""
    df = views.table(spark, sf_dir, "embeddings")
    cut = F.when(F.col("label") % 2 == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return vt.misfits(df.withColumn("embedding", cut), 64).groupBy("label").agg(F.count("*").alias("n"))


@query("s9_index_build", f"""
select namespace, count(*) as vectors, {fv.VECTOR_DIM} as dimension
from (select distinct namespace, fund, chunk_no from fund_walk_v) group by rollup (namespace)""")
def index_build(spark, sf_dir):
    return build_index.build(
        views.holdings(spark, sf_dir), views.trades(spark, sf_dir), scratch_path(spark, "index"))


def _edited_rows(spark, sf_dir):
    """Documents of long sources change: short texts of src1 are dropped, src2's are edited, src3 is gone."""
    rows = document_rows(spark, sf_dir)
    return rows.filter("fund <> 'src3' and not (fund = 'src1' and length(text) < 500)").withColumn(
        "text", F.when(F.col("fund") == "src2", F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))


@query("s10_changed_funds", """
select 'documents' as namespace, source as fund, case source when 'src3' then 'gone' else 'changed' end as change
from documents where source in ('src2', 'src3') or (source = 'src1' and length(text) < 500) group by source""")
def changed_funds(spark, sf_dir):
    return vt.changed_funds(
        vt.fingerprints(document_rows(spark, sf_dir)), vt.fingerprints(_edited_rows(spark, sf_dir)))


def _as_csv(trades, path):
    """Trades as CSV files, a fund's rows in the order of their numbers."""
    names = ["PortfolioName", "TradeTypeName", "Name", "SecurityType", "Quantity", "Price", "Principal", "TotalCash", "TradeDate",
             "SettleDate", "Strategy1Name", "CustodianName", "Counterparty"]
    trades.repartitionByRange("row_ord").sortWithinPartitions("row_ord").select(*names).write.option("header", True).csv(path)
    return path


@query("s10_changed_csv", """
select 'trades' as namespace, PortfolioName as fund, case PortfolioName when 'NATION_3' then 'new' else 'changed' end as change
from trades_v where PortfolioName = 'NATION_3' or (PortfolioName = 'NATION_7' and TradeTypeName = 'Sell') group by PortfolioName""")
def changed_csv(spark, sf_dir):
    """Trades dropped as CSV twice: one fund's file is there the second time only, another one's sales were taken out. The
    folder and the splits are different too, and change nothing."""
    trades = views.trades(spark, sf_dir)
    rest, new = trades.filter("PortfolioName <> 'NATION_3'"), trades.filter("PortfolioName = 'NATION_3'")
    before, after = scratch_path(spark, "before-csv"), scratch_path(spark, "after-csv")
    same = rest.filter("PortfolioName <> 'NATION_7'")
    edited = rest.filter("PortfolioName = 'NATION_7'")
    first = [_as_csv(same, f"{before}/others"), _as_csv(edited, f"{before}/edited")]
    second = [_as_csv(edited.filter("TradeTypeName <> 'Sell'"), f"{after}/edited"), _as_csv(new, f"{after}/new")]

    def marks(paths):
        return vt.fingerprints(ch.trades_rows(ct.load_trades(spark, paths)))

    return vt.changed_funds(marks(first), marks([first[0], *second]))


VIEWS["edited_rows_v"] = """
  select namespace, fund, row_ord, case when fund = 'src2' then text || ' edited' else text end as text, security_type,
    trade_type, pl_row, row_year
  from doc_rows_v where fund <> 'src3' and not (fund = 'src1' and length(text) < 500)"""
_packed_views("edited", "edited_rows_v")


@query("s10_renewed_index", """
select chunk_id, fund, row_count, md5(text) as digest from edited_chunks_v""")
def renewed_index(spark, sf_dir):
    """Only changed sources are packed again, yet all must look as if freshly built."""
    path = scratch_path(spark, "stored")
    vt.publish(vt.to_vectors(document_chunks(spark, sf_dir)), path, ["documents"])
    renewed = build_index.renew(
        build_index.open_index(spark, path), vt.fingerprints(document_rows(spark, sf_dir)), _edited_rows(spark, sf_dir))
    return renewed.select("chunk_id", "fund", "row_count", F.md5("text").alias("digest"))


# --- hooks, with small stand-ins for the models ---

class SplitTokenizer:
    def encode(self, text):
        return text.split(" ")


class ShapeModel:
    """Stands in for an embedding model: length, blanks and line ends of a text."""

    def encode(self, texts):
        return [[float(len(t)), float(t.count(" ")), float(t.count("\n"))] for t in texts]


@query("u1_tokenizer_hook", "select doc_id, cast(len(string_split(text, ' ')) as integer) as n_tokens from documents")
def tokenizer_hook(spark, sf_dir):
    count = tk.tokenizer_hook(SplitTokenizer)
    return views.document_table(spark, sf_dir).select("doc_id", count("text").alias("n_tokens"))


@query("u2_model_hook", """
select doc_id, length(text)::double as chars, (length(text) - length(replace(text, ' ', '')))::double as blanks,
  (length(text) - length(replace(text, chr(10), '')))::double as line_ends from documents""")
def model_hook(spark, sf_dir):
    embed = vec.model_hook(ShapeModel)
    docs = views.document_table(spark, sf_dir).select("doc_id", embed("text").alias("v"))
    return docs.select("doc_id", *(
        F.get("v", F.lit(i)).cast("double").alias(name) for i, name in enumerate(("chars", "blanks", "line_ends"))))
