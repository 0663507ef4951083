"""Contexts and prompts as text columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, functions as F

from fundweave import fixed_values as fv
from fundweave.functions.text import fill, number_text
from fundweave.operators.stats import FUND, rank_many
from fundweave.sources.shared_files import opened

# A context is broadcast to every aggregation question, so its length is checked.
MAX_CONTEXT_CHARS = 64 * 1024 * 1024


def _section(header: str, measure: str, line: Callable[[Column, Column], Column],
             footer: Callable[[Column], Column] | None = None) -> Column:
    """A header and one line per fund, largest measure first, equal ones by fund."""
    entry = F.struct((-F.col(measure)).alias("down"), F.col(FUND).alias("fund"), F.col(measure).alias("value"))
    listed = F.array_sort(F.collect_list(entry))
    parts = [F.lit(header), F.array_join(F.transform(listed, line), "\n")]
    if footer is not None:
        parts.append(footer(F.size(listed)))
    return F.when(F.size(listed) > 0, F.concat_ws("\n", *parts))


def aggregation_contexts(holdings_stats: DataFrame, trades_stats: DataFrame) -> DataFrame:
    """Two rows: the context without and with the cash section (``wants_cash``)."""
    held = holdings_stats.agg(
        _section(fv.PL_HEADER, "pl_ytd",
                 lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["fund"], F.lit(": $"), number_text(e["value"], 2)),
                 lambda n: F.concat(F.lit(fv.PL_FOOTER), n.cast("string"))).alias("ranking"),
        _section(fv.HOLDINGS_COUNT_HEADER, "holdings_count",
                 lambda e, i: F.concat(F.lit("  "), e["fund"], F.lit(": "), e["value"].cast("string"), F.lit(" holdings"))).alias("held"),
    )
    traded = trades_stats.agg(
        _section(fv.TRADES_COUNT_HEADER, "trade_count",
                 lambda e, i: F.concat(F.lit("  "), e["fund"], F.lit(": "), e["value"].cast("string"), F.lit(" trades"))).alias("traded"),
        _section(fv.CASH_HEADER, "total_cash",
                 lambda e, i: F.concat(F.lit("  "), e["fund"], F.lit(": $"), number_text(e["value"], 2))).alias("cash"),
    )
    sections = held.unionByName(traded, allowMissingColumns=True).agg(
        *(F.max(name).alias(name) for name in ("ranking", "held", "traded", "cash")))
    wants_cash = F.col("wants_cash")
    text = F.concat_ws("\n", "ranking", "held", "traded", F.when(wants_cash, F.col("cash")))
    checked = F.when(F.char_length(text) > MAX_CONTEXT_CHARS, F.raise_error(F.lit("aggregation context too long")))
    return (
        sections.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("wants_cash"))
        .select("wants_cash", F.coalesce(checked, F.when(text == "", F.lit(fv.NO_AGGREGATES)).otherwise(text)).alias("context"))
    )


def attach_aggregates(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Two context rows of checked length meet every aggregation question."""
    return questions.join(F.broadcast(contexts), "wants_cash")


# --- the same context as rows under a key, for any number of funds ---------------

_CASH = 3  # number of the section that only questions about cash get


def context_lines(holdings_stats: DataFrame, trades_stats: DataFrame) -> DataFrame:
    """The aggregation context as rows ``section, position, line``.

    Position 0 is a section's header, its funds follow from the largest measure down, equal ones by fund, and the ranking
    ends with a footer. The funds of all sections are sorted together over range partitions; no task holds a section. A
    fund whose measure is null has no line and comes after all others. Without statistics there are no rows.
    """
    def listed(df: DataFrame, section: int, measure: str, shown: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(FUND).alias("fund"),
                         F.col(measure).cast("double").alias("measure"), shown.alias("shown"))

    every = (
        listed(holdings_stats, 0, "pl_ytd", F.concat(F.lit(": $"), number_text(F.col("pl_ytd"), 2)))
        .unionAll(listed(holdings_stats, 1, "holdings_count", F.concat(F.lit(": "), F.col("holdings_count").cast("string"), F.lit(" holdings"))))
        .unionAll(listed(trades_stats, 2, "trade_count", F.concat(F.lit(": "), F.col("trade_count").cast("string"), F.lit(" trades"))))
        .unionAll(listed(trades_stats, _CASH, "total_cash", F.concat(F.lit(": $"), number_text(F.col("total_cash"), 2))))
        .withColumn("order", F.struct(-F.col("section"), "measure"))
    )
    ranked = rank_many(every, "order", "fund")
    sizes = ranked.groupBy("section").agg(F.min("rank").alias("first"), F.count("*").alias("n"))  # four rows
    place = F.col("rank") - F.col("first") + 1
    before = F.when(F.col("section") == 0, F.concat(place.cast("string"), F.lit(". "))).otherwise(F.lit("  "))
    funds = ranked.join(F.broadcast(sizes), "section").select(
        "section", place.alias("position"), F.concat(before, "fund", "shown").alias("line"))
    titles = F.array(*(F.lit(t) for t in (fv.PL_HEADER, fv.HOLDINGS_COUNT_HEADER, fv.TRADES_COUNT_HEADER, fv.CASH_HEADER)))
    headers = sizes.select("section", F.lit(0).cast("long").alias("position"), F.get(titles, F.col("section")).alias("line"))
    footer = sizes.where("section = 0").select(
        "section", (F.col("n") + 1).alias("position"), F.concat(F.lit(fv.PL_FOOTER), F.col("n").cast("string")).alias("line"))
    return funds.where("line IS NOT NULL").unionAll(headers).unionAll(footer)


def store_lines(lines: DataFrame, path: str) -> DataFrame:
    """The lines as Parquet in a new shared folder, read again."""
    lines.write.parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def context_keys(lines: DataFrame) -> DataFrame:
    """Two rows ``wants_cash, context_key, chars``: what names the context without and with the cash section, and its length.

    The key is made of sums of the lines' digests, so it tells contexts apart by their content, wherever and in whatever
    partitions the lines lie.
    """
    digest = F.md5(F.concat_ws(":", F.col("section").cast("string"), F.col("position").cast("string"), "line"))

    def part(first: int) -> Column:
        return F.conv(F.substring(digest, first, 15), 16, 10).cast("decimal(20,0)")

    def named(wants_cash: bool) -> Column:
        used = F.lit(True) if wants_cash else F.col("section") < _CASH
        n = F.count_if(used)
        sums = [F.sum(F.when(used, part(first))).cast("string") for first in (1, 16)]
        text = F.sum(F.when(used, F.char_length("line").cast("long") + 1)) - 1
        return F.struct(F.lit(wants_cash).alias("wants_cash"), F.md5(F.concat_ws("-", n.cast("string"), *sums)).alias("context_key"),
                        F.coalesce(text, F.lit(len(fv.NO_AGGREGATES)).cast("long")).alias("chars"))

    both = lines.agg(named(False).alias("without"), named(True).alias("with"))
    return both.select(F.inline(F.array("without", "with")))


class StoredContext:
    """Renders the stored lines of a context inside a task; a worker keeps the two texts that there are."""

    def __init__(self, files: list[str]):
        self.files = files
        self.texts: dict[bool, str] = {}

    def text(self, wants_cash: bool) -> str:
        if wants_cash not in self.texts:
            lines = []
            for name in self.files:
                with opened(name) as file:
                    lines.append(pq.read_table(file, columns=["section", "position", "line"]))
            own = pa.concat_tables(lines).sort_by([("section", "ascending"), ("position", "ascending")]) if lines else None
            if own is not None and not wants_cash:
                own = own.filter(pc.less(own["section"], _CASH))
            self.texts[wants_cash] = "\n".join(own["line"].to_pylist() if own is not None else []) or fv.NO_AGGREGATES
        return self.texts[wants_cash]

    def prompt(self, wants_cash: bool, question: str) -> str:
        before, rest = fv.AGGREGATION_PROMPT.split("{context}")
        middle, after = rest.split("{question}")
        return f"{before}{self.text(wants_cash)}{middle}{question}{after}"


def chunk_contexts(matches: DataFrame) -> DataFrame:
    """One numbered text per question from its matches in rank order."""
    entry = F.struct(
        F.col("rank"),
        F.coalesce("fund", F.lit(fv.UNKNOWN)).alias("fund"),
        F.coalesce("file", F.lit(fv.UNKNOWN)).alias("file"),
        F.format_number("score", 2).alias("score"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    listed = F.array_sort(F.collect_list(entry))
    parts = F.transform(listed, lambda m, i: fill(
        fv.CHUNK_HEADER, no=(i + 1).cast("string"), fund=m["fund"], file=m["file"], score=m["score"], text=m["text"]))
    return matches.groupBy("question_id").agg(F.array_join(parts, "\n").alias("context"))


def contexts_for(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """``question_id, context`` of every question; the fixed notice where nothing was found."""
    found = questions.select("question_id").join(chunk_contexts(matches), "question_id", "left")
    return found.select("question_id", or_no_chunks(F.col("context")).alias("context"))


def or_no_chunks(context: Column) -> Column:
    return F.coalesce(context, F.lit(fv.NO_CHUNKS))


def prompt(query_type: Column, context: Column, question: Column) -> Column:
    """The template of the question's type, filled in; null without a context."""
    return F.when(query_type == "aggregation", fill(fv.AGGREGATION_PROMPT, context=context, question=question)).otherwise(
        fill(fv.RETRIEVAL_PROMPT, context=context, question=question))


def system_prompt(context: Column, question: Column) -> Column:
    return fill(fv.SYSTEM_PROMPT, context=context, question=question)
