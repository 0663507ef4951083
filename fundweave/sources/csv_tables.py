"""CSV files to clean, typed tables that remember the order of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fundweave import fixed_values as fv

# A double as the reader of the tables understands it: no suffix letters, no separators.
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"
_BAD = "bad_cells"


# --- cell rules --------------------------------------------------------------

def missing_as_null(value: Column) -> Column:
    return F.when(~value.isin(fv.NA_TOKENS), value)


def number(value: Column) -> Column:
    """The number, or 0 where the text is none."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"infinity|inf", "Infinity")
    return F.coalesce(F.when(value.rlike(_NUMBER), text.try_cast("double")), F.lit(0.0))


def day(value: Column) -> Column:
    """Day first, two-digit year: 69-99 belong to the last century, 00-68 to this one."""
    parsed = F.try_to_timestamp(value, F.lit("d/M/yy")).cast("date")
    return F.when(F.year(parsed) > 2068, F.add_months(parsed, -1200)).otherwise(parsed)


def close_label(close_date: Column) -> Column:
    return F.coalesce(F.date_format(close_date, "yyyy-MM-dd HH:mm:ss"), F.lit(fv.OPEN_LABEL))


# --- whole tables ------------------------------------------------------------

def _present(df: DataFrame, names) -> list[str]:
    return [name for name in names if name in df.columns]


def nulls_for_missing(df: DataFrame) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: missing_as_null(F.col(name)) for name in texts})


def clean_holdings(raw: DataFrame) -> DataFrame:
    """All-text holdings to typed ones. Only columns that exist are converted.

    A date that cannot be read becomes null and is counted in ``bad_cells``.
    """
    df = nulls_for_missing(raw)
    dates, numbers = _present(df, fv.HOLDINGS_DATES), _present(df, fv.HOLDINGS_NUMBERS)
    changed = {name: day(F.col(name)) for name in dates} | {name: number(F.col(name)) for name in numbers}
    broken = [(F.col(n).isNotNull() & day(F.col(n)).isNull()).cast("int") for n in dates]
    changed[_BAD] = sum(broken, F.lit(0))
    df = df.withColumns(changed).na.fill({k: v for k, v in fv.HOLDINGS_FILL.items() if k in df.columns})
    if "CloseDate" in df.columns:
        df = df.withColumns({
            "close_label": close_label(F.col("CloseDate")),
            "is_open": F.col("CloseDate").isNull(),
        })
    return df


def clean_trades(raw: DataFrame) -> DataFrame:
    df = nulls_for_missing(raw)
    df = df.withColumns({name: number(F.col(name)) for name in _present(df, fv.TRADES_NUMBERS)})
    return df.na.fill({k: v for k, v in fv.TRADES_FILL.items() if k in df.columns})


def cell_report(holdings: DataFrame) -> DataFrame:
    return holdings.agg(F.count("*").alias("rows"), F.sum(_BAD).alias("bad_cells"))


def _header_schema(spark: SparkSession, path: str | list[str]) -> T.StructType:
    """Every column as text; only the header line is looked at."""
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """All columns as text plus ``row_ord``: file, position of the split, position of the row.

    Files count in path order. Within a split Spark numbers rows in reading
    order, so the three parts together give back the order of the source.
    """
    raw = (
        spark.read.schema(_header_schema(spark, path))
        .options(header=True, multiLine=multi_line, nullValue="\u0000", emptyValue="",
                 escape='"', enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return raw.select("*", position.alias("row_ord"))


def load_holdings(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return clean_holdings(read_csv(spark, path, **options))


def load_trades(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return clean_trades(read_csv(spark, path, **options))


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a cleaned table as Parquet and read it back; ``row_ord`` is fixed from here on."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
