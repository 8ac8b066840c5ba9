"""Readers of the parquet tables, and file imports."""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy Python stages enough tasks where their input is a few small files.

    Round-robin over the session's shuffle partitions, so there is no key and no
    skew. Inputs of at least as many files as cores are left as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files holding a list, an object with ``records``, or one object.

    Gives (text, metadata, error): the text is ``text``, else ``content``, else
    ``query`` of a record; a record with none, or only blanks, has the error
    ``empty text`` and a file that is no JSON the error ``unreadable``.
    """
    raw = spark.read.text(path, wholetext=True)
    value = F.try_parse_json("value")
    records = (
        F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        .when(F.try_variant_get(value, "$.records", "array<variant>").isNotNull(), F.try_variant_get(value, "$.records", "array<variant>"))
        .otherwise(F.array(value))
    )
    rows = raw.select(value.alias("v"), F.explode_outer(records).alias("r"))
    text = F.coalesce(*(F.try_variant_get("r", f"$.{k}", "string") for k in ("text", "content", "query")))
    return rows.select(
        text.alias("text"),
        F.to_json("r").alias("metadata"),
        F.when(F.col("v").isNull(), "unreadable").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty text").alias("error"),
    )


def import_csv(spark: SparkSession, path: str, sep: str = ",", text_column: str = "text") -> DataFrame:
    """Rows of CSV files with a header; every column is also kept in ``metadata``."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    text = F.col(text_column) if text_column in df.columns else F.lit(None).cast("string")
    return df.select(
        text.alias("text"),
        F.to_json(F.struct(*df.columns)).alias("metadata"),
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty text").alias("error"),
    )


_HEADER = re.compile(r"\ufeff?\s*\w+(?:,\w+)*\r?\n")


def csv_texts(value: str | None, text_column: str = "text") -> list[str | None] | None:
    """``text_column`` of the records of a text that starts with a CSV header naming it, else None; blank lines are no records."""
    head = _HEADER.match(value or "")
    if not head or text_column not in (names := head[0].strip("\ufeff \t\r\n").split(",")) or len(names) < 2:
        return None
    at = names.index(text_column)
    csv.field_size_limit(2**31 - 1)
    rows = csv.reader(io.StringIO(value[head.end() :], newline=""))
    return [r[at] if at < len(r) else None for r in rows if r]


def wrapped_texts(text: str | Column) -> Column:
    """Texts of the records of a JSON list, a JSON object with ``records`` or CSV with a header, told by the text alone; null of any other text."""

    @F.pandas_udf("array<string>")
    def of_csv(s: pd.Series) -> pd.Series:
        return s.map(csv_texts)

    t = F.col(text) if isinstance(text, str) else text
    v = F.try_parse_json(t)
    of_json = F.coalesce(F.try_variant_get(v, "$.records", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    return F.coalesce(F.transform(of_json, lambda r: F.try_variant_get(r, "$.text", "string")), of_csv(t))


def import_text(spark: SparkSession, path: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Whole files cut into overlapping word chunks."""
    from mnemora.functions.text import chunk_words

    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select("path", F.posexplode(chunk_words("value", size, overlap)).alias("chunk", "text"))
