"""Readers for the formats of the log and its side tables."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines of text files (also .gz) with file_name and ord, which keeps the order of lines.

    ord grows within a file; it is fixed at the scan, before any shuffle.
    """
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    return lines.filter(F.length(F.trim("value")) > 0).select("value", "file_name", F.struct("_start", "_id").alias("ord"))


def one_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else; a repeated key is allowed (its last value counts).

    Parsers take text after a value, so the text is read inside [...]; only where it could close that bracket itself, it is read inside {"r": ...} too.
    """
    alone = (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & F.trim(text).startswith("{")
    again = F.when(text.rlike(r"\}\s*\]"), F.get_json_object(F.concat(F.lit('{"r":'), text, F.lit("}")), "$.r").isNotNull()).otherwise(F.lit(True))
    return F.coalesce(alone & again, F.lit(False))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines by schema with ord; a broken line gives NULL columns and its text in _broken."""
    names = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fieldNames()
    lines = read_lines(spark, path).withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    whole = one_object(F.col("value"))
    return lines.select("file_name", "ord", F.when(whole, F.col("_r")).alias("_r"), F.when(~whole, F.col("value")).alias("_broken")).select(
        "file_name", "ord", *[F.col("_r")[n].alias(n) for n in names], "_broken")


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """As read_jsonl, without the broken lines."""
    return read_jsonl(spark, path, schema).filter("_broken is null").drop("_broken")


def read_csv_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with header, every column a string; a byte order mark is dropped from the first name, cells may be of any length."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, maxCharsPerColumn=-1, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_csv_typed(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def read_config(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def topic_grid(spark: SparkSession, path: str) -> DataFrame:
    """(specialty, topic_index, topic) of a JSON object from specialty to its list of topics."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("specialty", "topics")).select(
        "specialty", F.posexplode("topics").alias("topic_index", "topic"))


def read_positional(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A JSON array of lists as columns by position."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("a"))
    return text.select(*[F.get("a", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_runs(spark: SparkSession, pattern: str, skip: tuple[str, ...] = ("pilot", "budget")) -> DataFrame:
    """Lines of all items_<run> files with their run, without runs whose name begins with one of `skip`."""
    lines = read_lines(spark, pattern).withColumn("run", F.regexp_extract("file_name", r"^items_(.*?)\.jsonl", 1))
    for prefix in skip:
        lines = lines.filter(~F.col("run").startswith(prefix))
    return lines


def _literal(text: str | None) -> list[str] | None:
    try:
        value = ast.literal_eval(text) if text else None
    except (ValueError, SyntaxError):
        return None
    return [str(x) for x in value] if isinstance(value, (list, tuple)) else None


def python_list(text: Column) -> Column:
    """A list written as a Python literal; NULL where it is none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(_literal)

    return run(text)


def sheet_text(cell: Column, kind: str) -> Column:
    """Text of a spreadsheet cell: NULL and NaN as '', dates as month-day, whole numbers without a point."""
    if kind == "timestamp":
        return F.coalesce(F.concat_ws("-", F.month(cell), F.dayofmonth(cell)), F.lit(""))
    if kind == "double":
        whole = (cell == F.floor(cell)) & (F.abs(cell) < 1e15)
        return F.when(cell.isNull() | F.isnan(cell), "").when(whole, cell.cast("long").cast("string")).otherwise(cell.cast("string"))
    return F.trim(F.coalesce(cell.cast("string"), F.lit("")))


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of a workbook as rows (sheet, row_no, name, value); needs openpyxl, which may be absent."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as missing:
        raise RuntimeError("reading workbooks needs openpyxl; convert them to CSV") from missing
    sheets = pd.read_excel(path, sheet_name=None, dtype=str)
    rows = [(s, i, str(c), v) for s, t in sheets.items() for i, r in t.iterrows() for c, v in r.items()]
    return spark.createDataFrame(rows, "sheet string, row_no long, name string, value string")


def render(template: Column, **values: Column) -> Column:
    """Prompt text with {name} replaced; doubled braces stay single braces."""
    out = F.replace(F.replace(template, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return F.replace(F.replace(out, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))
