"""Writers: CSV with header, appended JSON lines, aggregates, manifests, and guarded reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> bool:
    """CSV with a header; an empty frame writes nothing. One file only for small reports."""
    if df.isEmpty():
        return False
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')
    return True


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds rows as JSON lines; rows written before stay, so a stopped run can go on."""
    df.write.mode("append").json(path, ignoreNullFields=False)


def write_aggregate(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(file_name, n_bytes, md5) of files that fit one row each; larger ones need a checksum by block."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"), F.md5("content").alias("md5"))


def suppressed(value: Column, n: Column, least: int = 5) -> Column:
    """The value where at least `least` cases stand behind it, else NULL."""
    return F.when(n >= least, value)


class Report:
    """Lines of a text report over small aggregates, refused if they hold a protected text of 12 characters or more."""

    def __init__(self, protected: list[str] = ()):
        self.lines: list[str] = []
        self.protected = [p for p in protected if len(p) >= 12]

    def add(self, line: str) -> None:
        if any(p in line for p in self.protected):
            raise ValueError("the line holds a protected text")
        self.lines.append(line)

    def table(self, df: DataFrame, most: int = 1000) -> None:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a report table has at most {most} rows")
        self.add("\t".join(df.columns))
        for row in rows:
            self.add("\t".join("" if v is None else str(v) for v in row))

    def text(self) -> str:
        return "\n".join(self.lines) + "\n"
