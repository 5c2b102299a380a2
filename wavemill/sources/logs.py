"""Experiment logs (TSV with a row order), and run logs of "key: value" lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import number, status


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` (DDL) by the header's names, and exp_no, a row's place in the file from 0.

    Doubles that do not parse are null; a status is trimmed and upper-cased. The file is read as one
    text, since rows of a split file have no order.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("_i", "_l"))
    header = lines.where("_i = 0").select(F.split("_l", "\t").alias("h")).first()
    names = [h.strip() for h in header["h"]] if header else []
    rows = lines.where("_i > 0 and trim(_l) <> ''").select((F.col("_i") - 1).alias("exp_no"), F.split("_l", "\t").alias("c"))

    def column(f: T.StructField) -> Column:
        raw = F.get("c", names.index(f.name)) if f.name in names else F.lit(None).cast("string")
        raw = F.when(raw != "", raw)
        return (number(raw) if isinstance(f.dataType, T.DoubleType) else status(raw) if f.name == "status" else raw).alias(f.name)

    return rows.select("exp_no", *[column(f) for f in T.StructType.fromDDL(schema)])


def append_tsv(rows: DataFrame, path: str) -> None:
    """Append rows as tab-separated files with a header under the folder ``path``."""
    rows.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def metric_of(text: str | Column, name: str) -> Column:
    """The number on the line "name: ..." of a log text, without a trailing unit; null if there is none."""
    found = F.regexp_extract(text, rf"(?m)^{name}:\s*([-+0-9.eE]+)", 1)
    return number(F.when(found != "", found))


def read_run_log(spark: SparkSession, path: str, metrics: tuple[str, ...] = ("splice_f1", "precision", "recall", "fp_rate", "elapsed")) -> DataFrame:
    """One row a file: path, and each metric; what a crashed run did not print is null."""
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return x.select("path", *[metric_of("value", m).alias(m) for m in metrics])


def case_lines(spark: SparkSession, path: str) -> DataFrame:
    """tier, status, name, tp, fp, fn of the per-file lines of run logs."""
    pattern = r"^\s*T(\d+)\s+(OK|MISS)\s+(\S+): TP=(\d+) FP=(\d+) FN=(\d+)"
    x = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return x.select(part(1).cast("int").alias("tier"), part(2).alias("status"), part(3).alias("name"), *[part(i).cast("long").alias(n) for i, n in ((4, "tp"), (5, "fp"), (6, "fn"))])
