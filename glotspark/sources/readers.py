"""Sources: CSV in UTF-8 (with or without BOM) or cp949, texts, and an encoding inspector."""

from __future__ import annotations

import codecs
import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte order marks, longest first: fixed values.
MARKS = [("UTF-32-LE BOM", codecs.BOM_UTF32_LE), ("UTF-32-BE BOM", codecs.BOM_UTF32_BE), ("UTF-8 BOM", codecs.BOM_UTF8), ("UTF-16-LE BOM", codecs.BOM_UTF16_LE), ("UTF-16-BE BOM", codecs.BOM_UTF16_BE)]


def decode(data: bytes) -> tuple[str, str]:
    """Text without leading BOMs and the encoding that read it; an error where neither does."""
    for name in ("utf-8-sig", "cp949"):
        try:
            return data.decode(name).lstrip("\ufeff"), name
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor cp949")


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding) of each file: utf-8-sig, cp949, or null where neither reads it. Files are read line by line and split over tasks."""

    @F.pandas_udf("boolean")
    def korean(s: pd.Series) -> pd.Series:
        def ok(b):
            try:
                return bytes(b).decode("cp949") is not None
            except UnicodeDecodeError:
                return False

        return s.map(ok)

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("utf8"), F.col("value").cast("binary").alias("raw"))
    # Lines in valid UTF-8 can be anything in cp949, so a file's other lines and these are tried alike.
    per_file = lines.groupBy("path").agg(F.bool_and("utf8").alias("utf8"))
    other = lines.join(per_file.where("NOT utf8").select("path"), "path").groupBy("path").agg(F.bool_and(korean("raw")).alias("cp949"))
    name = F.when(F.col("utf8"), "utf-8-sig").when(F.col("cp949"), "cp949")
    return per_file.join(other, "path", "left").select("path", name.alias("encoding"))


def _parsed(names: list[str], kind: T.StructType):
    """The rows of a whole CSV text, its header left out; empty cells are null."""

    @F.pandas_udf(T.ArrayType(kind))
    def rows(s: pd.Series) -> pd.Series:
        fill = lambda x: [v or None for v in (x + [None] * len(names))[: len(names)]]
        return s.map(lambda t: [dict(zip(names, fill(x), strict=True)) for x in list(csv.reader(io.StringIO(t, newline="")))[1:] if x])

    return rows


def _legacy(spark: SparkSession, files: list[str], multi_line: bool) -> DataFrame:
    """CSV files in cp949, decoded whole file by file in Python and parsed by Spark: no session setting is touched."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode("cp949"))

    whole = spark.read.format("binaryFile").load(files).select(text("content").alias("text"))
    header = whole.select(F.split("text", "\r?\n")[0].alias("h")).distinct().collect()  # one row for each header
    out = None
    for r in header:
        names = next(csv.reader([r.h]))
        kind = T.StructType([T.StructField(n, T.StringType()) for n in names])

        one = whole.where(F.split("text", "\r?\n")[0] == r.h).select(F.explode(_parsed(names, kind)("text")).alias("row")).select("row.*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows, all columns as strings, and (path, encoding) of the files; an error if a file can't be decoded.

    Files in UTF-8 are Spark's; those in cp949 are decoded whole, so they must fit in a task's memory.
    """
    found = encodings(spark, path).collect()  # a row for each file, as Spark's own listing
    bad = [r.path for r in found if r.encoding is None]
    if bad:
        raise ValueError(f"neither UTF-8 nor cp949: {bad}")
    out = None
    for name, charset in (("utf-8-sig", "UTF-8"), ("cp949", None)):
        files = [r.path for r in found if r.encoding == name]
        if files:
            one = _legacy(spark, files, multi_line) if name == "cp949" else spark.read.csv(files, header=True, multiLine=multi_line, encoding=charset, escape='"')
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    listing = spark.createDataFrame([tuple(r) for r in found], "path string, encoding string")
    return (spark.createDataFrame([], "value string") if out is None else out), listing


def strings(df: DataFrame) -> DataFrame:
    """All cells as strings, a missing one as the empty string."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of whole files, decoded as ``decode`` does; null text and encoding where that fails."""

    @F.pandas_udf("text string, encoding string")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(b):
            try:
                return decode(bytes(b))
            except ValueError:
                return None, None

        return pd.DataFrame([one(b) for b in s], columns=["text", "encoding"])

    files = spark.read.format("binaryFile").load(path).select("path", run("content").alias("r"))
    return files.select("path", "r.text", "r.encoding")


def read_table(spark: SparkSession, url: str, table: str, number: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table over JDBC; with a numeric column and its bounds, in ``parts`` ranges at once. Filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if number and bounds:
        reader = reader.options(partitionColumn=number, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, head, verdict): the first 32 bytes in hex, and the BOM, UTF-8, cp949 or unknown."""

    @F.pandas_udf("string")
    def mark(s: pd.Series) -> pd.Series:
        return s.map(lambda b: next((n for n, m in MARKS if bytes(b).startswith(m)), None))

    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, 32).alias("first"))
    verdict = F.coalesce(mark("first"), F.when(F.col("encoding") == "utf-8-sig", "UTF-8").when(F.col("encoding") == "cp949", "cp949"), F.lit("unknown"))
    # Paths of the two readers differ in their scheme only.
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    named = encodings(spark, path).select(bare(F.col("path")).alias("at"), "encoding")
    return files.withColumn("at", bare(F.col("path"))).join(named, "at", "left").select("path", F.col("length").alias("size"), F.lower(F.hex("first")).alias("head"), verdict.alias("verdict"))
