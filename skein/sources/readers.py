"""Readers for raw exports, annotation files, id lists and JSON lines."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_COLUMNS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """A message export: all text, quoted fields may hold line breaks, doubled quotes are quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def head(spark: SparkSession, path: str, n: int = 1000, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """The first n rows of an export, for a look at it."""
    return raw_csv(spark, path, schema).limit(n)


def annotation_csv(spark: SparkSession, path: str) -> DataFrame:
    """An annotation file: all text, empty fields stay empty rather than null, a byte-order mark is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").csv(path)
    return df.toDF(*(c.lstrip("\ufeff").strip('"') for c in df.columns))


def labelled_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """(conversation_id, file) of every *_labelled.csv of a folder."""
    df = annotation_csv(spark, f"{folder}/*_labelled.csv")
    return df.select("conversation_id", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")).distinct()


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a text file: one per line, blank lines and those that start with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where((F.col("id") != "") & ~F.col("id").startswith("#")).distinct()


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; lines that are no JSON of the schema come as nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def physical_lines(spark: SparkSession, path: str) -> int:
    """Line breaks of a file, those inside quoted fields too."""
    return spark.read.option("lineSep", "\n").text(path).count()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often, in any order; columns by name."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    cols = sorted(a.columns)
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(7), *cols).cast("decimal(38,0)")).alias("g")).first()
    return tuple(mark(a)) == tuple(mark(b))


def csv_bytes(raw: bytes) -> tuple[list[str], list[dict[str, str]]]:
    """(header, rows) of a small CSV file in memory; the header is kept as it stands, without a byte-order mark."""
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    if not rows:
        return [], []
    return rows[0], [dict(zip(rows[0], r, strict=False)) for r in rows[1:]]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files of a folder; each is read by one task."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def only(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that df has; all others, such as labels that must stay hidden, are never read."""
    return df.select(*(c for c in allowed if c in df.columns))


def changed_rows(recorded: DataFrame, recomputed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column_name, recorded, recomputed) where a recorded value differs from the recomputed one; rows of one side only have nulls."""
    a = recorded.select(key, *(F.col(c).cast("string").alias(f"a_{c}") for c in columns))
    b = recomputed.select(key, *(F.col(c).cast("string").alias(f"b_{c}") for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").alias("recorded"), F.col(f"b_{c}").alias("recomputed")) for c in columns)))
    return a.join(b, key, "full").select(key, pairs.alias("x")).select(key, "x.*").where(~F.col("recorded").eqNullSafe(F.col("recomputed")))
