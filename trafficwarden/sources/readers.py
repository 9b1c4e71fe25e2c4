"""Sources and sinks of labelled query text. Every reader has an explicit schema; none infers one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficwarden.functions.text import url_decoded
from trafficwarden.operators.curate import keep_first

#: Fixed value: the request lines that start a request in a dump.
METHODS = "GET|POST|PUT"

LABELLED = T.StructType([T.StructField("raw_text", T.StringType()), T.StructField("flag", T.StringType())])


def _lined(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))


def labelled_csv(spark: SparkSession, path: str, source: str = "d1") -> DataFrame:
    """Headerless CSV of text and 0/1: raw_text, is_attack, source. Rows with another flag or an empty text go; of equal texts the first stays."""
    rows = _lined(spark.read.schema(LABELLED).csv(path, quote='"', escape='"', multiLine=True, mode="PERMISSIVE"))
    rows = rows.withColumn("raw_text", F.trim("raw_text")).filter("trim(flag) in ('0', '1') and raw_text <> ''")
    return keep_first(rows, ["raw_text"], ["_file", "_line"]).select("raw_text", (F.trim("flag") == "1").alias("is_attack"), F.lit(source).alias("source"))


def payload_files(spark: SparkSession, path: str, source: str = "d4") -> DataFrame:
    """Text files of one attack payload per line; of equal payloads the first by file and line stays."""
    rows = _lined(spark.read.text(path)).withColumn("raw_text", F.trim("value")).filter("raw_text <> ''")
    return keep_first(rows, ["raw_text"], ["_file", "_line"]).select("raw_text", F.lit(True).alias("is_attack"), F.lit(source).alias("source"))


def multilabel_csv(spark: SparkSession, path: str, columns: list[str], request: str, body: str, source: str = "d7") -> DataFrame:
    """CSV with a header: request and body decoded once; attack where a column named like "SQL Injection" is 1, benign where "Normal" is."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
    flag = lambda part: reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{c}`").try_cast("double") == 1, F.lit(False)) for c in columns if part in c], F.lit(False))
    text = F.trim(url_decoded(F.concat_ws(" ", F.coalesce(F.col(f"`{request}`"), F.lit("")), F.coalesce(F.col(f"`{body}`"), F.lit(""))), 1))
    out = rows.select(text.alias("raw_text"), F.when(flag("SQL Injection"), True).when(flag("Normal"), False).alias("is_attack"), F.lit(source).alias("source"))
    return out.filter("is_attack is not null and raw_text <> ''")


def split_requests(lines: DataFrame) -> DataFrame:
    """file, position (from 0 in its file), raw_request of dumps given as lines: file, block, line, value.

    A line that starts like a request line begins a request; what stands before the first is dropped,
    line breaks at both ends of a request go. line is the order within a block of a file, block that
    within the file. Requests are numbered by running counts within a block and sums over the
    blocks of the file in front, so a dump of any size is spread over tasks, and a request may reach over blocks.
    """
    rows = lines.withColumn("_start", F.rlike("value", F.lit(rf"^(?:{METHODS}) ")).cast("long"))
    totals = rows.groupBy("file", "block").agg(F.sum("_start").alias("_n"))
    before = totals.select("file", "block", (F.sum("_n").over(W.partitionBy("file").orderBy("block")) - F.col("_n")).alias("_front"))  # a row a block
    inner = F.sum("_start").over(W.partitionBy("file", "block").orderBy("line"))
    rows = rows.withColumn("_inner", inner).join(before, ["file", "block"]).withColumn("position", F.col("_inner") + F.col("_front") - 1).filter("position >= 0")
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    text = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    return rows.groupBy("file", "position").agg(F.regexp_replace(text, r"\A\n+|\n+\z", "").alias("raw_request"))


def http_dump(spark: SparkSession, path: str) -> DataFrame:
    """file, position, raw_request of the requests of the dump files at path; a large file is read by many tasks."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return split_requests(lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"))


def http_requests(requests: DataFrame, split: str | None = None, source: str = "d3") -> DataFrame:
    """raw_text (URL and body), is_attack, source of requests with columns raw_request, label, split; those without a request line go."""
    rows = requests if split is None else requests.filter(F.col("split") == split)
    url = F.regexp_extract("raw_request", rf"(?m)^(?:{METHODS})\s+(\S+)\s+HTTP", 1)
    body = F.coalesce(F.get(F.split(F.regexp_replace("raw_request", "\r\n", "\n"), "\n\n", 2), F.lit(1)), F.lit(""))
    out = rows.select(url.alias("url"), F.trim(url_decoded(F.concat_ws(" ", url, F.trim(body)), 1)).alias("raw_text"), (F.col("label") != "normal").alias("is_attack"), F.lit(source).alias("source"))
    return out.filter("url <> ''").drop("url")


def csv_keep_na(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header in which empty fields, NA and null are text."""
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="\u0001", emptyValue="")
    return rows.select(*[F.coalesce(f.name, F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema])


def write_dataset(df: DataFrame, path: str, by: str = "split") -> None:
    """Parquet with a folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Rows as JSON lines at the end of a ledger, in files of even size: one for a few rows, more for many."""
    df.hint("rebalance").write.mode("append").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON ledger; blank and malformed lines are skipped, a missing ledger is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A metric table (a few rows, one file) as JSON lines or CSV with a header; what makes it runs in parallel."""
    writer = df.repartition(1).write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)
