"""Reading and writing: Parquet tables, JSON pages, JSON lines, gzip, vectors, SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PAGE = (
    "page_id string, printed int, model string, prompt_version string, page_number_printed string, running_header string, page_level_issues array<string>, "
    "blocks array<struct<order:int,type:string,author_role:string,column:int,text:string,footnote_markers_in_text:array<string>,footnote_marker:string,continues_from_prev:boolean,continues_to_next:boolean,confidence:double,issues:array<string>>>"
)
OCR_PAGE = "page_id string, engine string, width int, height int, text string, lines array<struct<id:string,bbox:array<int>,text:string,conf:double,words:array<struct<text:string,bbox:array<int>,conf:double>>>>"
USAGE = "ts double, stage string, provider string, model string, input_tokens long, output_tokens long, cost_usd double, cached boolean, seconds double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables, for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_json_pages(spark: SparkSession, path: str, schema: str = PAGE) -> DataFrame:
    """One JSON document a file, gzip too."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = USAGE) -> DataFrame:
    """JSON lines; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files (images, documents) as bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def without_bom(text):
    return F.regexp_replace(text, "^\\uFEFF", "")


def blocks(pages: DataFrame, book: str) -> DataFrame:
    """A row per block with its ids; reading order is the place in the page's list."""
    b = pages.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.*")
    return b.withColumn("block_id", F.format_string("%s-b%02d", F.col("page_id"), F.col("pos") + 1)).withColumn("book", F.lit(book))


def as_timestamp(df: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less times as timestamps (watermarks need them); the session's zone is UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _folder(spark: SparkSession, path: str):
    """(file system, maker of paths) of a path in any store."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that a versioned table has made public, in order."""
    fs, make = _folder(spark, path)
    where = make(f"{path.rstrip('/')}/public")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []


def read_version(spark: SparkSession, path: str, schema, number: int | None = None) -> DataFrame:
    """The latest (or one) version of a versioned table; an empty frame before the first."""
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/version={found[-1] if number is None else number}")


def write_version(df: DataFrame, path: str, keep: int = 2) -> int:
    """Writes the table's next version beside the others and then makes it public, by the one step
    of creating an empty file with its number. A run that fails before that changes nothing for
    readers; of two runs at once, the second one to finish fails. The last ``keep`` versions stay.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    fs, make = _folder(spark, root)
    number = max(versions(spark, root), default=0) + 1
    df.write.mode("overwrite").parquet(f"{root}/version={number}")
    if not fs.createNewFile(make(f"{root}/public/{number}")):
        raise OSError(f"version {number} of {root} was written by another run")
    for old in versions(spark, root)[:-keep]:
        fs.delete(make(f"{root}/public/{old}"), False)
        fs.delete(make(f"{root}/version={old}"), True)
    return number


def merge_decisions(spark: SparkSession, new: DataFrame, path: str, keys: list[str], at: str) -> DataFrame:
    """Merges decisions into the versioned table at ``path`` and gives the latest of each key.

    Readers have the version before or the one after, whatever fails in between.
    """
    from folioscope.operators.review import latest

    rows = read_version(spark, path, new.schema).unionByName(new)
    write_version(latest(rows, keys, at).select(*new.columns), path)
    return read_version(spark, path, new.schema)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A streaming frame into a table of files, as far as its source goes now; exactly once by its checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
