"""CSV, JSON and Parquet readers and writers with explicit schemas."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NullType, StringType, StructField, StructType

from ..operators.reports import markdown_table
from .delimited import bind_csv

RAW_SCHEMA = "base_id string, text string, intent string"
SPLIT_SCHEMA = (
    "base_id string, text string, intent string, clean_text string, emojis string, "
    "excess_punct_count int, label int"
)
ERROR_SCHEMA = (
    "clean_text string, intent string, predicted_intent string, confidence double, "
    "benchmark_source string, failure_analysis string"
)
RUN_LOG_SCHEMA = (
    "run_name string, timestamp timestamp, model_name string, learning_rate double, lora_r int, "
    "lora_alpha int, lora_dropout double, epochs int, train_batch_size int, train_loss double, "
    "val_loss double, val_accuracy double, val_macro_f1 double, adapter_dir string"
)
METRICS_SCHEMA = (
    "split string, accuracy double, macro_f1 double, macro_precision double, macro_recall double, "
    "weighted_f1 double, dataset_size bigint, "
    "per_class map<string, struct<precision:double, recall:double, f1_score:double, support:bigint>>"
)

TOKEN, TIME = "_append", "_appended_at"  # of a log's rows

# Texts hold line breaks, so one CSV file is one task: files are kept small on write.
MAX_CSV_RECORDS = 200_000


def read_csv(
    spark: SparkSession, path: str, schema: str | StructType, fill_empty=("emojis",), required: list[str] | None = None
) -> DataFrame:
    """Headered UTF-8 CSV, bound by the header of each file; records that do not fit it are left out.

    Empty cells of ``fill_empty`` columns become ''.  See ``delimited.bind_csv`` for
    ``required`` and for the records left out.
    """
    return bind_csv(spark, path, schema, required, fill_empty).rows


def write_csv(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    (
        df.write.mode(mode)
        .partitionBy(*partition_by)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", MAX_CSV_RECORDS)
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark knows has the path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType, required: str | None = None) -> DataFrame:
    """JSON lines with a fixed schema; rows without the ``required`` field are skipped.

    A missing path is an empty result.
    """
    df = spark.read.schema(schema).json(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    return df if required is None else df.filter(F.col(required).isNotNull())


def read_parquet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet in the columns of ``schema``; a missing path is an empty result."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _wider(spark: SparkSession, a: DataType, b: DataType) -> DataType:
    """The type that holds the values of both; text, if nothing else does."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, StringType) or isinstance(b, StringType):
        return StringType()
    try:
        one, two = (spark.createDataFrame([], StructType([StructField("x", t)])) for t in (a, b))
        return one.union(two).schema["x"].dataType
    except AnalysisException:
        return StringType()


def append_log(df: DataFrame, path: str, token: str | None = None, key: str | None = None) -> bool:
    """Append runs to a log as one commit; columns and their types may differ between appends.

    A commit is one file in the folder of its schema.  An append that is tried again
    with its ``token`` adds nothing; with a ``key``, runs whose key the log holds are
    left out.  Returns whether a commit was written.
    """
    spark = df.sparkSession
    if token and token in {r[0] for r in _log_rows(spark, path, [TOKEN]).distinct().collect()}:  # one per append
        return False
    if key:
        df = df.join(_log_rows(spark, path, [key]).distinct(), key, "left_anti").dropDuplicates([key])
    columns = sorted(df.columns)
    rows = df.withColumns({TOKEN: F.lit(token or uuid.uuid4().hex), TIME: F.current_timestamp()})
    digest = hashlib.md5(df.select(*columns).schema.json().encode()).hexdigest()
    rows.select(*columns, TOKEN, TIME).coalesce(1).write.mode("append").parquet(f"{path}/schema-{digest}")
    return True


def _log_frames(spark: SparkSession, path: str) -> list[DataFrame]:
    """One frame per schema of a log."""
    if not path_exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return [spark.read.parquet(str(f.getPath())) for f in found if f.getPath().getName().startswith("schema-")]


def _log_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of all schemas in the widest types, or some columns of those that have them."""
    frames, kinds = _log_frames(spark, path), {}
    for df in frames:
        for f in df.schema:
            kinds[f.name] = _wider(spark, kinds.get(f.name, NullType()), f.dataType)
    for c in columns or []:
        kinds.setdefault(c, StringType())
    names = columns or list(kinds)
    none = spark.createDataFrame([], StructType([StructField(c, kinds[c]) for c in names]))
    cast = lambda df: df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in names if c in df.columns])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(cast, frames), none)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a log; a log that was never written has none.

    Types that changed between appends are widened: a column of whole numbers and of
    fractions has fractions, one of numbers and of texts has texts.  Rows that two
    writers committed under one token count once.
    """
    rows = _log_rows(spark, path) if path_exists(spark, path) else spark.createDataFrame([], RUN_LOG_SCHEMA)
    if TOKEN not in rows.columns:
        return rows
    own = [c for c in rows.columns if c not in (TOKEN, TIME)]
    first = rows.groupBy(TOKEN).agg(F.min(TIME).alias("_first"))  # one row per append
    return rows.join(first, TOKEN).filter(F.col(TIME) == F.col("_first")).select(*own)


def read_csv_log(spark: SparkSession, path: str) -> DataFrame:
    """A run log kept as CSV with a header, in the columns of ``RUN_LOG_SCHEMA``; missing ones are null."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RUN_LOG_SCHEMA)
    return read_csv(spark, path, RUN_LOG_SCHEMA, (), required=["run_name"])


def write_markdown(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report as Markdown text, in one file, which one task writes."""
    lines = markdown_table(df, "value").coalesce(1).sortWithinPartitions("place")
    lines.select("value").write.mode(mode).text(path)
