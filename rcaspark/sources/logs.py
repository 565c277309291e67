"""Scans of templates, structured lines, JSON hits, compressed lines and file catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rcaspark.sources.records import quoted_records

# File name suffixes of a pod's two log tables, and their columns.
TEMPLATE_SUFFIX = "_messages_templates.csv"
STRUCTURED_SUFFIX = "_messages_structured.csv"
TEMPLATE_SCHEMA = "EventId STRING, EventTemplate STRING, Occurrence BIGINT"
STRUCTURED_SCHEMA = "LineId BIGINT, Time STRING, Content STRING, EventId STRING, EventTemplate STRING, ParameterList STRING"

# A file of that name, or a folder of part files that stands for it.
_PAIR_NAME = r"(?:^|/)(?:file=)?([^/]*)_messages_(templates|structured)\.csv(?:/[^/]*)?$"

HIT_SCHEMA = (
    "hits STRUCT<hits: ARRAY<STRUCT<_source: STRUCT<"
    "`@timestamp`: STRING, kubernetes: STRUCT<pod_name: STRING, namespace_name: STRING>>>>>"
)


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]+)$", 1)


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def entity_of(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), _PAIR_NAME, 1)


def kind_of(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), _PAIR_NAME, 2)


def file_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Path and size of every file below ``root``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"))


def log_files(catalog: DataFrame, folder: str | None = None) -> DataFrame:
    """Template and structured files of a catalog, with entity and kind."""
    rows = catalog.withColumn("entity", entity_of(F.col("path"))).withColumn("kind", kind_of(F.col("path"))).where("kind <> ''")
    if folder is not None:
        rows = rows.where(base_name(parent_path(F.col("path"))) == folder)
    return rows


def read_templates(spark: SparkSession, glob: str) -> DataFrame:
    """All template files in one scan; ``pos`` is the row order within a file.

    Template files hold a few dozen rows each, so one window per entity is small.
    """
    raw = spark.read.csv(glob, header=True, schema=TEMPLATE_SCHEMA, multiLine=True, escape='"')
    rows = raw.select(
        entity_of(F.col("_metadata.file_path")).alias("entity"),
        F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("template"),
        F.col("Occurrence").alias("occurrence"), F.monotonically_increasing_id().alias("pos"),
    )
    return rows


def read_structured(spark: SparkSession, glob: str) -> DataFrame:
    """All structured files in one scan; the line number of the file is the order.

    Contents may hold quoted line breaks; a file is read by as many tasks as it
    has splits, see ``quoted_records``. The first record of a file is its header.
    """
    records = quoted_records(spark, glob).where("not (block = 0 and line = 0)").where("text <> '' and text <> '\\r'")
    fields = F.from_csv(F.rtrim("text", F.lit("\r")), F.lit(STRUCTURED_SCHEMA), {"escape": '"', "maxCharsPerColumn": "-1"})
    raw = records.select("path", fields.alias("r"))
    return raw.select(
        entity_of(F.col("path")).alias("entity"),
        F.col("r.EventId").alias("event_id"), F.col("r.Time").alias("time"),
        F.col("r.Content").alias("content"), F.col("r.LineId").alias("pos"),
    )


def read_hits(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """One row per hit of nested JSON log pages; absent fields are null."""
    pages = spark.read.schema(HIT_SCHEMA).option("multiLine", str(not one_per_line).lower()).json(path)
    src = pages.select(F.explode("hits.hits").alias("h")).select("h._source.*")
    return src.select(
        F.col("`@timestamp`").alias("time"), F.col("kubernetes.pod_name").alias("pod"),
        F.col("kubernetes.namespace_name").alias("namespace"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of (compressed) text files as stored bytes, with the file they came from."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def line_volume(lines: DataFrame, key: Column) -> DataFrame:
    """Records and bytes per file; the line end counts as one byte."""
    return lines.groupBy(key).agg(
        F.count("*").alias("records"), F.sum(F.octet_length("line") + 1).alias("bytes"))


def inventory_rows(lines: DataFrame, column: str) -> DataFrame:
    """Whitespace-delimited inventory lines with more than two fields."""
    fields = F.split(F.trim(F.col(column)), r"\s+")
    return lines.withColumn("fields", fields).where(F.size("fields") > 2)
