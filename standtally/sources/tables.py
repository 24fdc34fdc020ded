"""Reading inventory CSV files with declared schemas, canonical names, and writing tables."""

from __future__ import annotations

import csv
import re
import unicodedata
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def canonical_name(name: str) -> str:
    """Snake-case identifier of a source column."""
    plain = "".join(
        c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)
    )
    split = re.sub(r"([a-z0-9])([A-Z])|([A-Z])([A-Z][a-z])", r"\1\3_\2\4", plain)
    return re.sub(r"[^0-9A-Za-z]+", "_", split).strip("_").lower()


def canonical_columns(df: DataFrame) -> DataFrame:
    """All columns under canonical names; each keeps its source name as metadata.

    Names that collide after the change get a running number.
    """
    seen: dict[str, int] = {}
    columns = []
    for name in df.columns:
        base = canonical_name(name)
        seen[base] = seen.get(base, 0) + 1
        unique = base if seen[base] == 1 else f"{base}_{seen[base]}"
        quoted = "`" + name.replace("`", "``") + "`"
        columns.append(F.col(quoted).alias(unique, metadata={"source_name": name}))
    return df.select(*columns)


def rename_by_pattern(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Rename every column through a regular expression."""
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The header lines of a CSV file or folder, each with its files.

    The first line of a file is that of its first block; one line a file is gathered, with
    a partial aggregate in every task.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.filter((F.col("at") == 0) & (F.trim("value") != "")).groupBy("file").agg(
        F.min_by("value", "line").alias("header")
    )
    found: dict[str, list[str]] = {}
    for row in first.collect():
        found.setdefault(row["header"].lstrip("\ufeff"), []).append(unquote(row["file"]))
    return found


def read_inventory_csv(
    spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False
) -> DataFrame:
    """Header CSV; the declared columns are found by name, wherever they stand.

    Files of a folder may differ in the order and number of their columns: files of one
    header are read together, each group by its own names. Other columns are passed over. Of
    columns with one name the first counts; a declared column that a file lacks is an error.
    ``NA`` is missing, a blank text stays blank, and a value that is not of its declared type
    is missing; ``keep_corrupt`` adds the values of such a row as one text. Headers are read
    when the plan is built; one line a file comes to the driver. Empty files have no rows.
    """
    headers = _headers(spark, path)
    if not headers:
        corrupt = [T.StructField(CORRUPT, T.StringType())] if keep_corrupt else []
        return spark.createDataFrame([], T.StructType([*schema.fields, *corrupt]))
    whole = len(headers) == 1
    parts = [
        _read_group(spark, path if whole else sorted(files), header, schema, keep_corrupt)
        for header, files in sorted(headers.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _read_group(
    spark: SparkSession, path: str | list[str], header: str, schema: T.StructType, keep_corrupt: bool
) -> DataFrame:
    """Files that share a header."""
    options = {"emptyValue": "", "multiLine": False, "quote": '"', "escape": '"'}
    names = next(csv.reader([header]))
    places: dict[str, int] = {}
    for place, name in enumerate(names):
        places.setdefault(name, place)
    absent = [f.name for f in schema.fields if f.name not in places]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    texts = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(len(names))])
    read = spark.read.csv(path, schema=texts, header=True, enforceSchema=True, **options)

    def given(field: T.StructField) -> Column:
        # The reader takes a blank without quotes for a missing value; here only NA is one.
        return F.nullif(F.coalesce(F.col(f"_{places[field.name]}"), F.lit("")), F.lit("NA"))

    def typed(field: T.StructField) -> Column:
        text = given(field)
        return text if isinstance(field.dataType, T.StringType) else F.trim(text).try_cast(field.dataType)

    columns = [typed(f).alias(f.name) for f in schema.fields]
    if keep_corrupt:
        bad = F.lit(False)
        for f in schema.fields:
            bad = bad | (typed(f).isNull() & F.coalesce(F.trim(given(f)) != "", F.lit(False)))
        values = [F.coalesce(F.col(c), F.lit("")) for c in texts.names]
        columns.append(F.when(bad, F.concat_ws(",", *values)).alias(CORRUPT))
    return read.select(*columns)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    format: str = "parquet",
    mode: str = "errorifexists",
) -> None:
    """Write Parquet, or CSV for export in the form ``read_inventory_csv`` reads."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.csv(path, header=True, nullValue="NA", emptyValue='""', quote='"', escape='"')
    else:
        writer.format(format).save(path)
