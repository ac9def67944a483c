"""Order-line CSV files (S1, S2) with per-file line numbers.

The reference reads one CSV with Python's csv module: a header row, quoted
fields with doubled quotes, latin-1 text, blank lines skipped, and numbers
every parsed row from 0. Here Spark's CSV source reads any number of files
in parallel, all columns as text, short rows flagged in a corrupt-record
column, and the line number of each row is computed without collecting a
file: rows are numbered inside each (file, block) split in scan order,
and every block is offset by the row count of the file's earlier blocks.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import OPTIONAL, REQUIRED
from ..functions.joins import maybe_broadcast

LATIN_1 = "ISO-8859-1"
UTF_8 = "UTF-8"
CORRUPT = "_corrupt"


def _reader(spark: SparkSession, encoding: str, multiline: bool):
    return (spark.read.option("header", True).option("encoding", encoding)
            .option("multiLine", multiline).option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))


def read_order_lines(spark: SparkSession, path: str | list[str], encoding: str = LATIN_1,
                     multiline: bool = True, header: list[str] | None = None) -> DataFrame:
    """Every row as text (header names kept), ``_corrupt`` for short or
    malformed rows, and ``line_no`` (0-based per file, header excluded).

    All files must have one header; ``read_order_lines_any_encoding`` takes any.
    ``multiline`` allows newlines inside quoted fields, as the reference's
    reader does; it makes each file one split. Set it off for large files
    without such fields, so files split across tasks."""
    paths = [path] if isinstance(path, str) else list(path)
    header = header or _reader(spark, encoding, multiline).csv(paths).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header]
                          + [T.StructField(CORRUPT, T.StringType())])
    rows = _reader(spark, encoding, multiline).schema(schema).csv(paths)
    return with_line_no(rows, most_blocks(spark, paths))


# Spark cuts files into blocks of 4 to 128 MB by default; a block's row in memory has the file's path.
LEAST_BLOCK_BYTES, BLOCK_ROW_BYTES = 1024 * 1024, 512


def most_blocks(spark: SparkSession, paths: list[str]) -> int:
    """How many (file, block) splits a scan of ``paths`` has at most, from the files' sizes (metadata, no scan)."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    most = 0
    for path in paths:
        p = hadoop.Path(path)
        fs = p.getFileSystem(conf)
        for status in fs.globStatus(p) or []:
            summary = fs.getContentSummary(status.getPath())
            most += summary.getFileCount() + summary.getLength() // LEAST_BLOCK_BYTES
    return most


def header_names(line: str) -> list[str]:
    """Column names of a header line. Of equal names the last has the values, as in the
    reference's reader; the others, and empty names, get a name of their own."""
    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
    last = {name: i for i, name in enumerate(names)}
    return [name if name and last[name] == i else f"_column_{i}" for i, name in enumerate(names)]


def with_line_no(rows: DataFrame, blocks_at_most: int | None = None) -> DataFrame:
    """0-based row number within each file, in file order.

    ``blocks_at_most`` bounds the number of (file, block) splits; under the broadcast
    limit the rows stay where they were read. A shuffle by block would bring each
    block, some 100 MB of text, to one task."""
    scanned = rows.select("*", F.col("_metadata.file_path").alias("_file"),
                          F.col("_metadata.file_block_start").alias("_block"),
                          F.monotonically_increasing_id().alias("_scan_id"))
    blocks = (scanned.groupBy("_file", "_block")
              .agg(F.min("_scan_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    numbered = scanned.join(maybe_broadcast(blocks, blocks_at_most, BLOCK_ROW_BYTES), ["_file", "_block"])
    return numbered.withColumn(
        "line_no", (F.col("_before") + F.col("_scan_id") - F.col("_first")).cast("long")
    ).drop("_block", "_scan_id", "_first", "_n", "_before").withColumnRenamed("_file", "file")


def scan_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, encoding, header): UTF-8 when the file's bytes decode as UTF-8, else latin-1 (S2),
    and its first line that isn't blank (null for a file without any).

    The text source keeps each line's raw bytes; one pass checks them in parallel, line by
    line, and one row per file comes back."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    bad = F.max((~F.is_valid_utf8("value")).cast("int"))
    first = F.min(F.when(F.trim("value") != "", F.struct("place", "value"))).getField("value")
    return (lines.groupBy("file").agg(bad.alias("_bad"), first.alias("header"))
            .select("file", F.when(F.col("_bad") == 1, F.lit(LATIN_1)).otherwise(F.lit(UTF_8)).alias("encoding"),
                    F.make_valid_utf8("header").alias("header")))


def detect_encoding(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, encoding) of every file."""
    return scan_files(spark, path).select("file", "encoding")


def read_order_lines_any_encoding(spark: SparkSession, paths: list[str],
                                  multiline: bool = True) -> DataFrame:
    """S2 + S1: each file by its own encoding and its own header's names, one union.

    Files of one encoding and header are read together. ``_missing`` names the required columns
    that the row's file lacks, else null. The driver receives one row per file - bounded by the
    number of files, not their size. A header is one line: names hold no line breaks."""
    groups: dict[tuple, list[str]] = {}
    for row in scan_files(spark, paths).collect():
        if row.header is not None:
            groups.setdefault((row.encoding, tuple(header_names(row.header))), []).append(row.file)
    parts = []
    for (encoding, header), files in sorted(groups.items()):
        lacking = ", ".join(c for c in REQUIRED if c not in header) or None
        part = read_order_lines(spark, files, encoding, multiline, list(header))
        for c in REQUIRED:
            if c not in header:
                part = part.withColumn(c, F.lit(None).cast("string"))
        parts.append(part.withColumn("_missing", F.lit(lacking).cast("string")))
    if not parts:
        names = [*REQUIRED, CORRUPT, "file", "_missing"]
        return spark.createDataFrame([], T.StructType([
            *[T.StructField(c, T.StringType()) for c in names], T.StructField("line_no", T.LongType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# Header names, fixed by the reference's reader.
EXPORT_HEADER = {
    "Order ID": "order_id", "Order Date": "order_date", "Ship Mode": "ship_mode",
    "Customer Name": "customer_name", "State": "state", "Region": "region",
    "Category": "category", "Product Name": "product_name", "Sales": "sales_amount",
    "Quantity": "quantity", "Profit": "profit_amount",
}


def write_order_lines(sales: DataFrame, path: str, encoding: str = LATIN_1) -> None:
    """Order lines as the reference's CSV (M/d/yyyy dates, header row), one
    file per task; each file numbers its lines from 0 when read back."""
    out = sales.select(*[
        (F.date_format(src, "M/d/yyyy") if src == "order_date" else F.col(src).cast("string"))
        .alias(name) for name, src in EXPORT_HEADER.items()])
    (out.write.mode("overwrite").option("header", True).option("encoding", encoding)
     .option("quote", '"').option("escape", '"').csv(path))


__all__ = ["read_order_lines", "read_order_lines_any_encoding", "detect_encoding", "scan_files",
           "with_line_no", "write_order_lines", "REQUIRED", "OPTIONAL"]
