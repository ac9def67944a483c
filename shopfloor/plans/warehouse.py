"""The warehouse job: staging, then the three layouts, written once and reused.

``Warehouse.open(spark, sf_dir)`` fixes a folder named by a fingerprint of
the input files (size, modification time) and of this package's code. Each
layout is built on first use, written as parquet with a done-marker, and
read from the files afterwards, in this process or any later one that sees
the same shared folder. A build that died half way has no marker and is
redone from the start.
"""

from __future__ import annotations

import functools
import hashlib
import json
import pathlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import clean_columns, skipped_report
from ..functions.columns import calendar_cols, sale_id
from ..functions.joins import file_bytes, partitions_for, size_shuffles
from ..functions.keys import number_rows, numbered_view
from ..operators import graph as graph_ops
from ..operators import nested as nested_ops
from ..operators import star as star_ops
from ..session import apply_defaults, shared_dir
from ..sources.csv_orders import read_order_lines_any_encoding
from ..sources.tables import (LINE_ORDER, SALES_COLUMNS, attach_orders, lineitem_lines,
                              table_path)
from .storage import LARGE_CODEC, Storage

_PACKAGE = pathlib.Path(__file__).resolve().parents[1]
_SALES_INPUTS = ("region", "nation", "customer", "orders", "part", "lineitem")


@functools.lru_cache(maxsize=1)
def _code_hash() -> str:
    """Hash of this package's source, once per process."""
    h = hashlib.sha1()
    for path in sorted(_PACKAGE.rglob("*.py")):
        h.update(path.read_bytes())
    return h.hexdigest()[:12]


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    h = hashlib.sha1(_code_hash().encode())
    for name in _SALES_INPUTS:
        p = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        fs = p.getFileSystem(conf)
        # Every file below, so that one added in a nested folder shows.
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            st = files.next()
            found.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
        h.update("\n".join(sorted(found)).encode())
    return h.hexdigest()[:16]


def sales_view(numbered: DataFrame) -> DataFrame:
    """Order lines as the layouts read them: staging columns, sale id, calendar."""
    s = numbered.where("_matched").select(*SALES_COLUMNS).withColumn(
        "sales_fact_id", sale_id("order_id", "line_no"))
    return calendar_cols(s, "order_date")


class Warehouse:
    _open: dict[tuple[int, str], "Warehouse"] = {}
    # Folder for warehouses opened without an explicit root (None: a
    # ``shopfloor-warehouse`` folder in the shared checkpoint dir).
    default_root: str | None = None

    def __init__(self, spark: SparkSession, sf_dir: str, storage: Storage,
                 parent: "Warehouse | None" = None, condition=None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.storage = storage
        self.parent = parent
        self.condition = condition
        self.memo: dict[str, object] = {}
        self._slices: dict[str, Warehouse] = {}
        self._sales: DataFrame | None = None
        self._star: star_ops.Star | None = None
        self._nested: DataFrame | None = None
        self._graph: graph_ops.Graph | None = None

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str, root: str | None = None) -> "Warehouse":
        apply_defaults(spark)
        base = root or cls.default_root or f"{shared_dir(spark)}/shopfloor-warehouse"
        size_shuffles(spark, file_bytes(spark, *(table_path(sf_dir, t) for t in ("orders", "lineitem"))))
        folder = f"{base}/{_fingerprint(spark, sf_dir)}"
        key = (id(spark), folder)
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir, Storage(spark, folder))
        return cls._open[key]

    # -- staging ---------------------------------------------------------------
    def slice(self, name: str, condition) -> "Warehouse":
        """The same layouts over the order lines that satisfy ``condition``
        (a Column), kept in a subfolder; line numbers stay global."""
        if name not in self._slices:
            self._slices[name] = Warehouse(self.spark, self.sf_dir,
                                           Storage(self.spark, self.storage.path("slices", name)),
                                           parent=self, condition=condition)
        return self._slices[name]

    # Staging from the driver tables numbers every line once, so sale ids are
    # unique; the graph load can skip its first-wins dedup of Sale nodes.
    unique_sale_ids = True

    def _graph_input(self) -> DataFrame:
        return self.sales()

    def _staging_bytes(self) -> int:
        """On-disk size of the staged order lines (a slice uses its parent's)."""
        root = self
        while root.parent is not None:
            root = root.parent
        root.sales()
        return file_bytes(self.spark, root.storage.path("stage", "sales"))

    def sales(self) -> DataFrame:
        """Typed order lines with a global 0-based ``line_no``."""
        if self._sales is None and self.parent is not None:
            self._sales = self.parent.sales().where(self.condition)
        if self._sales is None:
            st = self.storage
            if st.is_done("stage", "sales"):
                numbered, _ = numbered_view(st, "sales", "line_no")
            else:
                lines = lineitem_lines(self.spark, self.sf_dir)
                size = file_bytes(self.spark, table_path(self.sf_dir, "lineitem"))
                numbered, _ = number_rows(
                    lines, LINE_ORDER, "line_no", st, "sales",
                    num_partitions=partitions_for(self.spark, size),
                    then=lambda df: attach_orders(df, self.spark, self.sf_dir), codec=LARGE_CODEC)
                st.mark_done("stage", "sales")
            self._sales = sales_view(numbered)
        return self._sales

    # -- layouts ---------------------------------------------------------------
    def star(self) -> star_ops.Star:
        if self._star is None:
            st = self.storage
            if st.is_done("star"):
                rows = json.loads(st.read_text("star", "_ROWS"))
                tables = {n: st.read("star", n) for n in (*star_ops.DIMENSIONS, "fact_sales")}
                self._star = star_ops.Star(**tables, rows=rows)
            else:
                self._star = star_ops.build_star(self.sales(), st, "star")
                st.write_text(json.dumps(self._star.rows), "star", "_ROWS")
                st.mark_done("star")
        return self._star

    def nested(self) -> DataFrame:
        if self._nested is None:
            st = self.storage
            if st.is_done("nested"):
                self._nested = st.read("nested", "sales")
            else:
                self._nested = nested_ops.build_nested(self.sales(), st, "nested")
                st.mark_done("nested")
        return self._nested

    def graph(self) -> graph_ops.Graph:
        if self._graph is None:
            st = self.storage
            if st.is_done("graph"):
                rows = json.loads(st.read_text("graph", "_ROWS"))
                self._graph = graph_ops.open_graph(st, "graph", rows)
            else:
                self._graph = graph_ops.build_graph(
                    self._graph_input(), st, "graph", unique_sales=self.unique_sale_ids,
                    buckets=partitions_for(self.spark, self._staging_bytes()))
                st.write_text(json.dumps(self._graph.rows), "graph", "_ROWS")
                st.mark_done("graph")
        return self._graph


def open_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse.open(spark, sf_dir)


class CsvWarehouse(Warehouse):
    """The same layouts loaded from order-line CSV files, as the reference's
    loaders do: rows cleaned by its rules, rejected rows kept in a report,
    ``line_no`` counted per file (so the sale id is ``order-line`` of that
    file), and the star's integer fact ids numbered over (file, line)."""

    unique_sale_ids = False  # the same order-line id may occur in two files

    def __init__(self, spark: SparkSession, paths: list[str], storage: Storage,
                 multiline: bool = True):
        super().__init__(spark, None, storage)
        self.paths = paths
        self.multiline = multiline

    @classmethod
    def open_csv(cls, spark: SparkSession, paths: list[str], root: str | None = None,
                 multiline: bool = True) -> "CsvWarehouse":
        apply_defaults(spark)
        base = root or f"{shared_dir(spark)}/shopfloor-warehouse"
        h = hashlib.sha1(_code_hash().encode())
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(conf)
            summary = fs.getContentSummary(p)
            h.update(f"{fs.makeQualified(p).toString()}|{summary.getLength()}|"
                     f"{summary.getFileCount()}|{fs.getFileStatus(p).getModificationTime()}"
                     .encode())
        return cls(spark, list(paths), Storage(spark, f"{base}/csv-{h.hexdigest()[:16]}"),
                   multiline)

    def sales(self) -> DataFrame:
        if self._sales is None:
            st = self.storage
            if st.is_done("stage", "sales"):
                numbered, _ = numbered_view(st, "sales", "fact_seq", start=1)
            else:
                raw = read_order_lines_any_encoding(self.spark, self.paths, self.multiline)
                checked = clean_columns(raw)
                st.write(checked.where(F.col("reject_reason").isNotNull())
                         .select("file", "line_no", "reject_reason"), "stage", "skipped")
                good = (checked.where(F.col("reject_reason").isNull())
                        .withColumn("line_no", F.col("line_no").cast("long"))
                        .select("file", *SALES_COLUMNS))
                numbered, _ = number_rows(good, ["file", "line_no"], "fact_seq", st, "sales",
                                          start=1)
                st.mark_done("stage", "sales")
            view = numbered.withColumn("sales_fact_id", sale_id("order_id", "line_no"))
            self._sales = calendar_cols(view, "order_date")
        return self._sales

    def skipped(self) -> DataFrame:
        """Rejected rows as (file, line = index + 2, reason)."""
        self.sales()
        return skipped_report(self.storage.read("stage", "skipped"))

    def _graph_input(self) -> DataFrame:
        # first-wins across files follows load order: file, then line
        return self.sales().withColumn("line_no", F.col("fact_seq"))


__all__ = ["Warehouse", "open_warehouse", "sales_view"]
