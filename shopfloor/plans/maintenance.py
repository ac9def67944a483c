"""Layouts stored as month-partitioned tables, and deletes that persist in them.

Each table is one parquet folder partitioned by ``_part``: the month of a fact, a sale
record, a sale node or a sale edge, and one part ``all`` for the small tables. A delete

1. finds the keys to go and their parts, by a semi-join that reads the keys and ``_part`` only (one row
   per part comes to the driver), and writes them aside;
2. writes what is left of those parts to a staged folder, laid out as the table is. A few keys are
   broadcast, and rows stay in the order of the files they are read from; else rows and keys meet by part
   and a hash of the key, so that the shuffle that joins them also brings each part's rows together;
3. puts exactly those parts' folders in the place of the old ones and removes the folders of parts that
   are left without rows.

The ten summaries of the nested records and the graph (M7, M8) are kept with them as sums
per part: one table per nested summary and one per sale edge, partitioned like the rows. A
delete sums the rows that stay in the touched parts again and replaces these parts' sums
before it replaces the rows, so a delete that died in between finds the same parts when it
is run again. The sums are taken from the staged rows: those of a sale edge carry their sale's
measures, which the join that drops the edges of deleted sales brings along, so each edge table
is shuffled by part and sale once, and the sales' state is bucketed once for all five. Reading a summary adds up
the parts and never reads a sale; a group without rows is gone.

Other parts keep their files. Rows are matched by key, so a delete that died is run
again: parts already replaced have nothing left to go. Null keys match nothing, as in
SQL. An emptied table stays readable: it always holds one file without rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import joins
from ..functions.joins import PARQUET_EXPANSION, file_bytes, partitions_for
from ..operators.customers import parse_sale_ids
from ..operators.graph import EDGE_ENDS, NODE_KEYS, SALE_EDGE_DST, Graph
from ..operators.star import DIMENSIONS, Star
from ..operators.summaries import GRAPH_BUILDERS, finish_nested, NESTED_SUMMARIES, summarises_edges, sums, sums_of_sums
from ..session import settings
from .storage import LARGE_CODEC, Storage

PART, SLOT = "_part", "_slot"
SUMS = ["r", "p", "q", "n"]
# Tables with a row per order line.
LINE_TABLES = ("fact_sales", "nested", "Sale", *SALE_EDGE_DST)
# Writes that go on at once: one fills the cores that the last tasks of another leave idle.
WRITERS = 3
# Groups of part and slot for each task that they are dealt to: enough to even out their sizes.
GROUPS_PER_TASK = 6
# Rows dealt by part and slot meet on these and their key; Spark would deal them again by all three.
BY_SLOT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
# The sale edge that each graph summary sums over first.
SUMMARY_EDGES = {"MonthlyRevenue": "ON_DATE", "CategoryPerformance": "OF_PRODUCT", "StateProfit": "SHIPPED_TO",
                 "ShipModeProfitability": "USES_SHIP_MODE", "CustomerRanking": "BY_CUSTOMER"}


def _label(part: Column | None = None) -> Column:
    """The name of a row's part. The letter keeps it from being read back as a number or date."""
    return F.lit("all") if part is None else F.concat(F.lit("m"), F.coalesce(part, F.lit("")))


def _by_part(rows: DataFrame) -> DataFrame:
    """Rows that meet by part first, to be written to few files; AQE splits the large ones again."""
    return rows.hint("rebalance", PART)


def _each(spark: SparkSession, step: Callable, items: Iterable) -> None:
    """``step`` of each item, some at once."""
    with ThreadPoolExecutor(WRITERS) as pool:
        list(pool.map(inheritable_thread_target(spark)(step), items))


class StoredLayouts:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.storage = spark, root, Storage(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, star: Star, nested: DataFrame, graph: Graph) -> "StoredLayouts":
        """Write the three layouts under ``root``."""
        out = cls(spark, root)
        month = graph.edges["ON_DATE"].groupBy("src").agg(F.date_format(F.min("dst"), "yyyy-MM").alias("_month"))
        # Over the graph as it is given: where it is bucketed on the sale, neither side of these joins moves.
        edges = {e: graph.edges[e].join(month, "src", "left").withColumn(PART, _label(F.col("_month"))) for e in SALE_EDGE_DST}
        sale = graph.nodes["Sale"].join(month.withColumnRenamed("src", "sales_fact_id"), "sales_fact_id", "left")
        tables = {"nested": nested.withColumn(PART, _label(F.concat_ws("-", "date.year", "date.month"))),
                  "fact_sales": star.fact_sales.withColumn(PART, _label(F.col("date_key").cast("string"))),
                  "Sale": sale.withColumn(PART, _label(F.col("_month"))), **edges}
        small = {**{name: getattr(star, name) for name in DIMENSIONS}, **graph.nodes, **graph.edges}
        tables.update((name, table.withColumn(PART, _label())) for name, table in small.items() if name not in tables)
        shapes = {**small, "nested": nested, "fact_sales": star.fact_sales}
        _each(spark, lambda name: out._store(name, tables[name].select(*shapes[name].columns, PART)), tables)
        fresh = {**out._nested_sums(out._table("nested")), **out._edge_sums(edges, graph.nodes["Sale"])}
        _each(spark, lambda name: out._store(name, fresh[name]), fresh)
        return out

    def _store(self, name: str, rows: DataFrame) -> None:
        path = self.storage.path(name)
        self._write(name, _by_part(rows), path)
        rows.limit(0).coalesce(1).drop(PART).write.parquet(f"{path}/{PART}=none")

    @staticmethod
    def _write(name: str, rows: DataFrame, path: str, by_part: bool = True) -> None:
        writer = rows.write.option("compression", LARGE_CODEC) if name in LINE_TABLES else rows.write
        (writer.partitionBy(PART) if by_part else writer).parquet(path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.storage.path(name))

    # -- reading -----------------------------------------------------------
    def star(self) -> Star:
        tables = {name: self._table(name).drop(PART) for name in (*DIMENSIONS, "fact_sales")}
        return Star(**tables, rows={})

    def nested(self) -> DataFrame:
        return self._table("nested").drop(PART)

    def graph(self) -> Graph:
        return Graph({n: self._table(n).drop(PART) for n in NODE_KEYS}, {n: self._table(n).drop(PART) for n in EDGE_ENDS}, {})

    # -- deleting ----------------------------------------------------------
    def _kept(self, frame: DataFrame) -> DataFrame:
        """``frame`` written aside: keys must outlive the tables that they come from."""
        path = self.storage.path("_staged", uuid.uuid4().hex)
        frame.write.parquet(path)
        return self.spark.read.parquet(path)

    def _touched(self, name: str, keys: DataFrame, columns: list[str]) -> tuple[tuple[str, str], dict[str, int]]:
        """The folder of the keys that the table holds, as ``_found``, ``_key0`` .. (part and ``columns``), and the rows that
        bear them by part."""
        keys = keys.toDF(*(f"_key{i}" for i in range(len(columns)))).where(
            reduce(lambda a, b: a & b, (F.col(f"_key{i}").isNotNull() for i in range(len(columns))))).distinct()
        on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_key{i}") for i, c in enumerate(columns)))
        held = self._table(name).select(F.col(PART).alias("_found"), *(F.col(c) for c in columns)) if all(
            "." not in c for c in columns) else self._table(name).withColumn("_found", F.col(PART))
        rows = held.join(keys, on, "left_semi").groupBy("_found", *(F.col(c).alias(f"_key{i}") for i, c in enumerate(columns)))
        folder = ("_staged", uuid.uuid4().hex)
        rows.agg(F.count(F.lit(1)).alias("_rows")).write.parquet(self.storage.path(*folder))
        went = self.storage.read(*folder).groupBy("_found").agg(F.sum("_rows")).collect()
        return folder, {r[0]: r[1] for r in went}

    def _dealt(self, rows: DataFrame, part: str, keys: list[str], tasks: int, parts: int) -> DataFrame:
        """``rows`` dealt to ``tasks`` by part and, in each of ``parts``, by slots of a hash of ``keys``."""
        slots = -(-GROUPS_PER_TASK * tasks // parts)
        return rows.withColumn(SLOT, F.pmod(F.hash(*keys), F.lit(slots))).repartition(tasks, part, SLOT)

    def _tasks(self, name: str) -> int:
        return partitions_for(self.spark, file_bytes(self.spark, self.storage.path(name)))

    def _without(self, name: str, folder: tuple[str, str], columns: list[str], touched: list[str]) -> DataFrame:
        """The rows of the parts ``touched`` that bear none of the keys in ``folder``, together by part."""
        rows, found = self._table(name).where(F.col(PART).isin(touched)), self.storage.read(*folder).drop("_rows")
        names = [f"_key{i}" for i in range(len(columns))]
        on = reduce(lambda a, b: a & b, (F.col(c) == F.col(k) for c, k in zip([PART, *columns], ["_found", *names])))
        if file_bytes(self.spark, self.storage.path(*folder)) * PARQUET_EXPANSION <= joins.BROADCAST_MAX_BYTES:
            return rows.join(F.broadcast(found), on, "left_anti")
        tasks = self._tasks(name)
        found = self._dealt(found, "_found", names, tasks, len(touched)).withColumnRenamed(SLOT, "_found_slot")
        dealt = self._dealt(rows, PART, columns, tasks, len(touched))
        # Not an anti join, which Spark would move below the dealing. The keys are distinct.
        met = dealt.join(found, (F.col(SLOT) == F.col("_found_slot")) & on, "left")
        return met.where("_found IS NULL").select(*rows.columns)

    def _replace(self, name: str, rows: DataFrame, touched: list[str], then: Callable | None = None) -> None:
        """Put ``rows`` in the place of the parts ``touched``; ``then`` sees them, written aside, before. Columns that the
        table lacks are for ``then`` only."""
        columns, staged = self._table(name).columns, ("_staged", uuid.uuid4().hex)
        whole = set(rows.columns) == set(columns)
        rows = rows.select(*columns) if whole else rows
        self._write(name, rows, self.storage.path(*staged), by_part=whole)
        written = self.spark.read.schema(rows.schema).parquet(self.storage.path(*staged))
        if then is not None:
            then(written, touched)
        if not whole:
            plain, staged = staged, ("_staged", uuid.uuid4().hex)
            self._write(name, written.select(*columns), self.storage.path(*staged))
            self.storage.delete(*plain)
        left = set(self.storage.folders(*staged))
        for part in (f"{PART}={t}" for t in touched):
            if part in left:
                self.storage.move((*staged, part), (name, part))
            else:
                self.storage.delete(name, part)
        self.storage.delete(*staged)

    def _delete(self, name: str, keys: DataFrame, columns: list[str], then: Callable | None = None) -> int:
        """Remove the rows whose ``columns`` equal a row of ``keys``; how many went."""
        folder, went = self._touched(name, keys, columns)
        if went:
            with settings(self.spark, BY_SLOT):
                self._replace(name, self._without(name, folder, columns, list(went)), list(went), then)
        self.storage.delete(*folder)
        return sum(went.values())

    # -- summaries ---------------------------------------------------------
    def _nested_sums(self, records: DataFrame) -> dict[str, DataFrame]:
        """Table name -> sums of ``records`` per part and group of each nested summary."""
        return {f"sums_{name}": records.groupBy(PART, *(F.col(c).alias(k) for k, c in keys.items())).agg(
            *sums(), F.min("date.month_name").alias("month_name")) for name, keys in NESTED_SUMMARIES.items()}

    @staticmethod
    def _edge_sums(edges: dict[str, DataFrame], sale: DataFrame) -> dict[str, DataFrame]:
        """Table name -> sums per part and end of each sale edge."""
        return {f"sums_{name}": edges[name].join(sale, edges[name].src == sale.sales_fact_id).groupBy(PART, "dst").agg(*sums())
                for name in SUMMARY_EDGES.values()}

    def _refresh_nested(self, left: DataFrame, touched: list[str]) -> None:
        _each(self.spark, lambda table: self._replace(table[0], _by_part(table[1]), touched), self._nested_sums(left).items())

    def nested_summaries(self) -> dict[str, DataFrame]:
        """M7: the five summaries of the records that are stored."""
        return {name: finish_nested(name, self._table(f"sums_{name}").groupBy(*keys).agg(
            *sums_of_sums(), F.min("month_name").alias("month_name"))) for name, keys in NESTED_SUMMARIES.items()}

    def graph_summaries(self) -> dict[str, DataFrame]:
        """M7: the five summaries of the sales that the stored graph holds; later hops go over its small tables."""
        graph = self.graph()
        return {label: build(graph, self._table(f"sums_{SUMMARY_EDGES[label]}").groupBy("dst").agg(*sums_of_sums()))
                for label, (build, _, _) in GRAPH_BUILDERS.items()}

    def summarises(self) -> dict[str, DataFrame]:
        """M8: the SUMMARISES edges of each graph summary; src and dst are the shared key."""
        return {label: summarises_edges(table, GRAPH_BUILDERS[label][1]) for label, table in self.graph_summaries().items()}

    # -- counting ----------------------------------------------------------
    def _counts(self, counts: dict[tuple[str, str], int]) -> DataFrame:
        return self.spark.createDataFrame([(*k, v) for k, v in counts.items()], "layout string, metric string, value long")

    def _sale_state(self, folder: tuple[str, str], touched: list[str], tasks: int, *staged: str) -> DataFrame:
        """Part, slot, sale, whether it goes, and the sums of its node; bucketed as each edge table is dealt to join it."""
        per_sale = (self._table("Sale").where(F.col(PART).isin(touched)).withColumnRenamed("sales_fact_id", "_sale")
                    .withColumnRenamed(PART, "_held"))
        per_sale = self._dealt(per_sale, "_held", ["_sale"], tasks, len(touched)).withColumnRenamed(SLOT, "_place")
        per_sale = per_sale.groupBy("_held", "_place", "_sale").agg(*sums())
        went = self._dealt(self.storage.read(*folder), "_found", ["_key0"], tasks, len(touched))
        state = per_sale.join(went, (F.col("_held") == F.col("_found")) & (F.col("_place") == F.col(SLOT))
                              & (F.col("_sale") == F.col("_key0")), "left")
        return self.storage.write_bucketed(
            state.select("_held", "_place", "_sale", F.col("_found").isNotNull().alias("_gone"), *SUMS),
            "_sale", tasks, *staged, partitioned=True, within=("_held", "_place"))

    def _refresh_edge_sums(self, name: str, left: DataFrame, touched: list[str]) -> None:
        table = f"sums_{name}"
        fresh = left.where("n IS NOT NULL").groupBy(PART, "dst").agg(*sums_of_sums())
        kinds = {f.name: f.dataType for f in self._table(table).schema}
        self._replace(table, _by_part(fresh.select(*(F.col(c).cast(kinds[c]).alias(c) for c in fresh.columns))), touched)

    def _delete_sales(self, ids: DataFrame) -> int:
        """DETACH DELETE of sale nodes: sums and edges go first, so a delete that died still finds the nodes. The
        edges of a sale are in its node's part."""
        folder, went = self._touched("Sale", ids, ["sales_fact_id"])
        if went:
            touched, tasks, staged = list(went), self._tasks("Sale"), ("_staged", uuid.uuid4().hex)
            with settings(self.spark, BY_SLOT):
                state = self._sale_state(folder, touched, tasks, *staged)
                _each(self.spark, lambda name: self._replace(name, self._edges_left(name, state, touched, tasks), touched,
                                                 partial(self._refresh_edge_sums, name)), SALE_EDGE_DST)
                self._replace("Sale", self._without("Sale", folder, ["sales_fact_id"], touched), touched)
            self.storage.drop_bucketed(*staged)
        self.storage.delete(*folder)
        return sum(went.values())

    def _edges_left(self, name: str, state: DataFrame, touched: list[str], tasks: int) -> DataFrame:
        """The edges of the sales that stay, with the sums of their nodes."""
        edges = self._table(name).where(F.col(PART).isin(touched))
        dealt = self._dealt(edges, PART, ["src"], tasks, len(touched))
        rows = dealt.join(state, (F.col(PART) == F.col("_held")) & (F.col(SLOT) == F.col("_place"))
                          & (F.col("src") == F.col("_sale")), "left")
        return rows.where(~F.coalesce("_gone", F.lit(False))).select(*edges.columns, *SUMS)

    def delete_customers(self, names: DataFrame) -> DataFrame:
        """Customers by name with their lines, from all three layouts; (layout, metric, value)."""
        names = self._kept(names.select("customer_name").where("customer_name IS NOT NULL").distinct())
        who = self._kept(self._table("dim_customer").join(names, "customer_name", "left_semi").select("customer_key"))
        held = self._table("Customer").join(names, "customer_name", "left_semi").select("customer_name")
        sales = self._kept(self._table("BY_CUSTOMER").join(held, F.col("dst") == F.col("customer_name"), "left_semi")
                           .select("src").distinct())
        return self._counts({
            ("star", "deleted_facts"): self._delete("fact_sales", who, ["customer_key"]),
            ("star", "deleted_customers"): self._delete("dim_customer", who, ["customer_key"]),
            ("nested", "deleted_count"): self._delete("nested", names, ["customer.customer_name"], self._refresh_nested),
            ("graph", "deleted_sales"): self._delete_sales(sales),
            ("graph", "deleted_customers"): self._delete("Customer", names, ["customer_name"])})

    def delete_lines(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sales by id from all three layouts; (layout, metric, value), and the ids that star can't parse."""
        parsed = self._kept(parse_sale_ids(ids.select("sales_fact_id").where("sales_fact_id IS NOT NULL").distinct()))
        keys = parsed.where("parsed").select("order_id", "line_no")
        every = parsed.select("sales_fact_id")
        counts = self._counts({
            ("star", "deleted_count"): self._delete("fact_sales", keys, ["order_id", "line_no"]),
            ("nested", "deleted_count"): self._delete("nested", every, ["sales_fact_id"], self._refresh_nested),
            ("graph", "deleted_count"): self._delete_sales(every)})
        return counts, parsed.where(~F.col("parsed")).select("sales_fact_id")

    def months(self) -> DataFrame:
        """layout, year, month, lines and revenue of every month that each stored layout still holds."""
        star, nested, graph = self.star(), self.nested(), self.graph()
        date = graph.edges["ON_DATE"].join(graph.nodes["Sale"], F.col("src") == F.col("sales_fact_id"))
        frames = {
            "star": star.fact_sales.join(star.dim_date.select("date_key", "year", "month"), "date_key"),
            "nested": nested.select(F.col("date.year").alias("year"), F.col("date.month").alias("month"), "sales_amount"),
            "graph": date.select(F.year("dst").alias("year"), F.month("dst").alias("month"), "sales_amount")}
        return reduce(DataFrame.unionByName, (
            f.groupBy("year", "month").agg(F.count(F.lit(1)).alias("lines"), F.sum("sales_amount").cast("double").alias("revenue"))
            .select(F.lit(layout).alias("layout"), F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"),
                    "lines", "revenue") for layout, f in frames.items()))
