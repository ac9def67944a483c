"""Distributed dense numbering equals row_number(), hot keys included."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from shopfloor.functions import keys
from shopfloor.functions.keys import dense_keys, number_rows, numbered_view, partition_offsets


def test_number_rows_matches_row_number_with_hot_key(spark, storage):
    # one key holds 40% of the rows; ties broken by the second column
    rows = [(1 if i % 5 < 2 else i, i % 7, f"v{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b long, c string")
    got, total = number_rows(df, ["a", "b", "c"], "n", storage, "t1", num_partitions=8)
    want = df.withColumn("n", F.row_number().over(Window.orderBy("a", "b", "c")) - 1)
    assert total == 5000
    assert sorted(got.select("a", "b", "c", "n").collect()) == sorted(want.collect())


def test_number_rows_start_and_nulls_first(spark, storage):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,)], "a long")
    got, _ = number_rows(df, ["a"], "n", storage, "t2", start=10)
    assert [(r.a, r.n) for r in got.orderBy("n").collect()] == [
        (None, 10), (1, 11), (2, 12), (3, 13)]


def test_number_rows_empty(spark, storage):
    df = spark.createDataFrame([], "a long")
    got, total = number_rows(df, ["a"], "n", storage, "t3")
    assert total == 0 and got.count() == 0


def test_dense_keys_are_one_based_in_natural_order(spark, storage):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("a", "x")], "n string, c string")
    got, total = dense_keys(df, ["n", "c"], "k", storage, "t4")
    assert total == 3
    assert [tuple(r) for r in got.orderBy("k").collect()] == [
        (1, "a", "x"), (2, "a", "y"), (3, "b", "x")]


def test_number_rows_then_keeps_every_row(spark, storage):
    df = spark.createDataFrame([(i,) for i in range(100)], "a long")
    got, total = number_rows(df, ["a"], "n", storage, "t5",
                             then=lambda d: d.withColumn("twice", F.col("a") * 2))
    assert total == 100
    assert got.where(F.col("n") != F.col("a")).count() == 0


def test_dense_keys_type_does_not_depend_on_size(spark, storage):
    df = spark.createDataFrame([("a",), ("b",)], "n string")
    small, _ = dense_keys(df, ["n"], "k", storage, "t6", known_rows=2)
    large, _ = dense_keys(df, ["n"], "k", storage, "t7")
    assert small.schema["k"].dataType == large.schema["k"].dataType
    assert sorted(small.collect()) == sorted(large.collect())


def test_dense_keys_of_a_known_count_use_several_tasks(spark, storage, monkeypatch):
    monkeypatch.setattr(keys, "ROWS_PER_TASK", 100)
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS a")
    got, total = dense_keys(df, ["a"], "k", storage, "t8", known_rows=1000)
    assert total == 1000
    assert got.where("k <> a + 1").count() == 0
    assert storage.read("stage", "t8-offsets").count() > 1


def test_offsets_of_many_partitions_are_summed_in_two_levels(spark):
    # partition p holds p % 5 rows: gaps where p is a multiple of five, several blocks of 64
    rows = [((p << 33) + i,) for p in range(50_000) for i in range(p % 5)]
    staged = spark.createDataFrame(rows, "_row_id long")
    want, running = [], 0
    for p in range(50_000):
        if p % 5:
            want.append((p, running, p % 5))
        running += p % 5
    got = partition_offsets(staged, block=64).orderBy("_partition").collect()
    assert [tuple(r) for r in got] == want


def test_numbers_are_opened_again_without_a_count(spark, storage):
    df = spark.range(500).selectExpr("id % 9 AS a", "id AS b")
    first, total = number_rows(df, ["a", "b"], "n", storage, "t9", num_partitions=7)
    again, total_again = numbered_view(storage, "t9", "n")
    assert total == total_again == 500
    assert sorted(first.collect()) == sorted(again.collect())
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan and "SinglePartition" not in plan


def test_plan_does_not_grow_with_the_partitions(spark, storage):
    def plan(n):
        df, _ = number_rows(spark.range(5000), ["id"], "n", storage, f"t10-{n}", num_partitions=n)
        return len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(2) - plan(300)) < 40


def test_partitions_follow_the_input_not_only_the_setting(spark):
    from shopfloor.functions.joins import INITIAL_PARTITIONS, partitions_for, size_shuffles
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(INITIAL_PARTITIONS, None)
    try:
        size_shuffles(spark, 1 << 30)
        assert spark.conf.get(INITIAL_PARTITIONS) == "128" and partitions_for(spark, 1 << 31) == 256
        # Sized anew for each input, down to the session's own number.
        size_shuffles(spark, 1)
        assert partitions_for(spark, 1) == floor
    finally:
        spark.conf.unset(INITIAL_PARTITIONS) if before is None else spark.conf.set(INITIAL_PARTITIONS, before)
