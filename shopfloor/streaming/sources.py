"""Stream sources (S3-S6): query events, sales transactions, sale events.

Each reader returns a streaming DataFrame by default and the same rows as a
batch DataFrame with ``stream=False``, so one set of operators serves both
(the stream-equals-batch tests rely on it). File sources read every file
already present before new ones (``earliest``); the Kafka form takes the
topic and ``startingOffsets=earliest`` and needs the Kafka connector on the
classpath (not in this image).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import ARRIVED, CORRUPT_EVENT

QUERY_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("db_name", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("query_key", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("row_count", T.IntegerType()),
    T.StructField("elapsed_ms", T.DoubleType()),
    T.StructField("executed_at", T.StringType()),
])

# All fields as text: a number keeps its digits, and one that is no number is still there to be told of.
SALE_EVENT_SCHEMA = T.StructType([
    T.StructField("sales_fact_id", T.StringType()),
    T.StructField("order_id", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in (
        "line_no", "order_date", "year", "month", "month_name", "day", "ship_mode", "customer_id", "customer_name", "segment", "country", "city", "state",
        "postal_code", "region", "product_id", "category", "sub_category", "product_name",
        "sales_amount", "quantity", "discount", "profit_amount")],
])


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def kafka_values(spark: SparkSession, topic: str, servers: str) -> DataFrame:
    """S6 with a broker: the topic from its earliest offset, value as text."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest").load()
            .select(F.col("key").cast("string").alias("key"),
                    F.col("value").cast("string").alias("value"),
                    F.col("partition"), F.col("offset").alias("seq"),
                    F.col("timestamp").alias("event_time")))


def read_query_events(spark: SparkSession, path: str, stream: bool = True,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """JSON query events. A file keeps no record time, so the event's
    own ``executed_at`` (ISO, UTC) is its event time."""
    r = _reader(spark, stream).schema(QUERY_EVENT_SCHEMA)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.json(path)
    return df.withColumn("event_time", F.to_timestamp("executed_at"))


def parse_transaction_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """S3: ``cust_id,location,product,sale`` lines; blank and ``#`` lines skipped."""
    v = F.trim(F.col(value))
    kept = lines.where((v != "") & ~v.startswith("#"))
    parts = F.split(F.col(value), ",")
    return kept.select(
        *[c for c in lines.columns if c != value],
        F.trim(parts.getItem(0)).alias("cust_id"),
        F.trim(parts.getItem(1)).alias("location"),
        F.trim(parts.getItem(2)).alias("product"),
        F.trim(parts.getItem(3)).try_cast("double").alias("sale"),
    )


def read_sales_transactions(spark: SparkSession, path: str, stream: bool = True,
                            max_files_per_trigger: int | None = None) -> DataFrame:
    """S3 from text files; event time is the file's modification time (the
    record time a broker would stamp)."""
    r = _reader(spark, stream)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = r.text(path).select(
        "value", F.col("_metadata.file_modification_time").alias("event_time"))
    return parse_transaction_lines(lines)


def parse_sale_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to the 25 fields, as text (numbers keep 15 digits at least), and ``_corrupt``: the text itself where it is no
    JSON object (null for an event). The frame's other columns stay; blank lines are no record.
    ``ingest.normalize_events`` types the fields and gives each bad record its error."""
    schema = T.StructType([*SALE_EVENT_SCHEMA, T.StructField(CORRUPT_EVENT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_EVENT}
    others = [c for c in lines.columns if c != value]
    parsed = lines.where(F.trim(F.col(value)) != "").select(
        *others, F.col(value).alias("_text"), F.from_json(F.col(value), schema, options).alias("_event"))
    # Text that is JSON but no object gives a null struct or one without any field.
    none = F.coalesce(*[F.col(f"_event.{c}") for c in schema.names]).isNull()
    return parsed.select(*others, *[F.col(f"_event.{c}").alias(c) for c in SALE_EVENT_SCHEMA.names],
                         F.when(none, F.col("_text")).otherwise(F.col(f"_event.{CORRUPT_EVENT}")).alias(CORRUPT_EVENT))


def read_sale_events(spark: SparkSession, path: str, stream: bool = True,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """S5 from files of one JSON event a line, with the file's modification time
    (``_arrived``). ``ingest.normalize_events`` makes the arrival order of it and of the
    place in the file, batch by batch: a stream itself has no places."""
    r = _reader(spark, stream)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    arrived = F.unix_millis("_metadata.file_modification_time").alias(ARRIVED)
    return parse_sale_events(r.text(path).select("value", arrived))


def read_sale_topic(spark: SparkSession, topic: str, servers: str) -> DataFrame:
    """S5 from a topic. Events of one sale have one key, so the offset in their partition is
    their order (``seq``)."""
    return parse_sale_events(kafka_values(spark, topic, servers).select("value", "seq"))


# ---------------------------------------------------------------------------
# The driver's tables as the two streams (our mapping)
# ---------------------------------------------------------------------------

def query_events_from_table(events: DataFrame) -> DataFrame:
    """``events`` as query events: the event type names the database, an
    ``error`` event is a failed query, ``value`` is the elapsed time."""
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("db_name"),
        F.lit("predefined").alias("query_type"),
        F.col("props").alias("query_key"),
        (F.col("event_type") != "error").alias("success"),
        F.col("user_id").cast("int").alias("row_count"),
        F.col("value").alias("elapsed_ms"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("executed_at"),
        ts.alias("event_time"),
    )


def transactions_from_sales(sales: DataFrame) -> DataFrame:
    """Order lines as sales transactions: customer, state, product, amount;
    event time is the order date."""
    return sales.select(
        F.col("customer_name").alias("cust_id"),
        F.col("state").alias("location"),
        F.col("product_name").alias("product"),
        F.col("sales_amount").alias("sale"),
        F.col("order_date").cast("timestamp").alias("event_time"),
    )
