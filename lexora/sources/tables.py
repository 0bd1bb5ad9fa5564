"""Reading tables, and the columns under which operators see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.functions.text import spelling

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; Spark prunes its columns and pushes filters down to it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32, **options: str) -> DataFrame:
    """A table of a live database, read in parallel ranges of a key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.options(**options).load()


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as observations: a page's key is the entity, the observing customer's region the
    locale, its nation the medium, the event type the spelling. The medium's trust follows its key."""
    events, customer, nation = (table(spark, sf_dir, t) for t in ("events", "customer", "nation"))
    media = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("user_id"), F.col("n_name").alias("domain"), (F.col("n_nationkey") % 8).cast("long").alias("parent"), F.col("n_regionkey").cast("string").alias("locale"), (F.lit(0.5) + (F.col("n_nationkey") % 5) / 10).alias("trust")
    )
    entity = F.get_json_object("props", "$.k").cast("long")
    return events.join(media, "user_id", "left").select(
        "event_id", entity.alias("entity"), F.coalesce("locale", F.lit("-")).alias("locale"), F.col("event_type").alias("spelling"), spelling(F.col("event_type")).alias("norm"),
        "domain", "parent", F.col("user_id").alias("page"), "trust", F.when(F.col("value") < 400, F.least(F.lit(1.0), F.col("value") / 50)).alias("confidence"), F.col("ts").alias("observed_at"),
    )
