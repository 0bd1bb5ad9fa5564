"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows handed to a Python worker at once: documents can be long, so a batch is
#: bounded by rows and by bytes.
ARROW_ROWS = 512
ARROW_BYTES = 16 * 1024 * 1024


def build_session(app: str = "lexora", cores: str = "*", shuffle: int | None = None) -> SparkSession:
    """A session for local use: UTC, AQE on, shuffle partitions left to AQE unless given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and the session runs on one
    machine (tests) a temporary folder is made and registered with the context; on a cluster an unset
    folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexora-checkpoint-"))
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once, as Parquet, to the shared folder and read back from there.

    What follows is a plain scan of a finished table: it survives lost executors, prunes columns, and
    its size is known, whatever the plan that made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote, once what was made of them is written; others are left alone."""
    for table in tables:
        path = getattr(table, "cut_path", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches that carry whole documents to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
