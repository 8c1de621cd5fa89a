"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``.

    Where the setting is absent it is the context's checkpoint folder, which a local session makes on
    its machine if there is none yet; on a cluster that would be a folder others can't see, an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    own = sc._jsc.sc().getCheckpointDir()
    if not found:
        if not own.isDefined() and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that all machines share")
        found = own.get() if own.isDefined() else f"file://{tempfile.mkdtemp(prefix='lamina-')}"
    if not own.isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def room(spark: SparkSession, kind: str = "table") -> str:
    """A new place in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/saved/{kind}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def saved(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """As ``cut``, for wide rows: a compressed table in the shared folder, removed when the session ends.

    ``group_rows`` bounds the rows of a row group. The writer looks at a group's size after every 100 rows only, and
    the reader decodes up to 4,096 rows of a group at once, so rows of megabytes need a bound.
    """
    spark = df.sparkSession
    path = room(spark)
    writer = df.write.option("compression", "zstd")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled_joins(spark: SparkSession) -> None:
    """Lets this session broadcast only the sides of joins that the code marks, not those that Spark estimates to be small.

    Estimates come from the size of the files and don't count the rows that an ``explode`` adds: a small
    table that is sent to the cells around its points would go through the driver whole.
    """
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that shuffles both sides, whatever size Spark estimates and whatever the session allows."""
    return df.hint("merge")


#: Rows of text in an Arrow batch; Spark's own default of 10,000 holds tens of megabytes of documents.
TEXT_ROWS = 3000


def text_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of text in this session, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


#: Bytes of an Arrow batch of large rows; a task holds Spark's own default of 64 MB in vectors that grow by doubling, and again in Python.
BATCH_BYTES = 8 << 20


def byte_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session, unless they have been set already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)
