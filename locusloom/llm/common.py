"""What the corpus operators share: reading tables, tables in the shared folder, and joins that
move no more text than they must."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a side that is too large to broadcast are first reduced to this many slots; the slot
#: table has at most this many longs, whatever the input, and so may be broadcast.
SLOTS = 1 << 18
#: Rows of one Arrow batch; texts of 100 kB then need 25 MB a batch.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that hold whole texts or blocks of vectors. Spark reads the setting when a plan runs, so it
    must stay in the session; a smaller one of the caller's is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's, else on a local master (in
    tests) one of our own. Elsewhere a folder of one machine would lose data, so it is an error."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    ctx = spark.sparkContext._jsc.sc()
    if ctx.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="locusloom-"))
    return ctx.getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: it cuts lineage, survives lost executors, is
    compressed, and has a known size, by which Spark may choose a broadcast within its limit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/locusloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slot(column) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(SLOTS))


def slots_of(keys: DataFrame, name: str) -> DataFrame:
    """At most SLOTS longs: the slots that keys take."""
    return keys.select(slot(F.col(name)).alias("_slot")).distinct()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def near_slots(rows: DataFrame, keys: DataFrame, name: str, of: F.Column) -> tuple[DataFrame, DataFrame]:
    """rows whose slot some key takes, and the others; keys are broadcast as slots only."""
    own = fresh(rows, "_slot")
    marked = rows.withColumn(own, slot(of))
    taken = F.broadcast(slots_of(keys, name).withColumnRenamed("_slot", own))
    return marked.join(taken, own, "left_semi").drop(own), marked.join(taken, own, "left_anti").drop(own)


def rows_with(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose `name` is among keys.`name`. Broadcast slots drop most other rows before the exact
    join, so that few texts are shuffled."""
    near, _ = near_slots(rows, keys, name, F.col(name))
    return near.join(keys.select(name).distinct(), name, "left_semi").select(*rows.columns)


def rows_without(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose `name` is not among keys.`name`; only rows of a slot that some key takes are shuffled."""
    near, free = near_slots(rows, keys, name, F.col(name))
    return free.unionByName(near.join(keys.select(name).distinct(), name, "left_anti").select(*rows.columns))
