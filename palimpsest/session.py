"""Session and table access shared by every module."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "palimpsest") -> SparkSession:
    """A local session for tests and the bench; on a cluster, the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; any path that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set and all of Spark runs in this process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later plans start there, and lost executors cost no more than a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task of dealt() gets, keys being evenly spread.
DEALT_ROWS = 1 << 19


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys into as many parts as its rows need, so that no task that groups by them holds more at a larger size."""
    return df.repartition(max(1, -(-df.count() // DEALT_ROWS)), *keys)


#: A round of median() counts values in up to two to this power ranges.
RANGE_BITS = 14


def median(df: DataFrame, column: str) -> float | None:
    """The median of a column of whole numbers, of an even number of values the mean of the middle two; none without values.

    Values are counted by ranges, ever narrower ones around the middle: F.median() holds all that are distinct in one task.
    """
    values = df.select(F.col(column).cast("long").alias("v")).filter("v is not null")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = (n - 1) // 2
    while low < high:
        bits = max(0, (high - low).bit_length() - RANGE_BITS)
        counted = values.filter(F.col("v").between(low, high)).groupBy(F.shiftright("v", bits).alias("part")).agg(F.count("*").alias("rows"))
        for part, rows in sorted(counted.collect()):  # a number a range
            if rank < rows:
                break
            rank -= rows
        low, high = max(low, part << bits), min(high, ((part + 1) << bits) - 1)
    up_to, above = values.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    return (low + (low if n % 2 or up_to > n // 2 else above)) / 2


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing will read again."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with consecutive numbers from 0 in a column `name`, without a sort or a single task: rows are written and each file's are counted."""
    spark, mark = rows.sparkSession, F.monotonically_increasing_id()
    kept = written(rows.withColumn(name, mark), "numbered")
    counts = {r.part: r.n for r in kept.groupBy(F.shiftright(name, 33).alias("part")).agg(F.count("*").alias("n")).collect()}  # a number a task
    shifts, so_far = [], 0
    for part in sorted(counts):
        shifts.append((part, so_far - (part << 33)))
        so_far += counts[part]
    shift = spark.createDataFrame(shifts, "_part long, _shift long")
    placed = kept.withColumn("_part", F.shiftright(name, 33)).join(F.broadcast(shift), "_part")
    return placed.withColumn(name, F.col(name) + F.col("_shift")).select(*rows.columns, name)
