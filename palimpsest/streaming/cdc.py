"""Change events: replay to the current state, before and after images, transactions; the same code for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The JSON envelope of a row-change event, as a reader schema.
ENVELOPE = """event string, timestamp string, `table` string, operation string, rows array<string>, database string, sql string,
execution_time_sec bigint, xid bigint, gtid string, commit boolean, next_file string, next_position bigint, type_id int,
type_name string, error string, table_id bigint, binlog_version int, server_version string, checksum string"""


def read_events(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Envelopes from newline-delimited JSON files, with the file they came from; a stream resumes by its checkpoint, any other reader by positions()."""
    reader = (spark.readStream if stream else spark.read).schema(ENVELOPE.replace("\n", " "))
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withColumn("source_file", F.col("_metadata.file_path"))


def row_changes(events: DataFrame) -> DataFrame:
    """One row per changed table row; events that report a gap are left to gaps()."""
    told = events.filter("error is null and rows is not null")
    return told.select("timestamp", "database", "table", "operation", F.posexplode("rows").alias("place", "row"))


def envelopes(changes: DataFrame) -> DataFrame:
    """(value): a JSON envelope of a row change for each row of changes(timestamp, database, table, operation, next_position, row); a null row is left out."""
    names = ["timestamp", "database", "table", "operation", "next_position"]
    return changes.select(F.to_json(F.struct(F.lit("row").alias("event"), *names, F.array_compact(F.array(F.to_json("row"))).alias("rows"))).alias("value"))


def positions(events: DataFrame) -> DataFrame:
    """(database, next_file, next_position): how far each database's log has been read, where a reader goes on; files go by the number that ends their names."""
    number = F.regexp_extract("next_file", r"([0-9]+)$", 1).try_cast("long").alias("number")
    at = events.filter("next_position is not null").groupBy("database").agg(F.max(F.struct(number, "next_file", "next_position")).alias("at"))
    return at.select("database", "at.next_file", "at.next_position")


def gaps(events: DataFrame) -> DataFrame:
    return events.filter("error is not null")


def counted(events: DataFrame) -> DataFrame:
    """Events by kind and operation, and of other than row changes what they say: statements, commits, rotations, transaction ids."""
    return events.groupBy("event", F.coalesce("operation", F.lit("")).alias("operation")).agg(F.count("*").alias("n"), F.count("sql").alias("statements"), F.count("xid").alias("commits"), F.count("next_file").alias("rotations"), F.count("gtid").alias("gtids"))


def table_log(changes: DataFrame, name: str, since: str | None = None) -> DataFrame:
    """The changes of one table, from a timestamp on."""
    rows = changes.filter(F.col("table") == name)
    return rows if since is None else rows.filter(F.col("timestamp") >= since)


def current_state(changes: DataFrame, key: str, seq: str, gone: Column) -> DataFrame:
    """The latest change of each key, keys whose latest is a removal left out; a partial maximum, no sort."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest, gone.alias("_gone")), seq).alias("r"))
    return last.filter("not r._gone").select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def images(changes: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """changes with the value before, in the order of each key's changes."""
    return changes.withColumn("before", F.lag(value).over(Window.partitionBy(key).orderBy(seq)))


def transactions(changes: DataFrame, begins: Column, of: str, seq: str) -> DataFrame:
    """changes with a number for each transaction of `of`: how many have begun there so far."""
    so_far = Window.partitionBy(of).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("txn", F.sum(begins.cast("long")).over(so_far))


def _kept(spark: SparkSession, state_dir: str) -> list[tuple[int, int, str]]:
    """(bucket, version, folder) of what a replay keeps, at most two versions a bucket, the older first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/version=*/_bucket=*")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    folders = [f.getPath().toString() for f in found]
    return sorted((int(f.rpartition("=")[2]), int(f.rpartition("/")[0].rpartition("=")[2]), f) for f in folders)


def _latest(kept: list[tuple[int, int, str]], version: int) -> dict[int, str]:
    """The folder of each bucket's newest version, `version` at most."""
    return {bucket: folder for bucket, made, folder in kept if made <= version}


def _state(spark: SparkSession, state_dir: str, folders: list[str]) -> DataFrame:
    empty = spark.read.parquet(f"{state_dir}/schema")
    return spark.read.schema(empty.schema).option("basePath", state_dir).parquet(*folders) if folders else empty


def replay_stream(changes: DataFrame, state_dir: str, checkpoint: str, key: str, seq: str, gone: Column, buckets: int = 64) -> StreamingQuery:
    """Keeps the current state of a stream of changes in state_dir, by buckets of keys; a batch writes a version of the buckets that it touches, no others.

    A batch is folded before it meets the state, so a key may change many times in it; removed keys stay as marks, so
    that a change that comes late is not taken for a new row. A batch that runs again starts from the versions before it
    and writes the same; of each bucket the last two versions are kept.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"_gone": gone, "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
        if not number:
            rows.limit(0).write.mode("overwrite").parquet(f"{state_dir}/schema")
        touched = {r[0] for r in rows.select("_bucket").distinct().collect()}  # `buckets` numbers at most
        if not touched:
            return
        kept = _kept(spark, state_dir)
        before = {bucket: folder for bucket, folder in _latest(kept, number - 1).items() if bucket in touched}
        rows = rows.unionByName(_state(spark, state_dir, list(before.values())).select(rows.columns))
        rest = [c for c in rows.columns if c not in (key, "_bucket")]
        last = rows.groupBy("_bucket", key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "_bucket", *[F.col(f"r.{c}").alias(c) for c in rest])
        last.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{state_dir}/version={number}")
        for bucket, made, folder in kept:
            if bucket in touched and made < number and folder != before[bucket]:
                old = spark._jvm.org.apache.hadoop.fs.Path(folder)
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_state(spark: SparkSession, state_dir: str, version: int = 1 << 62) -> DataFrame:
    """The state after a batch, the newest one or the one before it: of every bucket the version that was newest then."""
    return _state(spark, state_dir, list(_latest(_kept(spark, state_dir), version).values())).filter("not _gone").drop("_gone", "_bucket", "version")


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events a window and kind; on a stream, windows close when events come more than `late` after their end."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
