"""Helpers that the operators share: the shared folder, Arrow batches, id filters and text folding."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Ids that may be broadcast at once; 16 MB as longs. Beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000
#: Rows with whole texts that pass to Python at once.
ARROW_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session, as in tests, gets
    one of our own; on a cluster that is an error, for executors couldn't read a folder of the driver's machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not local_master(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="calibrant-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def in_batches(rows: DataFrame) -> DataFrame:
    """rows, with the session's Arrow batches held to ARROW_ROWS rows: whole texts pass through both the JVM's and
    Python's buffers, whose size is that of a batch."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return rows


def local_master(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def give_back() -> None:
    """Return a worker's free memory to the system: workers are used again by later stages, which shouldn't carry it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def arrow_map(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches of ARROW_ROWS rows; a task's worker gives back its memory at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return in_batches(rows).mapInArrow(task, schema)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables that stored() wrote, once nothing reads them any more."""
    for df in frames:
        hadoop_path(df.sparkSession, df._stored_at, delete=True)


def hadoop_path(spark: SparkSession, path: str, delete: bool = False):
    """(file system, path) by Hadoop, so that any store that Spark reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if delete:
        fs.delete(p, True)
    return fs, p


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def with_ids(df: DataFrame, ids: DataFrame, how: str, col: str = "doc_id", rows: int | None = None) -> DataFrame:
    """left_semi or left_anti join of wide rows with a stored id list. Up to BROADCAST_IDS ids are broadcast, so wide rows stay where they are; longer lists are joined by a shuffle."""
    n = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, col, how)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """(id, text, label) of at most so many labelled rows, the ones whose ids hash lowest; a bounded training set, whose
    texts stay on the executors: operators reduce them to features there.

    Rows of labels with a null id or label don't count; of several labels of an id the largest does; where is a
    condition on labels' id. Ids without a document are left out; of the rows of a repeated id all are in.
    """
    own = labels.where(labels[id].isNotNull() & labels[label].isNotNull())
    own = own.where(where) if where is not None else own
    one = own.groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    drawn = one.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(docs[id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text")).join(F.broadcast(drawn), "id").select("id", "text", "label")


def learning_rows(id: str = "doc_id") -> Column:
    """Rows that labels may be learned from; the others are held out."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 4 != 2
