"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A join side with no more rows than this is small whatever the corpus size.
BROADCAST_ROWS = 100_000
#: An Arrow batch ends with the row that reaches so many bytes: what executors take for batches beside their heap, they keep.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kgloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives executor loss. options: for the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kgloom-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    spark._jvm.System.gc()  # the driver drops the shuffle files of plans that it finds unreachable
    out = spark.read.schema(df.schema).parquet(path)
    out._kgloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stage() wrote, once nothing reads it any more."""
    path = getattr(df, "_kgloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches in bytes as well: ten thousand texts, as many as a batch has by default, are tens of MB or more."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(f):
    """A function over Arrow batches that gives its worker's memory back at its end: workers are kept for later tasks, which may need none of it."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Alternates neighbourhood minimum and pointer jumping; each round is
    written to the shared folder, so the lineage stays short and nothing
    reaches the driver but two counters. Edges whose ends already agree
    are contracted away, so hubs shrink as rounds go by. Null ends are
    ignored; an empty input gives an empty result.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stage(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None  # node -> current label, for nodes whose label changed
    current = both
    while True:
        if current.isEmpty():
            break
        # every node points at the smallest label among itself and its neighbours
        hook = (
            current.select(F.col("b").alias("node"), F.col("a").alias("to"))
            .union(current.select(F.col("a").alias("node"), F.col("a").alias("to")))
            .groupBy("node").agg(F.min("to").alias("to"))
        )
        hook = stage(hook, "hook")
        while True:  # pointer jumping until every label is a root
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("up"))
            jumped = stage(hook.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to"), (F.coalesce("up", "to") < F.col("to")).alias("moved")), "jump")
            moved = not jumped.where("moved").isEmpty()
            discard(hook)
            hook = jumped.select("node", "to")
            hook._kgloom_path = jumped._kgloom_path
            if not moved:
                break
        if label is None:
            nxt = hook
        else:
            nxt = stage(
                label.join(hook.select(F.col("node").alias("to"), F.col("to").alias("new")), "to", "left").select("node", F.coalesce("new", "to").alias("to"))
                .union(hook.join(label.select("node"), "node", "left_anti").select("node", "to")),
                "label",
            )
        a = hook.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        contracted = current.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        contracted = stage(contracted, "edges")
        if label is not None:
            discard(label)
            discard(hook)
        discard(current)
        current, label = contracted, nxt
    if label is None:
        return both.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return label.select("node", F.col("to").alias("component"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
