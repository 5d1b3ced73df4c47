"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only after a count has shown at most so many rows, and bytes of strings in them.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

#: A narrow table of at most so many rows is worked on in one task.
FEW_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; a folder of the warehouse only where it is unset."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named:
        return named
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/.checkpoints"
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow table: lineage ends here and lost executors only reread it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more, and lets go of the shuffles of ended jobs.

    Spark deletes a shuffle's files once the driver has collected what refers to it, which a driver with memory
    to spare does seldom; a long operator asks for it here. What the driver's JVM has freed outside its heap (compilers,
    codecs) goes back to the system, too: malloc keeps it for every thread as long as the driver lives.
    """
    jvm = spark._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Makes the driver's JVM return freed native memory to the system; false where JVM or system can't."""
    jvm = spark._jvm

    def array(kind, *values):
        out = spark.sparkContext._gateway.new_array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    try:
        # By reflection, since the server's own class is closed to callers.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        none = array(jvm.Object), array(jvm.String)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, command, "systemTrimNativeHeap", *none))
    except Py4JError:
        return False
    return True


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside it, jobs hand rows to Python in batches of at most ``rows``: for wide rows such as pictures."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``limit`` rows of at most ``BROADCAST_BYTES`` of strings, else as it is (a shuffled join)."""
    strings = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in small.schema if f.dataType.simpleString() in ("string", "binary")]
    size = F.coalesce(F.sum(sum(strings, F.lit(0))), F.lit(0)) if strings else F.lit(0)
    rows, content = small.limit(limit + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(small) if rows <= limit and content <= BROADCAST_BYTES else small


def few(narrow: DataFrame) -> DataFrame:
    """``narrow`` in one partition if a count shows at most ``FEW_ROWS`` rows, so that grouping and joining them takes no exchange; else as it is."""
    return narrow.coalesce(1) if narrow.count() <= FEW_ROWS else narrow


def buckets_of(rows: DataFrame) -> DataFrame:
    """``node, low, n, bucket`` of ``rows(node, sig)``: nodes that share a signature, the smallest of them and their number.

    One exchange of 16-byte rows. Signatures that the same nodes share make one bucket.
    """
    w = Window.partitionBy("sig")
    met = rows.select("node", F.count(F.lit(1)).over(w).alias("n"), F.min("node").over(w).alias("low"), F.bit_xor(F.xxhash64("node")).over(w).alias("mark"))
    return met.where("n > 1").select("node", "low", "n", F.xxhash64("n", "low", "mark").alias("bucket")).dropDuplicates(["bucket", "node"])


def open_pairs(rows: DataFrame, small: int) -> DataFrame:
    """Distinct ``a, b``: pairs of nodes of different roots in buckets of at most ``small`` nodes, of the rows of ``still_open``."""
    few = rows.where(F.col("n") <= small).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("m"))
    one = few.select("m", F.posexplode("m").alias("i", "a"))
    both = one.select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b")).where("a.root <> b.root")
    return both.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def still_open(buckets: DataFrame, small: int, links: DataFrame) -> DataFrame:
    """The rows, with each node's ``root``, of buckets of more than ``small`` nodes that ``links(a, b)`` don't join to one component."""
    large = buckets.where(F.col("n") > small)
    # A node's root reaches its rows by a window over the node: one exchange, whatever the buckets' sizes.
    root = components(links).where("root <> node").select("node", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("bucket"), "root")
    both = large.select("node", "low", "n", "bucket", F.lit(None).cast("long").alias("root")).unionByName(root)
    rooted = both.withColumn("root", F.coalesce(F.max("root").over(Window.partitionBy("node")), "node")).where("bucket is not null")
    ends = rooted.groupBy("bucket").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last")
    return rooted.join(ends, "bucket", "left_semi")


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges from ``a`` to ``b``, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        for end in (x, y):
            np.minimum.at(new, root[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _components_of_few(edges: DataFrame) -> DataFrame:
    """As ``components``, of at most ``FEW_ROWS`` edges: in one task, without a round of joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in roots(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root being the smallest node.

    Few edges between longs are gone through in one task: every round is a plan that the driver makes, compiles and
    remembers. Others: alternates large-star and small-star steps until no edge changes; every step is a grouped
    minimum (partial aggregation absorbs hubs) and a join back on the node. Only nodes that have
    an edge come back. Null ends and self-loops are ignored.
    """
    edges = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    if edges.schema["a"].dataType.simpleString() == "bigint" and edges.count() <= FEW_ROWS:
        return _components_of_few(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        state = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
            F.sum(F.col("a").cast("decimal(38,0)") - F.col("b")).alias("d"),
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("connected components did not converge")
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def united(root: DataFrame, edges: DataFrame) -> DataFrame:
    """``root(node, root)`` of components, roots being their smallest nodes and left out, after ``edges(a, b)`` have joined more of them.

    Only the components that an edge joins are gone through: what they are called, not their nodes, and nothing if there are none.
    """
    edges, known = few(edges), sized(root)
    for end in "ab":
        edges = edges.join(known.withColumnsRenamed({"node": end, "root": "to"}), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    between = stored(edges.where("a <> b").distinct())
    if between.isEmpty():
        return root
    joined = stored(components(few(between)).where("root <> node"))
    moved = root.join(sized(joined.select(F.col("node").alias("root"), F.col("root").alias("to"))), "root", "left")
    new = stored(few(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(joined)))
    discard(root.sparkSession, between, joined)
    return new
