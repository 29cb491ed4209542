"""What the corpus operators share: shared scratch tables, reading, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space and \t \n \v \f \r.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: How many tasks the nodes of one component are dealt to.
SALT = 16
_own_dir: str | None = None
_swept: set[str] = set()
_owner: tuple | None = None


def claim(name: str, forget=None) -> None:
    """Called by an operator's function in a Python worker: memos that another operator left there are dropped."""
    global _owner
    if _owner is not None and _owner[0] != name and _owner[1] is not None:
        _owner[1]()
    if _owner is None or _owner[0] != name:
        _owner = (name, forget)


def texts_of(column, rows: int = 512):
    """The texts of an Arrow column one after the other, a few rows in Python at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset an own one, in local mode only."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="barloom-")
    return f"file://{_own_dir}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's folder, which goes when the driver's Python ends."""
    root = f"{scratch_root(spark)}/barloom/{spark.sparkContext.applicationId}"
    if root not in _swept:
        _swept.add(root)
        atexit.register(_sweep, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of materialize() that nothing will read again."""
    path = getattr(df, "scratch", None)
    if path:
        _delete(df.sparkSession, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint where the rows have been counted and are few; otherwise the frame as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (id, component) per node.

    component is the smallest id that can be reached. Each round takes the smallest label among a
    node's neighbours and then the label of that label, so labels travel twice as far every round; rounds
    end when none moves. Both aggregations combine before they shuffle, and no neighbour list is ever
    gathered. Repeated edges and loops don't matter; edges with a null end are left out; without edges there
    are no rows.
    """
    edges = edges.where("a <> b")
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        jump = step.select("new").distinct().join(jump, "new").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = step.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))  # a component's nodes share its label
        new = materialize(salted.join(jump, ["new", "salt"], "left").select("id", F.least("new", F.coalesce("far", "new")).alias("component"), "old"), "labels")
        moved = new.where("component <> old").limit(1).count()
        discard(labels)
        labels = new.select("id", "component")
        labels.scratch = new.scratch
        if not moved:
            discard(both)
            return labels
