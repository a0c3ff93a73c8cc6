"""Reading tables, the shared folder, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete_folder, run_folder, written

__all__ = ["components", "forget", "limit_batches", "shared_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that reach a Python worker at a time, so that long texts don't come by the thousand.
ARROW_BYTES = 4 << 20


def limit_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the application's shared folder; see ``sources.shared``."""
    limit_batches(spark)
    return run_folder(spark)


def forget(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables of a run that nothing still to be computed reads."""
    for name in names:
        delete_folder(spark, f"{folder}/{name}")


def _rooted(up: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component) of a forest whose pointers lead to smaller ids: pointers jump, twice as far each round, until all meet roots."""
    k = 0
    while True:
        k += 1
        top = up.select(F.col("id").alias("component"), F.col("component").alias("root"))
        up = written(up.join(top, "component").select("id", F.col("root").alias("component"), (F.col("root") < F.col("component")).alias("moved")), folder, f"{name}-{k}")
        still = up.where("moved").isEmpty()
        up = up.select("id", "component")
        forget(up.sparkSession, folder, f"{name}-{k - 1}")
        if still:
            return up


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): component is the smallest id reachable.

    Every vertex points to its smallest neighbour, if that is smaller; the trees of these pointers
    become the vertices of the next phase, under their smallest ids, until no links are left. A root
    that takes in no other vertex has a smaller neighbour in the next phase, so two phases leave
    half of the vertices at most, and the pointers of a phase need the logarithm of their
    depth; there is no limit to stop at. What a round gives is written to the shared folder. Minima are
    combined before each shuffle, so a vertex with very many links costs no more than its links. Null
    ends are dropped; repeated links and self links change nothing; no edges give no rows."""
    e = edges.select("a", "b").where("a is not null and b is not null")
    e = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, f"{name}-links")
    labels, phase = None, 0
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), folder, f"{name}-{phase}-0")
        up = _rooted(up, folder, f"{name}-{phase}")
        root = up.select(F.col("id").alias("component"), F.col("component").alias("root"))
        if labels is None:
            labels = up
        else:
            labels = written(labels.join(root, "component", "left").select("id", F.coalesce("root", "component").alias("component")), folder, f"{name}-{phase}-labels")
        # the larger end first: where it points to the other one, the link is used up before the ends with many links are shuffled
        half = e.join(root, e.b == root.component).select("a", F.col("root").alias("b")).where("a <> b").distinct()
        left = half.join(root, half.a == root.component).select(F.col("root").alias("a"), "b").where("a <> b")
        e = written(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, f"{name}-{phase}-links")
        forget(e.sparkSession, folder, f"{name}-links" if phase == 0 else f"{name}-{phase - 1}-links")
        if e.isEmpty():
            return labels
        phase += 1
