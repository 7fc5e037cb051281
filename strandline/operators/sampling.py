"""Search points: hash-ordered samples, with or without a least distance."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import lcg


def with_priority(cells: DataFrame, seed: int = 0) -> DataFrame:
    """Cells with a pseudo-random priority of their own, the same on any engine and for any partitioning."""
    key = F.col("tid").cast("long") * 4096 + F.col("r").cast("long") * 64 + F.col("c") + seed
    return cells.withColumn("priority", lcg(key))


def search_points(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n cells by priority; all, where there are fewer."""
    return with_priority(cells, seed).orderBy("priority", "tid", "r", "c").limit(n)


def top_up(have: DataFrame, cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The points that there are, and as many new ones as are missing to n; the first n by priority if there are more."""
    old = with_priority(have.select("tid", "r", "c"), seed)
    new = with_priority(cells.select("tid", "r", "c").join(have, ["tid", "r", "c"], "left_anti"), seed)
    both = old.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    return both.orderBy("new", "priority", "tid", "r", "c").limit(n).drop("new")


def may_checkpoint(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir, set for checkpoints too.

    Only on a local master, where there are no other machines, a temporary one may stand for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def inhibited_points(cells: DataFrame, radius: float, seed: int = 0) -> DataFrame:
    """A largest set of cells with no two of one grid within radius: tid, r, c, priority.

    Round by round, cells that come first within the radius are kept and their neighbours dropped, until none is left;
    a join on blocks as wide as the radius finds the neighbours.  Any set with this property is a valid sample; this
    one is the same for any partitioning.  Cells without a place (null tid, r or c) are near none and not sampled.
    """
    size = max(1, int(radius) + 1)
    left = with_priority(cells.select("tid", "r", "c").dropna(), seed).withColumn("order", F.struct("priority", "r", "c"))
    blocks = {"br": F.floor(F.col("r") / size), "bc": F.floor(F.col("c") / size)}
    kept = None
    may_checkpoint(cells.sparkSession)
    while True:  # a round keeps the first cell of each grid that is left, so that there is an end
        around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        near = left.withColumns(blocks).withColumn("s", around).select("tid", (F.col("br") + F.col("s.a")).alias("br"), (F.col("bc") + F.col("s.b")).alias("bc"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("order").alias("order2"))
        close = (F.col("r") - F.col("r2")) * (F.col("r") - F.col("r2")) + (F.col("c") - F.col("c2")) * (F.col("c") - F.col("c2")) <= radius * radius
        first = left.withColumns(blocks).join(near.withColumnsRenamed({"tid": "t2", "br": "br2", "bc": "bc2"}), (F.col("tid") == F.col("t2")) & (F.col("br") == F.col("br2")) & (F.col("bc") == F.col("bc2")) & close & (F.col("order2") < F.col("order")), "left_anti")
        first = first.select("tid", "r", "c", "priority", "order").checkpoint()
        kept = first if kept is None else kept.unionByName(first)
        f = first.withColumns(blocks).withColumn("s", around).select(F.col("tid").alias("t2"), (F.col("br") + F.col("s.a")).alias("br2"), (F.col("bc") + F.col("s.b")).alias("bc2"), F.col("r").alias("r2"), F.col("c").alias("c2"))
        left = left.withColumns(blocks).join(f, (F.col("tid") == F.col("t2")) & (F.col("br") == F.col("br2")) & (F.col("bc") == F.col("bc2")) & close, "left_anti").select("tid", "r", "c", "priority", "order").checkpoint()
        if left.isEmpty():
            return kept.drop("order")
