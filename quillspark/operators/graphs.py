"""Weighted digraphs as edge tables (edge_id, src, dst, weight): order, paths and closures by iterated joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach


class GraphError(ValueError):
    """A weight is not finite, or a walk that needs a graph without cycles met one."""


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's checkpoint folder; on one machine without one, through a temporary folder."""
    spark = attach(df.sparkSession)
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


#: A front of so many rows at most is sent to the edges; a longer one meets them in a shuffle. Edges and vertices are
#: never broadcast, whatever their estimated size, as every round would send them through the driver again.
NARROW = 10_000

#: A level of so many vertices at most is ordered in one task; a larger one is dealt out by ranges first.
ONE_TASK = 100_000


def _sent(front: DataFrame) -> tuple[DataFrame, int]:
    """The front, hinted by its length, and its length."""
    n = front.count()
    return (F.broadcast(front) if n <= NARROW else front.hint("merge")), n


class Digraph:
    def __init__(self, edges: DataFrame, check: bool = True):
        if check and edges.where("weight is null or isnan(weight) or abs(weight) = double('infinity')").limit(1).count():
            raise GraphError("a weight is not finite")
        self.edges = edges.select("edge_id", "src", "dst", F.col("weight").cast("double").alias("weight"))

    def vertices(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()

    def out_degree(self) -> DataFrame:
        return self.vertices().join(self.edges.groupBy("src").count(), F.col("vertex") == F.col("src"), "left").select("vertex", F.coalesce("count", F.lit(0)).alias("out_degree"))

    def levels(self) -> DataFrame:
        """(vertex, level): the number of edges of the longest way to it; raises if there is a cycle."""
        left, done, level = self.edges.select("src", "dst").distinct(), None, 0
        vertices = checkpointed(self.vertices())
        while True:
            free = vertices.join(left.select(F.col("dst").alias("vertex")).distinct().hint("merge"), "vertex", "left_anti")
            free = checkpointed(free.withColumn("level", F.lit(level)))
            if not free.limit(1).count():
                if vertices.limit(1).count():
                    raise GraphError("the graph has a cycle")
                return done if done is not None else vertices.withColumn("level", F.lit(0))
            done = free if done is None else done.unionByName(free)
            vertices = checkpointed(vertices.join(free.hint("merge"), "vertex", "left_anti"))
            left = checkpointed(left.join(free.hint("merge"), left["src"] == free["vertex"], "left_anti"))
            level += 1

    def topological(self) -> DataFrame:
        """(vertex, level, place) as a first-in first-out queue would give it; raises if there is a cycle.

        Vertices are numbered as they first stand in the edges, source before target.  A queue takes whole levels in
        turn; within one, a vertex stands where its last predecessor and that edge put it.
        """
        levels = checkpointed(self.levels())
        first = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), (F.col("edge_id") * 2).alias("at")), F.struct(F.col("dst").alias("vertex"), (F.col("edge_id") * 2 + 1).alias("at")))).alias("v")).groupBy("v.vertex").agg(F.min("v.at").alias("at"))
        # the levels are the driver's loop; the vertices of a level are put in a total order
        done, level, before = None, 0, 0
        while True:
            now = levels.where(F.col("level") == level)
            n = now.count()
            if not n:
                return done if done is not None else levels.select("vertex", "level", F.lit(0).cast("long").alias("place"))
            if done is None:
                keyed = now.join(first.hint("merge"), "vertex").select("vertex", F.struct(F.lit(0).cast("long").alias("p"), F.col("at").cast("long").alias("e")).alias("key"))
            else:
                into = now.join(self.edges.hint("merge"), F.col("vertex") == F.col("dst"))
                keyed = into.join(done.select(F.col("vertex").alias("src"), "place").hint("merge"), "src").groupBy("vertex").agg(F.max(F.struct(F.col("place").alias("p"), F.col("edge_id").cast("long").alias("e"))).alias("key"))
            placed = checkpointed(_placed(keyed, n).select("vertex", F.lit(level).alias("level"), (F.col("at") + before).cast("long").alias("place")))
            done = placed if done is None else done.unionByName(placed)
            before, level = before + n, level + 1

    def paths(self, source, longest: bool = False) -> DataFrame:
        """(vertex, distance, edge_id) of every vertex that can be reached; ties go to the lower edge."""
        sign = -1.0 if longest else 1.0
        best = checkpointed(self.edges.sparkSession.range(1).select(F.lit(source).alias("vertex"), F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("edge_id"), F.lit(True).alias("new")))
        limit = self.vertices().count()
        for _ in range(limit + 1):
            front, n = _sent(best.where("new").drop("new"))
            if not n:
                return best.select("vertex", (F.col("distance") * sign + 0.0).alias("distance"), "edge_id")
            step = front.join(self.edges, F.col("vertex") == F.col("src")).select(F.col("dst").alias("vertex"), (F.col("distance") + sign * F.col("weight")).alias("distance"), self.edges["edge_id"].cast("long").alias("edge_id"), F.lit(True).alias("new"))
            # what was found before stands first among equals, so only a better row is new
            order = Window.partitionBy("vertex").orderBy("distance", F.col("edge_id").asc_nulls_first(), "new")
            best = checkpointed(best.withColumn("new", F.lit(False)).unionByName(step).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r"))
        raise GraphError("the graph has a cycle that can be reached")

    def path(self, source, target, longest: bool = False) -> list:
        """Vertices of one path, found backwards along the chosen edges; None if there is none."""
        tree = checkpointed(self.paths(source, longest))
        if not tree.where(F.col("vertex") == target).limit(1).count():
            return None
        out = [target]
        while out[-1] != source:
            row = tree.where(F.col("vertex") == out[-1]).join(self.edges.select("edge_id", "src"), "edge_id").first()
            out.append(row["src"])
        return out[::-1]


def _placed(keyed: DataFrame, n: int) -> DataFrame:
    """(vertex, at): the places of ``n`` vertices by key, from 0."""
    if n <= ONE_TASK:
        return keyed.select("vertex", (F.row_number().over(Window.orderBy("key")) - 1).alias("at"))
    dealt = checkpointed(keyed.select("vertex", "key.p", "key.e").repartitionByRange("p", "e").withColumn("part", F.spark_partition_id()))
    starts, total = [], 0
    for part, size in sorted(dealt.groupBy("part").count().collect()):
        starts.append((part, total))
        total += size
    begun = F.broadcast(dealt.sparkSession.createDataFrame(starts, "part int, start long"))
    return dealt.join(begun, "part").select("vertex", (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("p", "e")) - 1).alias("at"))


def closure(edges: DataFrame, start: DataFrame, node: str = "node") -> DataFrame:
    """(root, node, depth): everything reachable from the start nodes, each once at its least depth, the start itself left out."""
    front = checkpointed(start.select(F.col(node).alias("root"), F.col(node).alias("node")).distinct())
    seen = front.withColumn("depth", F.lit(0))
    depth = 1
    while True:
        front, n = _sent(front)
        if not n:
            return seen.where("depth > 0")
        step = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = checkpointed(step.join(seen.select("root", "node").hint("merge"), ["root", "node"], "left_anti"))
        seen = checkpointed(seen.unionByName(front.withColumn("depth", F.lit(depth))))
        depth += 1
