"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekwatch.llm.shared import store


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _nearest(edges: DataFrame, round_no: int) -> DataFrame:
    """(node, to): of each node and its neighbours the first by a hash of this round."""

    def place(c: str) -> Column:
        return F.xxhash64(c, F.lit(round_no))

    ways = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ("ab", "ba")]
    other = edges.select(F.explode(F.array(*ways)).alias("e")).select("e.*").groupBy("node").agg(F.min_by("other", place("other")).alias("other"))
    return other.select("node", F.when(place("other") < place("node"), F.col("other")).otherwise(F.col("node")).alias("to"))


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node reachable, for every node that has a link.

    Randomised contraction: in each round every node goes into the first of its neighbourhood, in an order drawn anew by hash, and the
    links between what is left go on; they never outnumber the first ones, and the rounds grow with the logarithm of the number
    of nodes. Rounds are written as tables, which few tasks read again while they are small; the driver sees whether links are left.
    """
    edges, steps = store(_ordered(links)), []
    while not edges.isEmpty():
        to = store(_nearest(edges, len(steps)))
        steps.append(to)
        ta, tb = (to.select(F.col("node").alias(x), F.col("to").alias(f"t{x}")) for x in "ab")
        edges = store(_ordered(edges.join(ta, "a").join(tb, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    nodes = steps[0].withColumnRenamed("to", "last")
    for to in steps[1:]:
        later = to.withColumnRenamed("node", "at")
        nodes = nodes.join(later, F.col("last") == F.col("at"), "left").select("node", F.coalesce("to", "last").alias("last"))
    return store(nodes.join(nodes.groupBy("last").agg(F.min("node").alias("root")), "last").select("node", "root"))
