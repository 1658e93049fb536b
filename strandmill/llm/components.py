"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import forget, stored


def _hung_on_minimum(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Hang the neighbours of every node on the least of them.

    ``edges`` (u, v): with ``keep_larger`` v ranges over all neighbours and only
    those above u move (large star), else v are neighbours below u (small star).
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    with_least = edges.join(least, "u")
    if keep_larger:
        return with_least.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    moved = with_least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node with a link; the component is its least node.

    Every round is written to the shared folder, so lineage stays short and lost
    executors cost one round at most. Rounds grow with the logarithm of a
    component's diameter. Links to oneself and null ends are ignored; repeated
    links are legal.
    """
    big, small = F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    edges = stored(links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).select(big, small).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hung_on_minimum(both, keep_larger=True).where("u <> v").distinct()
        after = stored(_hung_on_minimum(large, keep_larger=False).where("u <> v").distinct(), "links")
        forget(edges)
        edges = after
