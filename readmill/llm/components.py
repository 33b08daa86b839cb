"""Connected components of a graph by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.plans.runtime import cut_lineage


def _hang(by_node: DataFrame, edges: DataFrame, larger_only: bool) -> DataFrame:
    """Links each neighbour v of u to the smallest member of u's neighbourhood.

    The minimum is an aggregate and is joined back, so a hub's neighbours are never listed in one task.
    """
    low = by_node.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = edges.join(low.hint("merge"), "u")
    if larger_only:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(low.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """(id, component) for every node with a link; the component is named by its smallest id.

    Links with a null end and self links are ignored; repeated links count once.  An empty graph gives no
    rows.  Every round writes its edges to the checkpoint folder, so a lost executor costs one round.
    """
    e = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, both, larger_only=True)
        small = _hang(large, large, larger_only=False)
        e = cut_lineage(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
