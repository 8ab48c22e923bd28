"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a group minimum, combined before its shuffle, and a lookup of that minimum by node. A node may have
any number of neighbours: minima are broadcast where their number is known to be small, else ``common.matched``
splits the few crowded nodes by a salt. Rounds end in written tables; nothing is collected but two sums and those few nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm import common
from coordspark.llm.common import matched, written

#: Bytes of a row (node, minimum) in a broadcast.
ROW_BYTES = 32


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def _met(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``rows`` with the ``m`` of their ``u``, of a table ``least`` that has ``n`` rows at most."""
    if n * ROW_BYTES <= common.BROADCAST_BYTES:
        return rows.join(F.broadcast(least), "u")
    return matched(written(rows, "rows"), written(least, "least"), ["u"], ROW_BYTES)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of a node to the least of the node and its neighbours. Edges have u > v."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return _met(up, least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each smaller neighbour of a node, and the node, to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = _met(edges, least, n).where("v <> m")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(node, root)``: every node that has an edge, with the smallest node of its component.

    Self-loops, nulls and repeated edges are ignored. An empty table gives an empty one. Nodes of crowded and of
    few edges are treated alike, apart from how their minimum reaches them.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(ordered.distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        n = state[0]
        edges = written(_small_star(_large_star(edges, n).distinct(), n).distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
