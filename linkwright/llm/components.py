"""Groups from pairs (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkwright.store import Table, write

#: Vertices that hold more than one part in so many of all edges are joined by broadcast.
HOT_PARTS = 2_000
#: A vertex with fewer edges is never treated as a hub.
LEAST_HUB = 50_000


def _with_minimum(edges: DataFrame, n_edges: int) -> DataFrame:
    """``u, v, m``: each edge with the smallest of ``u`` and its partners ``v``, hubs included.

    The minimum is a partial aggregate. A hub's edges are not gathered: hubs are those vertices
    that hold more than ``1 / HOT_PARTS`` of the edges, so they are fewer than ``HOT_PARTS`` and
    their minima are broadcast; the other vertices meet theirs by a shuffle.
    """
    minima = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("d"))
    limit = max(LEAST_HUB, n_edges // HOT_PARTS)
    if n_edges <= limit:
        return edges.join(minima.drop("d"), "u")
    hubs = minima.where(F.col("d") > limit).drop("d")
    rest = edges.join(minima.where(F.col("d") <= limit).drop("d"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    seen = _with_minimum(edges, n)  # u > v holds for every edge
    moved = seen.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(seen.select("u", F.col("m").alias("v"))).distinct()


def connected_components(pairs: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """``idx, group_idx`` for every id in ``a`` or ``b``: the smallest id that it is linked with.

    Large-star and small-star rewrites alternate, each a distributed join, until a round leaves the
    edges unchanged; then every vertex hangs on its component's minimum. That they are unchanged is
    seen by their number and by two sums of their hashes, which the writing of the edges gathers on
    the way. Edges between rounds are tables of the shared folder and go as soon as the next one is
    written. A pair with a missing end, or of a record with itself, names a vertex but no link;
    repeated pairs count once; either order of the ends will do. No rows give no rows. Rounds grow
    with the logarithm of the longest chain; ``max_rounds`` only guards against an error and raises.
    """
    ends = pairs.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    links = ends.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    edges, state = _written(links, "edges")
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        large, (n, *_) = _written(_large_star(edges.df, state[0]), "large")
        small, after = _written(_small_star(large.df, n), "small")
        large.drop()
        edges.drop()
        edges, before, state = small, state, after
        if state == before:
            break
    else:
        raise RuntimeError("the rewrites did not settle")
    vertices = ends.select(F.explode(F.array("x", "y")).alias("idx")).where("idx is not null").distinct()
    stars = edges.df.select(F.col("u").alias("idx"), F.col("v").alias("m"))
    return vertices.join(stars, "idx", "left").select("idx", F.coalesce("m", "idx").alias("group_idx"))


def _written(edges: DataFrame, name: str) -> tuple[Table, tuple]:
    """The edges as a table, with their number and two sums of hashes, from one run."""
    seen = Observation()
    wide = "decimal(38,0)"
    watched = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast(wide)).alias("h1"), F.sum(F.xxhash64("v", "u", F.lit(1)).cast(wide)).alias("h2"))
    table = write(watched, name)
    got = seen.get
    return table, (got["n"], got["h1"], got["h2"])
