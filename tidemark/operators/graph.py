"""Directed graphs as tables: vertices (id, ...) and edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut

#: Edges that a level of a recursion may broadcast.
BROADCAST = 10_000
EDGE_SCHEMA = "src string, dst string, weight long"


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "id string"), spark.createDataFrame([], EDGE_SCHEMA)


def count_edges(pairs: DataFrame) -> DataFrame:
    """(src, dst, weight) from single occurrences (src, dst)."""
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def add_edges(edges: DataFrame, more: DataFrame, parallel: bool = False) -> DataFrame:
    """Union; equal edges are one with the sum of weights unless ``parallel`` keeps both."""
    both = edges.unionByName(more)
    return both if parallel else both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def set_weights(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Union in which ``more`` overrides the weights of ``edges``."""
    tagged = edges.withColumn("o", F.lit(0)).unionByName(more.withColumn("o", F.lit(1)))
    return tagged.groupBy("src", "dst").agg(F.max_by("weight", F.struct("o", "weight")).alias("weight"))


def add_vertices(vertices: DataFrame, more: DataFrame) -> DataFrame:
    """Union; a vertex (id, ...) that is there already stays as it is."""
    return vertices.unionByName(more.join(vertices.select("id"), "id", "left_anti").dropDuplicates(["id"]).select(*vertices.columns))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("out"))


def remove_unconnected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(vertices_of(edges), "id", "left_semi")


def prune_edges(vertices: DataFrame, edges: DataFrame, drop: Column) -> tuple[DataFrame, DataFrame]:
    """Without the edges that satisfy ``drop`` and the vertices that this leaves alone."""
    kept = edges.where(~F.coalesce(drop, F.lit(False)))
    return remove_unconnected(vertices, kept), kept


def prune_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame, isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Without the vertices in ``gone`` (id) and their edges; with ``isolated`` also without what is then unconnected."""
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)
    left = vertices.join(gone.select("id"), "id", "left_anti")
    return (remove_unconnected(left, kept) if isolated else left), kept


def prune_vertices_where(vertices: DataFrame, edges: DataFrame, drop: Column, isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """``prune_vertices`` of the vertices that satisfy ``drop``; null counts as false."""
    return prune_vertices(vertices, edges, vertices.where(F.coalesce(drop, F.lit(False))).select("id"), isolated)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def starting_points(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that no edge enters."""
    return vertices.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def ending_points(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that no edge leaves."""
    return vertices.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def degree_checks(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: at most one edge out of each vertex, into each, both (single threads), and with one start and one end at that."""
    out = edges.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("out"))
    into = edges.groupBy("dst").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("into"))
    n_in = starting_points(vertices, edges).agg(F.count(F.lit(1)).alias("starts"))
    n_out = ending_points(vertices, edges).agg(F.count(F.lit(1)).alias("ends"))
    one = out.withColumn("one", F.lit(1))
    for x in (into, n_in, n_out):  # one row each
        one = one.join(F.broadcast(x.withColumn("one", F.lit(1))), "one")
    single = (F.col("out") <= 1) & (F.col("into") <= 1)
    return one.select((F.col("out") <= 1).alias("one_out"), (F.col("into") <= 1).alias("one_in"), single.alias("single_threads"), (single & (F.col("starts") == 1) & (F.col("ends") == 1)).alias("single_thread"))


def thread_threshold(edges: DataFrame, limit: int = 30) -> DataFrame:
    """One row, ``threshold``: the least w >= 1 such that without edges of weight w or less no vertex has two edges out or in; null beyond ``limit``.

    In closed form: the largest second-largest weight of any vertex's edges out or in.
    """

    def second(side: str) -> DataFrame:
        # The two largest weights by aggregation: a hub's edges aren't ordered in one task.
        top = edges.groupBy(side, "weight").agg(F.count(F.lit(1)).alias("n")).groupBy(side).agg(F.max(F.struct("weight", "n")).alias("m"))
        rest = edges.join(top.select(side, F.col("m.weight").alias("top")), side).where("weight < top").groupBy(side).agg(F.max("weight").alias("next"))
        return top.join(rest, side, "left").select(F.when(F.col("m.n") > 1, F.col("m.weight")).otherwise(F.col("next")).alias("w"))

    worst = second("src").unionByName(second("dst")).agg(F.greatest(F.coalesce(F.max("w"), F.lit(1)), F.lit(1)).alias("w"))
    return worst.select(F.when(F.col("w") <= limit, F.col("w")).alias("threshold"))


def weight_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


def _grow(spark: SparkSession, starts: DataFrame, edges: DataFrame, done: str, deepest: int | None) -> DataFrame:
    """(path, closed): paths by recursion from ``starts``, level by level until none grows; ``done`` is the final filter.

    A path whose last vertex it has visited before is closed and grows no further. With ``deepest``, a path
    that would grow past so many steps is an error.
    """
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    # The error names e.dst, so that it is not raised before the join, for a path that ends.
    grows = "NOT p.closed" if deepest is None else f"CASE WHEN p.closed THEN false WHEN size(p.path) > {deepest} THEN CAST(raise_error(concat('a path is longer than {deepest} steps, at ', e.dst)) AS BOOLEAN) ELSE true END"
    # Each level would send a broadcast table through the driver again, so only few edges may be broadcast.
    links = cut(edges.select("src", "dst").distinct())
    hint = "/*+ MERGE(p, e) */" if links.limit(BROADCAST + 1).count() > BROADCAST else ""
    return spark.sql(
        f"""
        WITH RECURSIVE paths(path, last, closed) AS (
          SELECT array(id), id, false FROM {{starts}}
          UNION ALL
          SELECT {hint} concat(p.path, array(e.dst)), e.dst, array_contains(p.path, e.dst)
          FROM paths p JOIN {{edges}} e ON p.last = e.src WHERE {grows}
        ) SELECT path, closed FROM paths WHERE {done}""",
        starts=cut(starts.select("id")),  # each level reads both again
        edges=links,
    )


def single_strands(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """From each starting point the path along vertices with one edge out, until it ends, forks or would loop. ``path`` is ordered.

    By doubling: a round appends, to the first 2^k vertices of each strand, those 2^k steps on, so strands of any length
    take a logarithmic number of shuffles.
    """
    jump = cut(edges.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).where("n = 1").select("src", "dst"))
    rows = cut(starting_points(vertices, edges).select(F.col("id").alias("start"), F.lit(0).cast("long").alias("pos"), "id"))
    n, reach = rows.count(), 1
    while True:
        on = rows.join(jump, F.col("id") == F.col("src")).select("start", (F.col("pos") + reach).alias("pos"), F.col("dst").alias("id"))
        # What a strand meets again lies behind its first repeat.
        rows = cut(rows.unionByName(on).groupBy("start", "id").agg(F.min("pos").alias("pos")))
        if (more := rows.count()) == n:
            break
        n, reach = more, 2 * reach
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst"))
    return rows.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("x")).select(F.transform("x", lambda e: e["id"]).alias("path"))


def simple_paths(vertices: DataFrame, edges: DataFrame, starts: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """All paths from the starting points that visit no vertex twice and end at a sink, or where every way on would loop or a way would close a loop."""
    spark = edges.sparkSession
    begin = (starting_points(vertices, edges) if starts is None else starts).select("id")
    grown = _grow(spark, begin, edges, "true", deepest)
    sinks = ending_points(vertices, edges).select(F.col("id").alias("__sink"))
    ended = grown.where("NOT closed").join(sinks, F.element_at("path", -1) == F.col("__sink"), "left_semi").select("path")
    before = grown.where("closed").select(F.expr("slice(path, 1, size(path) - 1)").alias("path"))
    return ended.unionByName(before).distinct()


def find_loop(vertices: DataFrame, edges: DataFrame, deepest: int | None = None) -> DataFrame:
    """At most one row: the least closing path (with the repeated vertex) from a starting point, else, reversed, from an ending point."""
    spark = edges.sparkSession
    ahead = _grow(spark, starting_points(vertices, edges).select("id"), edges, "closed", deepest).select(F.lit(0).alias("o"), "path")
    back_edges = transpose(edges.select("src", "dst"))
    back = _grow(spark, ending_points(vertices, edges).select("id"), back_edges, "closed", deepest).select(F.lit(1).alias("o"), F.reverse("path").alias("path"))
    return ahead.unionByName(back).orderBy("o", F.size("path"), "path").limit(1).select("path")


def longest_runs(edges: DataFrame) -> DataFrame:
    """(id, head, distance): for every vertex on a chain of single edges the chain's head and the steps to it, by pointer jumping.

    Each round doubles the reach, so chains of any length take a logarithmic number of shuffles; while any chain is longer
    than the reach, more vertices reach their head in each round, so rounds end with the first in which none does. A pure
    cycle has no head and is left out.
    """
    pairs = cut(edges.select("src", "dst").distinct(), "pairs")
    out = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    into = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"))
    links = cut(pairs.join(out, "src").join(into, "dst").where("n_out = 1 AND n_in = 1").select(F.col("dst").alias("id"), F.col("src").alias("up")), "links")
    heads = vertices_of(pairs).join(links.select("id"), "id", "left_anti").select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("done"))
    state = cut(links.select("id", "up", F.lit(1).cast("long").alias("d"), F.lit(False).alias("done")).unionByName(heads), "runs")
    arrived = -1
    while (now := state.where("done").count()) > arrived:
        arrived = now
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        moved = state.where("NOT done").join(above, "up").select("id", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"))
        state = cut(state.where("done").unionByName(moved), "runs")
    return state.where("done").select("id", F.col("up").alias("head"), F.col("d").alias("distance"))
