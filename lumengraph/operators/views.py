"""Query-local views of a graph: masks, neighbourhoods, bridges, per-seed rankings. The graph is never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Masks and seed tables up to this many rows are broadcast; larger ones are joined.
BROADCAST_ROWS = 100_000
# Labels and the types they stand for.
TYPE_ALIASES = {"出演": "acted_in", "执导": "directed"}


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def canonical_type(kind: Column) -> Column:
    out = kind
    for label, name in TYPE_ALIASES.items():
        out = F.when(kind == label, name).otherwise(out)
    return out


def edge_key(df: DataFrame) -> list[Column]:
    """Undirected, alias-aware key of an edge."""
    return [F.least("head_id", "tail_id").alias("ka"), F.greatest("head_id", "tail_id").alias("kb"), canonical_type(F.col("type")).alias("kt")]


def mask_edges(edges: DataFrame, mask: DataFrame, sized: bool = True) -> DataFrame:
    """Edges but for those whose unordered endpoints and type the mask (head_id, type, tail_id) lists."""
    keyed = edges.select("*", *edge_key(edges))
    gone = mask.select(*edge_key(mask)).distinct()
    return keyed.join(small(gone) if sized else gone, ["ka", "kb", "kt"], "left_anti").select(*edges.columns)


def mask_keys(mask: DataFrame) -> DataFrame:
    """Every spelling of a masked edge: each label of its type, in both directions."""
    kind = canonical_type(F.col("type"))
    labels = F.array(kind, *[F.when(kind == name, F.lit(label)).otherwise(kind) for label, name in TYPE_ALIASES.items()])
    spelled = mask.select("head_id", "tail_id", F.explode(F.array_distinct(labels)).alias("type"))
    return spelled.select(F.explode(F.array(F.concat_ws("|", "head_id", "type", "tail_id"), F.concat_ws("|", "tail_id", "type", "head_id"))).alias("key")).distinct()


def ways(edges: DataFrame) -> DataFrame:
    """(id, neighbour), both directions of each row."""
    return edges.select(F.explode(F.array(F.struct(F.col("head_id").alias("id"), F.col("tail_id").alias("neighbour")), F.struct(F.col("tail_id").alias("id"), F.col("head_id").alias("neighbour")))).alias("x")).select("x.*")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbour), both directions, each once."""
    return ways(edges).distinct()


def steps(edges: DataFrame, front: DataFrame) -> DataFrame:
    """The rows of ``front`` (id, ...) with each neighbour of their id; a pair of several edges may come several times.

    Only what touches the front is taken from the edges, before anything is made distinct; a front of few ids is broadcast.
    """
    return ways(edges).join(small(front), "id")


def nearby(edges: DataFrame, seeds: DataFrame, hops: int, cut) -> DataFrame:
    """The edges with an end fewer than ``hops`` away from the seeds (id), each row once: all that a walk of so many steps can take.

    Semi-joins reach below what makes the edges distinct, so their table is only scanned.
    """
    near, found = seeds.select("id").distinct(), edges.limit(0)
    for _ in range(hops):
        ids = small(near)
        ends = (edges.join(ids.withColumnRenamed("id", end), end, "left_semi") for end in ("head_id", "tail_id"))
        found = cut(next(ends).unionByName(next(ends).join(ids.withColumnRenamed("id", "head_id"), "head_id", "left_anti")))
        near = found.select(F.explode(F.array("head_id", "tail_id")).alias("id")).distinct()
    return found


def khop(edges: DataFrame, seeds: DataFrame, hops: int, cut) -> DataFrame:
    """(id, depth): nodes within ``hops`` of the seeds (id) and their least distance."""
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, hops + 1):
        step = steps(edges, frontier.select("id")).select(F.col("neighbour").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints among nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("head_id")), "head_id", "left_semi").join(nodes.select(F.col("id").alias("tail_id")), "tail_id", "left_semi")


def common_neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    near = adjacency(edges.where(F.col("head_id").isin(a, b) | F.col("tail_id").isin(a, b)))
    return near.where(F.col("id") == a).select("neighbour").join(near.where(F.col("id") == b).select("neighbour"), "neighbour", "left_semi")


def direct_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where((F.col("head_id").isin(a, b)) & (F.col("tail_id").isin(a, b)) & (F.col("head_id") != F.col("tail_id")))


def per_seed_top(edges: DataFrame, seeds: DataFrame, weight: Column, limit: int = 20) -> DataFrame:
    """For each seed (id) its ``limit`` heaviest edges; ties by edge id; rows (seed, rank, edge columns)."""
    limit = max(1, min(int(limit), 100))
    touch = edges.withColumn("seed", F.explode(F.array_distinct(F.array("head_id", "tail_id")))).join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi")
    order = Window.partitionBy("seed").orderBy(F.coalesce(weight, F.lit(0)).desc(), "id")
    return touch.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def seed_expansion(chunks: DataFrame, links: DataFrame, top_edges: DataFrame) -> DataFrame:
    """One row per chunk: its seeds, their top edges and neighbours; chunks without any keep a row of empty lists."""
    tied = chunks.join(links, "chunk_id", "left").join(top_edges.withColumnRenamed("seed", "entity_id"), "entity_id", "left")
    edge = F.when(F.col("id").isNotNull(), F.struct("id", "head_id", "type", "tail_id"))
    return tied.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"), F.array_sort(F.collect_set(edge)).alias("edges"))


def neighbourhood(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int, cap: int, cut) -> DataFrame:
    """(query_id, id, depth, rank): breadth-first from each query's seeds, in order of insertion, until ``cap`` nodes are found.

    ``edges``: head_id, tail_id, ord (insertion, not null), which may repeat; ``nodes``: id; ``seeds``: query_id, place, id. Seeds that are no nodes are
    left out, the others always count. A node's neighbours come in the order of its outgoing, then its incoming edges (of one ``ord``: by id).
    All queries expand together, a level at a time; a node's place is that of the first node that reaches it.
    """
    out = F.array(F.struct(F.col("head_id").alias("id"), F.col("tail_id").alias("to"), F.col("ord").alias("out"), F.lit(None).cast(edges.schema["ord"].dataType).alias("in")), F.struct(F.col("tail_id").alias("id"), F.col("head_id").alias("to"), F.lit(None).cast(edges.schema["ord"].dataType).alias("out"), F.col("ord").alias("in")))
    # least numbers are kept by hash, structs of them would be sorted with all rows
    least = edges.select(F.explode(out).alias("x")).select("x.*").groupBy("id", "to").agg(F.min("out").alias("out"), F.min("in").alias("in"))
    near = cut(least.select("id", "to", F.when(F.col("out").isNotNull(), F.struct(F.lit(0).alias("side"), F.col("out").alias("ord"))).otherwise(F.struct(F.lit(1).alias("side"), F.col("in").alias("ord"))).alias("at")))
    start = seeds.join(nodes.select("id").distinct(), "id", "left_semi").groupBy("query_id", "id").agg(F.min("place").alias("place"))
    order = Window.partitionBy("query_id").orderBy("place", "id")
    seen = cut(start.select("query_id", "id", F.lit(0).alias("depth"), F.row_number().over(order).alias("rank")))
    for depth in range(1, hops + 1):
        have = seen.groupBy("query_id").agg(F.max("rank").alias("have")).where(F.col("have") < cap)
        reach = seen.where(F.col("depth") == depth - 1).join(near, "id").groupBy("query_id", F.col("to").alias("id")).agg(F.min(F.struct("rank", "at")).alias("by"))
        new = reach.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
        new = new.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("by", "id"))).where(F.col("n") <= cap).join(have, "query_id").where(F.col("n") + F.col("have") <= cap)
        seen = cut(seen.unionByName(new.select("query_id", "id", F.lit(depth).alias("depth"), (F.col("n") + F.col("have")).alias("rank"))))
    return seen
