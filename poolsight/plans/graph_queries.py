"""Nearest-neighbour graphs per layer of the `events` point cloud."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolsight.operators import graph
from poolsight.plans.fixtures import PC_SQL, point_cloud
from poolsight.plans.registry import query, r, rounded

KNN_SQL = f"""with {PC_SQL},
pairs as (
  select a.session, a.layer, a.idx as src, b.idx as dst,
    sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as dist
  from pc a join pc b on a.session = b.session and a.layer = b.layer and a.idx <> b.idx
),
knn as (
  select *, row_number() over (partition by session, layer, src order by dist, dst) as rank from pairs qualify rank <= 5
),
both_ways as (
  select session, layer, src, dst from knn union all select session, layer, dst, src from knn
)"""


@query("knn_edges", KNN_SQL + f" select session, layer, src, dst, {r('dist', 'dist')}, cast(rank as integer) as rank from knn")
def knn_edges(spark, sf_dir):
    edges = graph.knn_edges(point_cloud(spark, sf_dir))
    return rounded(edges.drop("config", "job", "part"), ["dist"])


@query("knn_edges_small_leaves", KNN_SQL + f" select session, layer, src, dst, {r('dist', 'dist')}, cast(rank as integer) as rank from knn")
def knn_edges_small_leaves(spark, sf_dir):
    """The same graph from leaves of 32 spots, so that most searches cross a border."""
    edges = graph.knn_edges(point_cloud(spark, sf_dir), leaf_rows=32)
    return rounded(edges.drop("config", "job", "part"), ["dist"])


@query("edge_index", KNN_SQL + " select * from both_ways")
def edge_index(spark, sf_dir):
    return graph.edge_index(graph.knn_edges(point_cloud(spark, sf_dir))).drop("config", "job", "part")


@query("edge_index_distinct", KNN_SQL + " select distinct * from both_ways")
def edge_index_distinct(spark, sf_dir):
    edges = graph.knn_edges(point_cloud(spark, sf_dir))
    return graph.edge_index(edges, dedupe=True).drop("config", "job", "part")


@query(
    "graph_summary",
    KNN_SQL
    + """ select n.session, n.layer, n_nodes, n_edges
from (select session, layer, count(*) as n_nodes from pc group by all) n
join (select session, layer, count(*) as n_edges from both_ways group by all) e on n.session = e.session and n.layer = e.layer""",
)
def graph_summary(spark, sf_dir):
    cloud = point_cloud(spark, sf_dir)
    index = graph.edge_index(graph.knn_edges(cloud))
    return graph.graph_summary(graph.node_features(cloud), index).select("session", "layer", "n_nodes", "n_edges")


@query("node_features", f"with {PC_SQL} select session, layer, idx as node, sensor1, sensor2, x, y, z from pc")
def node_features(spark, sf_dir):
    return graph.node_features(point_cloud(spark, sf_dir)).drop("config", "job", "part")
