"""Turning radius of road edges: lookahead walks along a street, then the circle through three points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cobblestone.functions import planar
from cobblestone.operators import network
from cobblestone.session import cut_lineage


def distant_points(
    edges: DataFrame, nodes: DataFrame, target: float, mode: str, pairs: DataFrame | None = None
) -> DataFrame:
    """Where a walk from an edge's near end arrives after at least ``target`` metres.

    One walk per named (u, v): ``succ`` leaves u over v, ``pred`` leaves v back over
    u. A walk goes on only through nodes of degree two or less and along edges that
    carry its street name; walks that stop short have no row. All walks advance
    together, one hop per round; a round costs two equi-joins of the walks still
    short of the target. Result: (start_node, direction_node, street, p).
    """
    pairs = network.street_pairs(edges) if pairs is None else pairs
    at = nodes.select("node_id", planar.point(F.col("x"), F.col("y")).alias("at"))
    near, far = ("u", "v") if mode == "succ" else ("v", "u")
    p_near = at.select(F.col("node_id").alias(near), F.col("at").alias("p_near"))
    p_far = at.select(F.col("node_id").alias(far), F.col("at").alias("p_far"))
    hop = pairs.join(p_near, near).join(p_far, far).select(
        F.col(near).alias("near"), F.col(far).alias("far"), "street",
        planar.distance(F.col("p_near"), F.col("p_far")).alias("metres"), F.col("p_far").alias("p"),
    )
    hop = cut_lineage(hop, "hops")
    # what a walk may take after its first hop: any name of an edge that leaves a node which is no crossing
    open_nodes = network.degrees(edges).where(F.col("degree") <= 2).select(F.col("node_id").alias("near"))
    named = edges.select(F.col(near).alias("near"), F.col(far).alias("far"), F.explode("name").alias("name")).distinct()
    onward = hop.drop("street").join(named, ["near", "far"]).join(open_nodes, "near", "left_semi")
    onward = cut_lineage(
        onward.select(
            F.col("near").alias("current"), F.col("name").alias("street"), F.col("far").alias("next"),
            F.col("metres").alias("step"), F.col("p").alias("p_next"),
        ),
        "onward",
    )
    walking = hop.where(F.col("street").isNotNull()).select(
        F.col("near").alias("start_node"), F.col("far").alias("direction_node"), "street",
        F.col("near").alias("previous"), F.col("far").alias("current"), F.col("metres").alias("walked"), "p",
    )
    keep = ["start_node", "direction_node", "street", "p"]
    done = walking.where(F.col("walked") >= target).select(*keep)
    walking = cut_lineage(walking.where(F.col("walked") < target), "walks")
    while not walking.isEmpty():
        stepped = (
            walking.join(onward, ["current", "street"])
            .where(F.col("next") != F.col("previous"))
            .select(
                "start_node", "direction_node", "street", F.col("current").alias("previous"),
                F.col("next").alias("current"), (F.col("walked") + F.col("step")).alias("walked"),
                F.col("p_next").alias("p"),
            )
        )
        stepped = cut_lineage(stepped, "walks")
        done = done.unionByName(stepped.where(F.col("walked") >= target).select(*keep))
        walking = stepped.where(F.col("walked") < target)
    return done


def measured_turns(edges: DataFrame, nodes: DataFrame, lookahead: float) -> DataFrame:
    """Every turn of a street at a node, with deviation and radius between its two distant points (P10)."""
    pairs = cut_lineage(network.street_pairs(edges), "street-pairs")
    behind = distant_points(edges, nodes, lookahead, "pred", pairs).select(
        F.col("direction_node").alias("u"), F.col("start_node").alias("v"), "street", F.col("p").alias("p_in")
    )
    ahead = distant_points(edges, nodes, lookahead, "succ", pairs).select(
        F.col("start_node").alias("v"), F.col("direction_node").alias("w"), "street", F.col("p").alias("p_out")
    )
    centre = nodes.select(F.col("node_id").alias("v"), planar.point(F.col("x"), F.col("y")).alias("at"))
    turns = behind.join(ahead, ["v", "street"]).where(F.col("u") != F.col("w")).join(centre, "v")
    p_in, at, p_out = F.col("p_in"), F.col("at"), F.col("p_out")
    return turns.select(
        "u", "v", "w", "street", planar.deviation(p_in, at, p_out).alias("deviation"),
        planar.circumradius(p_in, at, p_out, planar.NETWORK_GUARD).alias("radius"),
    )


def with_radius(edges: DataFrame, nodes: DataFrame, lookahead: float = 10.0) -> DataFrame:
    """Edges with the turning radius of their straightest turn, Infinity where there is none."""
    turns = network.best_turn(measured_turns(edges, nodes, lookahead))
    return network.edge_min_radius(edges, turns)
