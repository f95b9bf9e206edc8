"""The second classifier: a document against a blended taxonomy and the centre of the domain, down to a decision with its reasons.

A document's scores with all nodes are taken in the task that holds it, and only the best leave it: one row a document,
no shuffle. See ``scoring`` for vectors and nodes without a direction, ties and taxonomies of more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.normalize import fixed
from corpusloom.functions.similarity import unit
from corpusloom.operators import scoring
from corpusloom.operators.taxonomy import centroids, hierarchical_centroids
from corpusloom.workspace import materialise

# The phrases whose mean is the centre of the domain, and the limits of the decision.
DOMAIN_PHRASES = [
    "neuroarchitecture", "cognitive architecture", "environmental psychology", "built environment and human behavior", "architecture and wellbeing", "building design affects cognition",
    "space affects mood and emotion", "indoor environment quality and health", "biophilic design", "evidence-based design", "healing environments", "architecture neuroscience", "spatial cognition",
    "environmental factors human outcomes",
]
REJECT, ACCEPT, STRONG_L2, STRONG_L3 = 0.3, 0.5, 0.7, 0.65

_LISTS = ["top_nodes", "facets", "l2__", "l3__"]
_BEST = T.ArrayType(T.StructType([T.StructField("facet_id", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("score", T.DoubleType())]))


def node_model(nodes: DataFrame, seeds: DataFrame, *, levels: int = 3) -> DataFrame:
    """(node_id, facet_id, level, centroid). ``seeds``: node_id, embedding of every seed phrase and exemplar.

    The mean of a node's vectors as it is (not at unit length) is blended with the parent's centre; a node without any takes its parent's, and
    one whose ancestors have none either has no centre and is left out.
    """
    level = nodes.select("node_id", "level")
    own = centroids(seeds, "node_id", normalise=False).join(level, "node_id").select("node_id", F.when(F.col("level") == 1, unit(F.col("centroid"))).otherwise(F.col("centroid")).alias("centroid"))
    return hierarchical_centroids(nodes, own, levels=levels).join(nodes.select("node_id", "facet_id", "level"), "node_id").select("node_id", "facet_id", "level", "centroid")


def _ranked(best: Column) -> Column:
    """Best first, ties by node_id."""
    before = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["node_id"] < b["node_id"]))
    return F.array_sort(best, lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0))


def _best(table: pa.Table, scores: np.ndarray, groups: list[np.ndarray], k: int) -> pa.ListArray:
    """For every row the ``k`` best nodes of each group of columns, which lie by node_id."""
    picked = [g[np.argsort(-scores[:, g], axis=1, kind="stable")[:, :k]] for g in groups if len(g)]
    at = np.hstack(picked) if picked else np.zeros((len(scores), 0), np.int64)
    flat = pa.array(at.ravel())
    text = lambda c: table.column(c).combine_chunks().cast(pa.string()).take(flat)
    items = pa.StructArray.from_arrays([text("facet_id"), text("node_id"), pa.array(np.take_along_axis(scores, at, 1).ravel())], names=["facet_id", "node_id", "score"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * at.shape[1], pa.int32()), items)


def classify(vectors: DataFrame, nodes: DataFrame, domain: list[float], *, id_col: str, embedding: str = "embedding", top: int = 10, per_facet: int = 3, reject: float = REJECT, accept: float = ACCEPT, strong_l2: float = STRONG_L2, strong_l3: float = STRONG_L3, node_bytes: int = scoring.NODE_BYTES) -> DataFrame:
    """A row for every vector: id, domain_score, decision, reasons, top_nodes (the ``top`` best), facets (the ``per_facet`` best of every facet, by facet and rank).

    Scores with nodes are clipped at 0, the score with ``domain`` is not. Below ``reject`` of the domain: reject; a node of level 3, else of level 2, that is strong
    enough: send_to_eater; else review. Without nodes there is no row.
    """
    centre = scoring.matrix(pa.array([domain], pa.list_(pa.float64())), len(domain))[0]
    model = scoring.measured(nodes, node_bytes=node_bytes)
    rows, key = vectors.select(id_col, embedding), id_col
    if model.blocks > 1:  # rows that share an id are told apart while their blocks come together
        rows, key = materialise(rows.withColumn("row__", F.monotonically_increasing_id()), "classified"), "row__"
    schema = T.StructType([rows.schema[key], T.StructField("domain_score", T.DoubleType()), *(T.StructField(n, _BEST) for n in _LISTS)])
    names = schema.names

    def scored(ids: pa.Array, x: np.ndarray, table: pa.Table, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(matrix):
            return
        facet, level = np.array(table.column("facet_id").cast(pa.string()).to_pylist(), object), np.array(table.column("level").to_pylist(), float)
        by_facet = [np.flatnonzero(facet == f) for f in sorted({f for f in facet if f is not None})]
        groups = [([np.arange(len(matrix))], top), (by_facet, per_facet), ([np.flatnonzero(level == 2)], 3), ([np.flatnonzero(level == 3)], 3)]
        near = np.round(x @ centre, 12) + 0.0 if x.shape[1] == len(centre) else np.zeros(len(x))
        for first, scores in scoring.products(x, matrix, clip=True):
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(scores)), pa.array(near[first : first + len(scores)]), *(_best(table, scores, g, k) for g, k in groups)], names=names)

    out = scoring.each_block(rows, model, id_col=key, embedding=embedding, task=scored, schema=schema)
    if model.blocks > 1:
        met = out.groupBy(key).agg(F.first("domain_score").alias("domain_score"), *(_ranked(F.flatten(F.collect_list(n))).alias(n) for n in _LISTS))
        first_of = lambda n, k: F.slice(F.col(n), 1, k).alias(n)
        facets = F.flatten(F.transform(F.array_sort(F.array_distinct(F.transform("facets", lambda b: b["facet_id"]))), lambda f: F.slice(F.filter("facets", lambda b: b["facet_id"] == f), 1, per_facet)))
        met = met.select(key, "domain_score", first_of("top_nodes", top), facets.alias("facets"), first_of("l2__", 3), first_of("l3__", 3))
        out = rows.select(key, id_col).join(met, key)
    strong2, strong3 = F.filter("l2__", lambda b: b["score"] >= strong_l2), F.filter("l3__", lambda b: b["score"] >= strong_l3)
    low, any2, any3 = F.col("domain_score") < reject, F.size(strong2) > 0, F.size(strong3) > 0
    listed = lambda name, best: F.concat(F.lit(f"Strong {name} matches: ['"), F.array_join(F.transform(best, lambda b: F.format_string("%s:%s", b["node_id"], fixed(b["score"]))), "', '"), F.lit("']"))
    said = lambda text: F.format_string(text + ": %s", fixed(F.col("domain_score")))
    why = F.when(any3, listed("L3", strong3)).when(any2, listed("L2", strong2)).when(F.col("domain_score") >= accept, "In domain but no strong facet matches").otherwise(said("Marginal domain score"))
    reasons = F.when(low, F.array(said("Low domain relevance"))).otherwise(F.array(said("Domain score"), why))
    return out.select(id_col, "domain_score", F.when(low, "reject").when(any2 | any3, "send_to_eater").otherwise("review").alias("decision"), reasons.alias("reasons"), "top_nodes", "facets")


def stored(classified: DataFrame, id_col: str, *, least: float = 0.3) -> DataFrame:
    """(id, node_id, score) of the best nodes that are kept with a document: ``least`` or more."""
    return classified.select(id_col, F.explode("top_nodes").alias("b")).where(F.col("b.score") >= least).select(id_col, "b.node_id", "b.score")
