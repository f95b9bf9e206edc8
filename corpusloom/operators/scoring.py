"""Vectors against the nodes of a taxonomy, as matrix products of Arrow batches.

A taxonomy is a model of bounded size, measured before it is sent: up to ``NODE_BYTES`` it goes to every task once and
vectors are scored where they are, without a shuffle. A larger one is cut into blocks that meet tiles of the vectors by an
equi-join on (block, tile), so that a task holds one of each.

Defined results: a vector that is null, zero, of another length than the nodes' or with an element that is no finite number
scores 0 with every node, and so does such a node; scores are rounded to 12 digits, so that equal nodes tie wherever
they stand; ties rank by node_id; rows that share an id are rows of their own. Without nodes nothing is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.operators.sized import value_bytes
from corpusloom.workspace import materialise

#: Bytes of nodes that are sent to every task, at most; scores that a task holds at once, at most.
NODE_BYTES, HELD = 64 << 20, 1 << 21
_NODE = ["node_id", "facet_id", "level", "centroid"]


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors at unit length; those without one are zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dim))
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    if dim and len(column):
        out[good.to_numpy(zero_copy_only=False)] = column.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    out[~np.isfinite(out).all(axis=1)] = 0
    size = np.linalg.norm(out, axis=1)
    return out / np.where(size > 0, size, 1)[:, None]


def products(x: np.ndarray, nodes: np.ndarray, *, clip: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores of some rows with all nodes)."""
    step = max(1, HELD // max(1, len(nodes)))
    for i in range(0, len(x), step):
        scores = np.round(x[i : i + step] @ nodes.T, 12) + 0.0
        yield i, np.maximum(scores, 0.0) if clip else scores


@dataclass
class Model:
    """Nodes as a written table, the length of their vectors, and the number of blocks they are cut into."""

    nodes: DataFrame
    dim: int
    blocks: int
    block_bytes: int


def measured(nodes: DataFrame, *, node_bytes: int = NODE_BYTES) -> Model:
    nodes = materialise(nodes.select(*_NODE), "nodes")
    width = sum(value_bytes(F.col(f.name), f.dataType) for f in nodes.schema.fields)
    m = nodes.agg(F.sum(width).alias("bytes"), F.max(F.size("centroid")).alias("dim")).first()
    return Model(nodes, max(0, m["dim"] or 0), max(1, -(-(m["bytes"] or 0) // node_bytes)), node_bytes)


def each_block(vectors: DataFrame, model: Model, *, id_col: str, embedding: str, task: Callable[[pa.Array, np.ndarray, pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``task`` of (ids, vectors, nodes, node vectors) for all rows and all blocks. Nodes come by node_id."""
    rows, nodes, dim = vectors.select(F.col(id_col).alias("id__"), F.col(embedding).alias("v__")), model.nodes, model.dim
    ordered = lambda table: table.sort_by([("node_id", "ascending")])
    if model.blocks == 1:
        table = ordered(nodes.toArrow())
        sent = rows.sparkSession.sparkContext.broadcast((table.select(_NODE[:3]), matrix(table.column("centroid"), dim)))

        def here(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                yield from task(part.column(0), matrix(part.column(1), dim), *sent.value)

        return rows.mapInArrow(here, schema)

    tiles = max(1, -(-rows.count() * (dim * 8 + 64) // model.block_bytes))
    left = rows.withColumns({"t__": F.pmod(F.xxhash64("id__", "v__"), F.lit(tiles)), "b__": F.explode(F.sequence(F.lit(0), F.lit(model.blocks - 1)))})
    right = nodes.withColumns({"b__": F.pmod(F.xxhash64("node_id"), F.lit(model.blocks)).cast("int"), "t__": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))})
    empty = to_arrow_schema(schema).empty_table()

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return empty
        b = ordered(b)
        found = list(task(a.column("id__").combine_chunks(), matrix(a.column("v__"), dim), b.select(_NODE[:3]), matrix(b.column("centroid"), dim)))
        return pa.Table.from_batches(found) if found else empty

    return left.groupBy("b__", "t__").cogroup(right.groupBy("b__", "t__")).applyInArrow(met, schema)


def pairs(vectors: DataFrame, nodes: DataFrame, *, id_col: str, embedding: str = "embedding", least: float, clip: bool = False, node_bytes: int = NODE_BYTES) -> DataFrame:
    """(id, node_id, facet_id, level, score) of every vector and node at ``least`` or more."""
    kinds = nodes.select(*_NODE[:3]).schema.fields
    schema = T.StructType([vectors.schema[id_col], *kinds, T.StructField("score", T.DoubleType())])
    names = schema.names

    def found(ids: pa.Array, x: np.ndarray, table: pa.Table, model: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = [table.column(c).combine_chunks() for c in _NODE[:3]]
        for first, scores in products(x, model, clip=clip):
            i, j = np.nonzero(scores >= least)
            at = pa.array(j)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + i)), *(c.take(at) for c in own), pa.array(scores[i, j])], names=names)

    return each_block(vectors, measured(nodes, node_bytes=node_bytes), id_col=id_col, embedding=embedding, task=found, schema=schema)
