"""Exact search among vectors by cells: an inverted file whose cells are left out by the triangle inequality.

Vectors are taken at unit length, so a cosine s is a distance sqrt(2 - 2 s). Coarse centres are fitted on a bounded sample; every
row goes to its nearest centre, and rows of a cell lie packed in tiles of bounded size. For a query q, its nearest centre h
and a cell of centre c whose rows are between ``near`` and ``far`` from c, no row of the cell is closer to q than

    max( d(q,c) - far,  near - d(q,c),  (d(q,c)^2 - d(q,h)^2) / (2 d(c,h)) )

(the last: its rows are nearer to c than to h). A search reads the home cells first; the k-th best found there bounds the
rest. Range pairs use the threshold. What is left out cannot matter, so results are those of a full scan; how many cells
that is depends on the data: none where vectors are spread evenly in many dimensions.

Defined results: rows with a null or zero vector are not indexed, and queries with one find nothing; ties rank by id;
rows that share an id are rows of their own. An empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.workspace import materialise

#: Rows that the centres are fitted on, at most; cells, at most; rows of a tile and queries of a block, about.
SAMPLE, CELLS, TILE, BLOCK = 16_384, 1024, 2048, 512
_SLACK = 1e-9
#: Blocks with their tiles that a Python worker gets at once; a pair is 1.3 MB at 64 dimensions.
PAIRS = 8
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``PAIRS`` rows for what runs inside, which has to be written there."""
    before = spark.conf.get(_ROWS_KEY)
    spark.conf.set(_ROWS_KEY, str(PAIRS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_KEY, before)


@dataclass
class VectorIndex:
    """``tiles``: cell, ids, marks (what pairs must differ in), vectors (packed); ``centres`` with the least and largest distance of their rows."""

    tiles: DataFrame
    centres: Broadcast
    id_type: T.DataType
    rows: int


def _unit(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length, and which of them have one."""
    values = column.to_pylist()
    dim = dim or next((len(v) for v in values if v), 0)
    x = np.array([v if v and len(v) == dim and None not in v else [0.0] * dim for v in values], np.float64).reshape(len(values), dim)
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1)[:, None], size > 0


def fit_centres(sample: np.ndarray, k: int, *, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from a fixed draw of rows; a centre without rows stays where it is."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        count = np.bincount(own, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0))


def build(df: DataFrame, *, id_col: str, embedding: str = "embedding", differ: str | None = None, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(embedding).alias("v"), (F.col(differ).cast("string") if differ else F.lit(None).cast("string")).alias("mark"))
    some = rows.where("v is not null").orderBy(F.xxhash64("id")).select("v").limit(sample).toArrow().column(0).combine_chunks()
    x, good = _unit(some)
    x = x[good]
    n = rows.count()
    centres = fit_centres(x, min(cells or CELLS, max(1, int(n**0.5)), len(x))) if len(x) else np.zeros((0, 0))
    shared, dim = spark.sparkContext.broadcast(centres), centres.shape[1]
    schema = T.StructType([T.StructField("id", kind), T.StructField("mark", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType()), T.StructField("v", T.BinaryType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows if dim else 0, 1024):
                part = batch.slice(lo, 1024)
                x, good = _unit(part.column("v"), dim)
                part, x = part.filter(pa.array(good)), x[good]
                d = distances(x, shared.value)
                cell = np.argmin(d, axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), pa.array([r.tobytes() for r in x], pa.binary())], names=schema.names)

    placed = materialise(rows.mapInArrow(assign, schema), "placed")
    spread = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("near"), F.max("d").alias("far")).collect()}  # a row a cell
    limits = np.array([[spread[c]["near"], spread[c]["far"]] if c in spread else [np.inf, -np.inf] for c in range(len(centres))]).reshape(-1, 2)
    tiles = F.create_map(*[F.lit(x) for c, r in spread.items() for x in (c, -(-r["n"] // TILE))]) if spread else F.create_map().cast("map<int,int>")
    dealt = placed.withColumn("tile", F.pmod(F.xxhash64("id", "v"), tiles[F.col("cell")]))
    packed = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("marks", T.ArrayType(T.StringType())), T.StructField("vectors", T.BinaryType())])

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        return pa.table({"cell": t.column("cell").slice(0, 1), "ids": pa.array([t.column("id").to_pylist()], pa.list_(t.schema.field("id").type)), "marks": pa.array([t.column("mark").to_pylist()], pa.list_(pa.string())), "vectors": pa.array([b"".join(t.column("v").to_pylist())], pa.binary())})

    table = materialise(dealt.groupBy("cell", "tile").applyInArrow(pack, packed), "tiles")
    return VectorIndex(table, spark.sparkContext.broadcast((centres, limits)), kind, n)


def bounds(x: np.ndarray, centres: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``x`` its home cell, and the least distance at which each cell can hold a row."""
    d = distances(x, centres)
    home = np.argmin(d, axis=1)
    between = distances(centres, centres)
    at_home = d[np.arange(len(x)), home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d**2 - at_home[:, None] ** 2) / (2 * between[home])
    plane[~np.isfinite(plane)] = 0
    return home, np.maximum(np.maximum(d - limits[:, 1], limits[:, 0] - d), plane)


_VISITS = "cell int, block int, qs array<long>, names array<{}>, floors array<double>, marks array<string>, vectors binary"


def _visits(index: VectorIndex, queries: DataFrame, *, home: bool | None) -> DataFrame:
    """Blocks of queries by the cells they go to: home cells (True), the others that a query's ``floor`` leaves open (False), or both (None).

    ``queries``: q long, id, v (packed, unit length), mark, floor (the least cosine that is still of interest).
    """
    shared, kind = index.centres, queries.schema["id"].dataType

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, limits = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(part.num_rows, -1)
                at, least = bounds(x, centres, limits)
                reach = np.sqrt(np.maximum(2 - 2 * np.array(part.column("floor").to_pylist(), np.float64), 0))
                open_ = (least <= reach[:, None] + _SLACK) & np.isfinite(limits[:, 0])
                own = np.zeros_like(open_)
                own[np.arange(len(x)), at] = np.isfinite(limits[at, 0])
                row, cell = np.nonzero(own if home else open_ & ~own if home is False else open_)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(part.column(n).take(pa.array(row)) for n in ("q", "id", "floor", "mark", "v"))], names=["cell", "q", "id", "floor", "mark", "v"])

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        one = lambda c, kind: pa.array([t.column(c).to_pylist()], pa.list_(kind))
        return pa.table({"cell": t.column("cell").slice(0, 1), "block": t.column("block").slice(0, 1), "qs": one("q", pa.int64()), "names": one("id", t.schema.field("id").type), "floors": one("floor", pa.float64()), "marks": one("mark", pa.string()), "vectors": pa.array([b"".join(t.column("v").to_pylist())], pa.binary())})

    each = queries.select("q", "id", "v", "mark", "floor").mapInArrow(go, f"cell int, q long, id {kind.simpleString()}, floor double, mark string, v binary")
    blocks = max(1, -(-queries.count() // BLOCK))  # no cell has more than all queries
    return each.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).groupBy("cell", "block").applyInArrow(pack, _VISITS.format(kind.simpleString()))


def _met(index: VectorIndex, visits: DataFrame, *, k: int | None, differ: bool, ordered: bool = False) -> DataFrame:
    """(q, id, score): the rows of the visited cells at a query's floor or above, at most ``k`` a query and tile.

    ``ordered``: (id_a, id, score) with the query's own id for q, of these the rows with id_a < id; they leave their task as they are to be.
    """
    kind = index.id_type
    schema = T.StructType([T.StructField("id_a", kind) if ordered else T.StructField("q", T.LongType()), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    tiles = index.tiles.select(F.col("cell").alias("of"), "ids", F.col("marks").alias("their"), F.col("vectors").alias("rows"))
    joined = visits.join(tiles, F.col("cell") == F.col("of")).select("qs", *(["names"] if ordered else []), "floors", "marks", "vectors", "ids", "their", "rows")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(n, 1) for b in batches for n in range(b.num_rows)):
            of = {n: batch.column(n)[0] for n in batch.schema.names}
            qs, ids = of["qs"].values, of["ids"].values
            x, y = (np.frombuffer(of[n].as_py(), np.float64).reshape(len(v), -1) for n, v in (("vectors", qs), ("rows", ids)))
            scores = x @ y.T
            keep = scores >= of["floors"].values.to_numpy()[:, None] - _SLACK
            if differ:
                keep &= np.array(of["marks"].values.to_pylist(), object)[:, None] != np.array(of["their"].values.to_pylist(), object)[None, :]
            if k is not None and len(ids) > k:
                order = np.argpartition(-np.where(keep, scores, -2), k - 1, axis=1)[:, :k]
                least = np.take_along_axis(np.where(keep, scores, -2), order, 1).min(1)
                keep &= scores >= least[:, None] - _SLACK  # ties with the last stay, they rank by id
            i, j = np.nonzero(keep)
            asking = of["names"].values if ordered else qs
            found = pa.RecordBatch.from_arrays([asking.take(pa.array(i)), ids.take(pa.array(j)), pa.array(scores[i, j])], names=schema.names)
            yield found.filter(pc.less(found.column(0), found.column(1))) if ordered else found

    return joined.mapInArrow(product, schema)


def _queries(df: DataFrame, id_col: str, embedding: str, mark: str | None, dim: int) -> DataFrame:
    """(q, id, mark, v), written; ``q`` numbers the rows."""
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", kind), T.StructField("mark", T.StringType()), T.StructField("v", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _unit(batch.column("v"), dim)
            part = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([part.column("q"), part.column("id"), part.column("mark"), pa.array([r.tobytes() for r in x[good]], pa.binary())], names=schema.names)

    rows = df.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("id"), (F.col(mark).cast("string") if mark else F.lit(None).cast("string")).alias("mark"), F.col(embedding).alias("v"))
    return materialise(rows.mapInArrow(pack, schema), "queries")


def search(index: VectorIndex, queries: DataFrame, *, k: int = 10, least: float = -1.0, id_col: str, embedding: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, id, score, cells_read): the k rows of largest cosine at ``least`` or more, ties by id, for every query row.

    ``exclude_self`` leaves rows with the query's own id out.
    """
    dim = index.centres.value[0].shape[1]
    asked = _queries(queries, id_col, embedding, None, dim) if dim else None
    if asked is None:
        return queries.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField("id", index.id_type), T.StructField("score", T.DoubleType()), T.StructField("cells_read", T.LongType())]))
    more = k + 1 if exclude_self else k
    own = materialise(_visits(index, asked.withColumn("floor", F.lit(float(least))), home=True), "home-visits")
    with _few_at_once(queries.sparkSession):
        home = materialise(_met(index, own, k=more, differ=False), "home")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    floors = home.withColumn("nth", nth).where(F.col("nth") == more).select(F.col("q").alias("of"), F.col("score").alias("floor"))
    bounded = asked.join(floors, F.col("q") == F.col("of"), "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(float(least))), F.lit(float(least)))).drop("of")
    rest = materialise(_visits(index, bounded, home=False), "visits")
    with _few_at_once(queries.sparkSession):
        far = materialise(_met(index, rest, k=more, differ=False), "far")
    read = rest.select(F.explode("qs").alias("q")).groupBy("q").agg(F.count("*").alias("cells"))
    named = home.unionAll(far).join(asked.select("q", F.col("id").alias("query_id")), "q")
    named = named.where(~F.col("id").eqNullSafe(F.col("query_id"))) if exclude_self else named
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 12)), "id"))
    top = named.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(read, "q", "left").select("query_id", "rank", "id", "score", (F.coalesce("cells", F.lit(0)) + 1).alias("cells_read"))


def range_pairs(index: VectorIndex, df: DataFrame, *, least: float, id_col: str, embedding: str = "embedding", differ: str | None = None) -> DataFrame:
    """(id_a, id_b, score): the pairs of indexed rows at cosine ``least`` or more, id_a < id_b, whose ``differ`` columns differ. Exact.

    ``df`` is the table that was indexed: each row visits the cells that can hold a partner.
    """
    dim = index.centres.value[0].shape[1]
    if not dim:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("id_a", index.id_type), T.StructField("id_b", index.id_type), T.StructField("score", T.DoubleType())]))
    asked = _queries(df, id_col, embedding, differ, dim)
    visits = _visits(index, asked.withColumn("floor", F.lit(float(least))), home=None)
    found = _met(index, visits, k=None, differ=differ is not None, ordered=True)
    return found.where(F.col("score") >= least).select("id_a", F.col("id").alias("id_b"), "score")


def products(index: VectorIndex, df: DataFrame, *, least: float, id_col: str, embedding: str = "embedding") -> DataFrame:
    """(cells, rows, products): what ``range_pairs`` multiplies, against rows times rows."""
    dim = index.centres.value[0].shape[1]
    visits = _visits(index, _queries(df, id_col, embedding, None, dim).withColumn("floor", F.lit(float(least))), home=None)
    sizes = index.tiles.groupBy(F.col("cell").alias("of")).agg(F.sum(F.size("ids")).alias("held"))
    return visits.join(sizes, F.col("cell") == F.col("of")).agg(F.countDistinct("cell").alias("cells"), F.lit(index.rows).alias("rows"), F.sum(F.size("qs") * F.col("held")).alias("products"))
