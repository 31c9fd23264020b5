"""Exact top-k search by inner product over a pivot table.

With norms known, the inner product is (|q|^2 + |x|^2 - d^2) / 2, so a lower bound on the distance d bounds the score from
above; the triangle inequality gives one from each pivot p: d(q, x) >= |d(q, p) - d(x, p)|, and the largest is kept. The
distances of every row to the pivots are computed once. Rows go to blocks by nearest pivot (a full pivot's rows are
dealt over several blocks by hash), and two rounds follow: each query searches one block of its own pivot, then every
other block with its k-th best score so far. In a block, candidates are taken in the order of their bounds until the
next bound cannot reach the k-th best score; ties in score count, so stopping is exact. Scores are integers.

Scale: pivots are a bounded sample; they and their cells' bounds are the only broadcasts. Queries are a stated set; whole
cells are ruled out for a query by its distances alone, and only ids of the (query, block) pairs that are left travel until
each block gets its queries' vectors. No task holds more than one block (BLOCK_ROWS on average) and QUERY_ROWS queries. Inner products in many dimensions can
leave bounds weak: then all blocks are read in full, which is still exact.

Scores are exact whatever the components' size: 64-bit sums where they can't overflow, whole numbers of any length
elsewhere. Vectors with components of 2^40 or more after scaling have no pivot (distances would be rounded too far): they
have blocks of their own, and bounds are not used on them. A score beyond 64 bits ranks by its true value and is
returned as the nearest 64-bit number.

Defined cases. Vectors that are null or empty or hold null or non-finite components take no part. Vectors meet those of
their own dimension only. Rows with the query's own id are not its candidates; rows of equal id are candidates each, and
are dealt over blocks by their place, as all rows are. A null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.base import materialize, table

#: Documented bounds: pivots, rows from which they are chosen, rows in a block, queries in a block, candidates a step.
PIVOTS, PIVOT_SAMPLE, BLOCK_ROWS, QUERY_ROWS, STEP = 24, 2000, 8192, 4096, 256
#: Components from which a vector has no pivot, and the cell of such vectors.
LARGE, NO_PIVOT = float(1 << 40), -1
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def sound_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key (long), x (array of double); rows that can take part only."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    return df.filter(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def scale(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles: exact, as 256 is a power of two (numbers that would overflow are taken back in exact_row)."""
    with np.errstate(over="ignore"):
        return np.floor(256 * x)


def exact_row(x: np.ndarray) -> list[int]:
    """floor(256 x) as whole numbers of any length."""
    return [int(np.floor(256 * c)) if abs(c) < 2.0**900 else 256 * int(c) for c in x.tolist()]


def wide_key(n: int) -> str:
    """Text that sorts as whole numbers beyond 64 bits do; empty for those within."""
    if LEAST <= n <= MOST:
        return ""
    digits = str(abs(n))
    if n > 0:
        return f"1{len(digits):04}{digits}"
    return f"0{9999 - len(digits):04}{''.join(str(9 - int(d)) for d in digits)}"


def choose_pivots(vectors: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """For each dimension, pivots far from each other (greedily), from a bounded sample: the rows of least id hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    out = {}
    for dim in sorted({len(r.x) for r in rows}):
        points = scale(np.array([r.x for r in rows if len(r.x) == dim], float))
        points = points[np.abs(points).max(1) < LARGE]
        if not len(points):
            continue
        chosen = [int(((points - points.mean(0)) ** 2).sum(1).argmax())]
        least = ((points - points[chosen[0]]) ** 2).sum(1)
        while len(chosen) < pivots and least.max() > 0:
            chosen.append(int(least.argmax()))
            least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(1))
        out[dim] = points[chosen]
    return out


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of scaled points to the pivots."""
    gaps = (points**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * points @ centres.T
    return np.sqrt(np.maximum(gaps, 0))


def with_pivot_distances(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add dim, cell (nearest pivot), norm (squared), far (distances to all pivots of its dimension) and place (number of the row)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = TaskContext.get().partitionId() << 33
        for part in batches:
            for dim, rows in part.groupby(part["x"].map(len)):
                points = scale(np.stack(rows["x"].to_numpy()).astype(float))
                large = np.abs(points).max(1) >= LARGE
                points[large] = 0
                centres = shared.value.get(dim, np.zeros((1, dim)))
                far = distances(points, centres)
                cell = np.where(large, NO_PIVOT, far.argmin(1)).astype(np.int32)
                yield pd.DataFrame({
                    "vec_id": rows["vec_id"].to_numpy(), "x": rows["x"].to_numpy(), "dim": np.int32(dim), "cell": cell, "norm": (points**2).sum(1),
                    "far": list(far), "place": np.arange(place, place + len(rows)),
                })
                place += len(rows)

    return vectors.mapInPandas(run, "vec_id long, x array<double>, dim int, cell int, norm double, far array<double>, place long")


def scores(q: np.ndarray, block: dict, step: np.ndarray) -> list[int]:
    """Exact inner products of floor(256 q) with the rows `step` of a block (x; points: scaled; most: largest component)."""
    point = scale(q)
    with np.errstate(over="ignore"):
        size = np.abs(point).max() * block["most"][step] * len(q)
    if size.max() < 2.0**53:  # whole numbers that doubles hold
        return (block["points"][step] @ point).astype(np.int64).tolist()
    out, safe = np.empty(len(step), object), size < 2.0**62
    if safe.any():
        out[safe] = (block["points"][step[safe]].astype(np.int64) @ point.astype(np.int64)).tolist()
    exact = exact_row(q)
    for i in np.flatnonzero(~safe):
        out[i] = sum(a * b for a, b in zip(exact, exact_row(block["x"][step[i]]), strict=True))
    return out.tolist()


def _search(q: np.ndarray, q_far: np.ndarray, q_norm: float, q_id: int, bounded: bool, block: dict, k: int, floor: float) -> list[tuple[int, int]]:
    """(-score, id) of the k best in the block that reach floor; candidates in the order of their bounds, if these hold."""
    ids = block["ids"]
    if bounded:
        least = np.abs(block["far"] - q_far).max(1)
        slack = 1e-6 * (1 + least + np.sqrt(block["norms"]) + q_norm**0.5)  # rounding of the distances
        bound = (q_norm + block["norms"] - np.maximum(least - slack, 0) ** 2) / 2 + 1e-9 * (q_norm + block["norms"]) + 1
    else:
        bound = np.full(len(ids), np.inf)
    mine = np.flatnonzero((bound >= floor) & (ids != q_id))
    mine = mine[np.argsort(-bound[mine], kind="stable")]
    best: list[tuple[int, int]] = []
    for at in range(0, len(mine), STEP):
        step = mine[at : at + STEP]
        if len(best) == k and bound[step[0]] < -best[-1][0]:
            break
        found = scores(q, block, step)
        keep = -best[-1][0] if len(best) == k else floor
        best = sorted(best + [(-s, i) for s, i in zip(found, ids[step].tolist(), strict=True) if s >= keep])[:k]
    return best


BLOCK = ["dim", "cell", "part", "slice"]


def _round(blocked: DataFrame, queries: DataFrame, vectors: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """Each query against the blocks it names: query_id, vec_id, score, wide; k rows at most for each block.

    queries: vec_id, dim, cell, part, floor; vectors: vec_id, x of the queries. A block is copied only as often as its own
    queries fill slices of QUERY_ROWS, and not at all where none asks for it. Rows and queries travel as plain vectors:
    distances to the pivots are worked out again in the block.
    """
    shared = blocked.sparkSession.sparkContext.broadcast(pivots)

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, str]] = []
        if len(rows) and len(asked):
            x, dim, cell = np.stack(rows["x"].to_numpy()), int(rows["dim"].iloc[0]), int(rows["cell"].iloc[0])
            centres, points = shared.value.get(dim, np.zeros((1, dim))), scale(x)
            block = {"x": x, "points": points, "ids": rows["vec_id"].to_numpy(), "most": np.abs(points).max(1)}
            if cell != NO_PIVOT:
                block |= {"far": distances(points, centres), "norms": (points**2).sum(1)}
            for q in asked.itertuples(index=False):
                vector = np.asarray(q.x, float)
                point = scale(vector)[None, :]
                bounded = cell != NO_PIVOT and bool(np.abs(point).max() < LARGE)
                q_far, q_norm = (distances(point, centres)[0], float((point**2).sum())) if bounded else (centres[0], 0.0)
                found = _search(vector, q_far, q_norm, q.vec_id, bounded, block, k, -np.inf if pd.isna(q.floor) else q.floor)
                out += [(q.vec_id, i, max(LEAST, min(MOST, -s)), wide_key(-s)) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "wide"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "wide": "str"})

    needed = queries.groupBy("dim", "cell", "part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("slices"))
    rows = blocked.select("vec_id", "x", "dim", "cell", "part").join(needed, ["dim", "cell", "part"])
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    asked = queries.join(needed, ["dim", "cell", "part"]).join(vectors.select("vec_id", "x"), "vec_id")
    dealt = asked.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("slices")).cast("int"))
    dealt = dealt.select(*[F.col(c).alias(c) for c in ("vec_id", "x", "dim", "cell", "part", "floor", "slice")])  # attributes of its own: both sides come from one table
    return rows.groupBy(*BLOCK).cogroup(dealt.groupBy(*BLOCK)).applyInPandas(run, "query_id long, vec_id long, score long, wide string")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("wide").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows but its own, ties to the smaller id.

    vectors: as sound_vectors gives them. The table with its pivot distances is written once and read by both rounds.
    Of query rows of equal id, that of the least vector asks.
    """
    chosen = choose_pivots(vectors, pivots, PIVOT_SAMPLE)
    tabled = materialize(with_pivot_distances(vectors, chosen), "pivot-table")
    counted = tabled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    sizes = F.broadcast(counted)  # a row for each pivot at most, and one
    blocked = tabled.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int")).drop("parts")
    asking = tabled.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("x", "far", "dim", "cell", "norm")).alias("q")).select("vec_id", "q.*")
    asking = materialize(asking, "queries")
    home = asking.drop("x").join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    first = home.select("vec_id", "dim", "cell", "part", F.lit(None).cast("double").alias("floor"))
    one = materialize(_round(blocked, first, asking, chosen, k), "first-round")
    # above 64 bits the floor is that bound, which such scores reach; below them there is none
    floors = one.groupBy("query_id").agg(F.when((F.count("*") >= k) & (F.min("score") > LEAST), F.min("score").cast("double")).alias("floor"))
    floors = floors.withColumn("floor", F.col("floor") - F.abs("floor") * 1e-15)  # the double may lie above the whole number
    # a row for each pivot at most, and one: parts of a cell are dealt by hash, so the cell's bounds are theirs
    cells = F.broadcast(tabled.groupBy("dim", F.col("cell").alias("b_cell")).agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias("parts"),
        F.max("norm").alias("most"),
        F.array(*[F.min(F.get("far", F.lit(i))) for i in range(pivots)]).alias("lo"),
        F.array(*[F.max(F.get("far", F.lit(i))) for i in range(pivots)]).alias("hi"),
    ))
    outside = F.zip_with(F.zip_with("lo", "far", lambda lo, f: lo - f), F.zip_with("hi", "far", lambda hi, f: f - hi), lambda a, b: F.greatest(a, b))
    least = F.array_max(F.concat(F.array(F.lit(0.0)), F.filter(outside, lambda g: g.isNotNull())))
    slack = 1e-6 * (1 + least + F.sqrt("most") + F.sqrt("norm"))
    bound = (F.col("norm") + F.col("most") - F.pow(F.greatest(least - slack, F.lit(0.0)), 2)) / 2 + 1e-9 * (F.col("norm") + F.col("most")) + 1
    unbounded = (F.col("b_cell") == NO_PIVOT) | (F.col("cell") == NO_PIVOT) | F.col("floor").isNull()
    reached = home.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").join(cells, "dim").filter(unbounded | (bound >= F.col("floor")))
    parts = reached.select("vec_id", "dim", "floor", "b_cell", F.when(F.col("cell") == F.col("b_cell"), F.col("part")).otherwise(-1).alias("done"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rest = parts.filter(F.col("part") != F.col("done")).select("vec_id", "dim", F.col("b_cell").alias("cell"), "part", "floor")
    two = _round(blocked, rest, asking, chosen, k)
    return best_of(one.unionByName(two), k)


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every embedding whose id is divisible by 50 with all other rows."""
    vectors = sound_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


OP6_SQL = """
with sound as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::hugeint) as v from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from sound q join sound c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5"""
