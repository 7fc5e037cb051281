"""Exact top-k search by inner product through a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, small_batches, store, table

#: Bounds are compared with this much slack, far more than the rounding of a distance.
SLACK = 1e-6


def quantise(rows: DataFrame, factor: int = 64) -> DataFrame:
    """vec_id, vec (the components floor(factor * x) as 8-byte integers) and norm2; only whole, finite vectors with an id."""
    small_batches(rows.sparkSession)

    def kernel(cols: dict):
        out: dict = {"vec_id": [], "vec": [], "norm2": []}
        for i, v in zip(cols["vec_id"], cols["embedding"], strict=True):
            if i is None or v is None or any(x is None for x in v):
                continue
            x = np.asarray(v, np.float64)
            if not np.isfinite(x).all():
                continue
            q = np.floor(factor * x).astype(np.int64)
            out["vec_id"].append(i)
            out["vec"].append(q.tobytes())
            out["norm2"].append(float((q.astype(np.float64) ** 2).sum()))
        yield out

    return arrow_map(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), kernel, "vec_id long, vec binary, norm2 double")


def _matrix(vecs, dim: int) -> np.ndarray:
    """A row for each vector; shorter ones are padded with zeros, which leaves inner products as they are."""
    out = np.zeros((len(vecs), dim), np.int64)
    for i, v in enumerate(vecs):
        out[i, : len(v) // 8] = np.frombuffer(v, np.int64)
    return out


class Pivots:
    """Vectors get one more component that makes all of them as long as the longest: then the nearest to a query (whose
    own is 0) has the largest inner product, |q-v|^2 = |q|^2 + longest^2 - 2 q.v, and the triangle inequality holds."""

    def __init__(self, sample: list[bytes], longest2: float, dim: int, n_pivots: int):
        self.longest2, self.dim = longest2, dim
        known = self.lift(_matrix(sample, dim))
        chosen = known[:1]
        while 0 < len(chosen) < min(n_pivots, len(known)):  # farthest first
            gap = np.min(self.distances(known, chosen), axis=1)
            if gap.max() <= SLACK:
                break
            chosen = np.vstack([chosen, known[gap.argmax()]])
        self.points = chosen

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.longest2 - (x * x).sum(1), 0))[:, None]])

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _products(queries: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles where they hold all sums, else through Python's integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vecs).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ vecs.astype(np.float64).T).astype(np.int64)
    return (queries.astype(object) @ vecs.astype(object).T).astype(np.int64)


def _search(queries: pd.DataFrame, cell: pd.DataFrame, dim: int, longest2: float, k: int, annulus: int) -> dict:
    """The k best rows of a cell for each query, given the scores that others have reached already."""
    cell = cell.sort_values("dist", kind="stable")
    vecs, ids, places, dist = _matrix(cell["vec"].tolist(), dim), cell["vec_id"].to_numpy(), cell["place"].to_numpy(), cell["dist"].to_numpy()
    q, q_ids, q_places, q_dist = _matrix(queries["vec"].tolist(), dim), queries["vec_id"].to_numpy(), queries["place"].to_numpy(), queries["dist"].to_numpy()
    floor = queries["floor"].to_numpy(np.float64)  # a score that k others reach; -inf if not known
    q_norm2 = (q.astype(np.float64) ** 2).sum(1)
    edges = np.arange(0, len(cell), annulus)
    low, high = dist[edges], dist[np.minimum(edges + annulus, len(cell)) - 1]
    # by the triangle inequality no row of the annulus is nearer to the query than this
    gap = np.maximum(0, np.maximum(low[None] - q_dist[:, None], q_dist[:, None] - high[None]))
    best = (q_norm2[:, None] + longest2 - gap**2) / 2  # the highest score that it allows
    order = np.argsort(gap, axis=1, kind="stable")
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for step in range(len(edges)):  # outwards, one annulus of each query at a time
        at = order[:, step]
        going = best[np.arange(len(q)), at] + SLACK * (1 + longest2) >= floor
        if not going.any():
            break
        for a in np.unique(at[going]):
            who = np.nonzero(going & (at == a))[0]
            rows_at = slice(edges[a], edges[a] + annulus)
            scores = _products(q[who], vecs[rows_at])
            own = places[rows_at][None] == q_places[who][:, None]
            i, j = np.nonzero((scores >= floor[who][:, None]) & ~own)
            rows.append((who[i], scores[i, j], ids[rows_at][j]))
        who, score, vec = (np.concatenate(x) for x in zip(*rows, strict=True))
        keep = np.lexsort((vec, -score, who))
        who, score, vec = who[keep], score[keep], vec[keep]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        full = rank == k - 1
        floor[who[full]] = np.maximum(floor[who[full]], score[full])
        rows = [(who[rank < k], score[rank < k], vec[rank < k])]
    who, score, vec = rows[0] if len(rows) == 1 else (np.concatenate(x) for x in zip(*rows, strict=True))
    return {"asked": q_places[who], "query_id": q_ids[who], "vec_id": vec, "score": score}


def top_k(rows: DataFrame, is_query, k: int = 20, n_pivots: int = 32, sample_rows: int = 2000, cell_rows: int = 8192, block_queries: int = 1024, annulus_rows: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product with each query row.

    Pivots come from a bounded sample (the sample_rows rows of smallest hash of vec_id); every row is keyed by its
    nearest pivot and its distance to it.  A cell holds the rows of a pivot; those of more than cell_rows rows are cut
    by a hash of vec_id, so that many like vectors don't meet in one task.  Queries first search their home cell, which
    gives them a score that k rows reach; then they go, in blocks of block_queries, to every cell that the triangle
    inequality doesn't exclude.  There, sorted annuli are searched outwards until it excludes the rest.

    Scores tie to the smaller vec_id.  Every query row is a query, and its own row is no candidate: rows of one vec_id
    are queries of their own, with k result rows each, and candidates for one another.  Vectors that are null or hold
    null or non-finite components, and rows without vec_id, take no part.  A shorter vector counts as padded with
    zeros.  Only vec_id and embedding are read, so that other columns may have any name.  An empty table gives an
    empty result.  is_query makes a condition of the column vec_id.
    """
    spark = rows.sparkSession
    vectors = store(quantise(rows).withColumn("place", F.monotonically_increasing_id()), "topk-vectors")
    size = vectors.agg(F.count("*").alias("n"), F.max("norm2").alias("longest2"), F.max(F.octet_length("vec")).alias("bytes")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not size.n:
        return empty
    dim, longest2 = max(1, size.bytes // 8), size.longest2
    sample = [bytes(r.vec) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec").collect()]
    pivots = Pivots(sample, longest2, dim, n_pivots)

    def key(cols: dict):
        if cols["vec_id"]:
            away = pivots.distances(pivots.lift(_matrix(cols["vec"], dim)), pivots.points)
            near = away.argmin(axis=1)
            yield {"pivot": near, "dist": away[np.arange(len(near)), near], **{c: cols[c] for c in ("place", "vec_id", "vec")}}

    keyed = store(arrow_map(vectors, key, "pivot int, dist double, place long, vec_id long, vec binary"), "topk-index")
    cells = {r.pivot: (-(-r.n // cell_rows), r.low, r.high) for r in keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()}
    parts = F.create_map(*(F.lit(x) for p, (n, *_) in cells.items() for x in (p, n)))
    indexed = keyed.withColumn("part", F.pmod(F.xxhash64("place"), parts[F.col("pivot")].cast("long")).cast("int"))
    asked = keyed.where(is_query(F.col("vec_id"))).select("place", "vec_id", "vec")
    n_blocks = max(1, -(-asked.count() // block_queries))

    def routes(cols: dict, home: bool):
        """The cells that a query must see: its home cell, or all others that its floor doesn't exclude."""
        if not cols["vec_id"]:
            return
        q = _matrix(cols["vec"], dim)
        away = pivots.distances(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]), pivots.points)
        norm2 = (q.astype(np.float64) ** 2).sum(1)
        out: dict = {c: [] for c in ("pivot", "part", "place", "vec_id", "vec", "dist", "floor")}
        for i, vec_id in enumerate(cols["vec_id"]):
            floor = -np.inf if home or cols["floor"][i] is None else float(cols["floor"][i])
            nearest = min(cells, key=lambda p: away[i, p])
            for p, (n, low, high) in cells.items():
                gap = max(0.0, low - away[i, p], away[i, p] - high)
                allowed = (norm2[i] + longest2 - gap * gap) / 2 + SLACK * (1 + longest2) >= floor
                for part in range(n):
                    if ((p, part) == (nearest, 0)) if home else (allowed and (p, part) != (nearest, 0)):
                        for c, x in zip(out, (p, part, cols["place"][i], vec_id, cols["vec"][i], away[i, p], floor), strict=True):
                            out[c].append(x)
        yield out

    route_schema = "pivot int, part int, place long, vec_id long, vec binary, dist double, floor double"
    block = F.pmod(F.xxhash64("place", F.lit(7)), F.lit(n_blocks)).cast("int")

    def searched(routed: DataFrame, index: DataFrame) -> DataFrame:
        queries = store(routed.withColumn("block", block), "topk-routes")
        # a cell goes to the blocks of which a query needs it, not to all
        needed = queries.groupBy("pivot", "part").agg(F.collect_set("block").alias("blocks"))
        blocks = index.join(needed, ["pivot", "part"]).withColumn("block", F.explode("blocks")).drop("blocks")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"asked": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
            return pd.DataFrame(_search(left, right, dim, longest2, k, annulus_rows))

        by = ("pivot", "part", "block")
        return queries.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(run, "asked long, query_id long, vec_id long, score long")

    at_home = store(searched(arrow_map(asked, lambda c: routes(c, True), route_schema, 512), indexed.where("part = 0")), "topk-home")
    floors = at_home.groupBy("asked").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    bounded = asked.join(floors.select(F.col("asked").alias("place"), "floor"), "place", "left")
    elsewhere = searched(arrow_map(bounded, lambda c: routes(c, False), route_schema, 512), indexed)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    ranked = at_home.unionByName(elsewhere).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda c: F.pmod(c, F.lit(20)) == 0)


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
