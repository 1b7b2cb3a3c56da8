"""Exact top-k by inner product: columnar branch and bound.

Queries form tiles, candidates chunks; both are packed small (one byte a component where that holds it) with a
contiguous column a dimension, dimensions of most mass first. A tile meets a chunk in one task. There, strips of queries
and blocks of candidates, largest norms first, accumulate scores a group of dimensions at a time. After each group a
pair stays only if its partial score plus the most that the remaining dimensions can add (product of the remaining
norms) reaches the query's k-th best so far, which rises from block to block and begins with that of a small sample.
Candidates and queries without a pair are compacted away; once few pairs are left, they go on as a list of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import typed

STEP = 16
TILE, CHUNK, LEAST = 4096, 32768, 4096
STRIP, FIRST, BLOCK = 512, 256, 4096
SAMPLE = 1024
#: Share of pairs below which they go on as a list.
SPARSE = 0.05


def packed(vectors: list, order: np.ndarray) -> tuple[str, bytes]:
    """(type, matrix (dims, vectors)) in the narrowest type; dimensions in the given order, shorter vectors padded with zeros."""
    mat = np.zeros((len(order), len(vectors)))
    for i, v in enumerate(vectors):
        mat[: len(v), i] = v
    mat, top = mat[order], np.abs(mat).max(initial=0)
    kind = "i1" if top < 1 << 7 else "i2" if top < 1 << 15 else "f8"
    return kind, mat.astype(kind).tobytes()


def unpacked(kind: str, mat: bytes, n: int) -> np.ndarray:
    return np.frombuffer(mat, kind).reshape(-1, n)


def float_type(q: np.ndarray, c: np.ndarray) -> type:
    """The float type in which all scores and partial sums are exact, or int64."""
    top = np.abs(q.astype(np.float64)).sum(0).max(initial=0) * np.abs(c.astype(np.float64)).max(initial=0)
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64


class Best:
    """The k best (score, smaller id) of each of n queries, and their k-th scores."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, floor.dtype), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        keep = rank < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def scan_block(q: np.ndarray, c: np.ndarray, left_q: np.ndarray, left_c: np.ndarray, cuts: list, floor: np.ndarray, alive: np.ndarray | None = None):
    """(query, candidate, score) of all pairs whose score reaches the query's floor. left_*: remaining norms after each
    cut. alive: counts of pairs left after each group of dimensions are added to it."""
    rows, cols = np.arange(q.shape[1]), np.arange(c.shape[1])
    part = np.zeros((len(rows), len(cols)), q.dtype)
    # What rounding of the norms in float32 can lose, and then some.
    over = lambda x: x * (1 + 1e-5) + 1e-3
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part += q[a:b, rows].T @ c[a:b, cols]
        ok = part + over(left_q[n + 1, rows][:, None] * left_c[n + 1, cols][None]) >= floor[rows][:, None]
        left = int(ok.sum())
        if alive is not None:
            alive[n] += left
        if left <= SPARSE * ok.size or n == len(cuts) - 2:
            break
        stay_r, stay_c = ok.any(1), ok.any(0)
        if stay_r.mean() * stay_c.mean() < 0.8:
            rows, cols, part = rows[stay_r], cols[stay_c], part[np.ix_(stay_r, stay_c)]
    i, j = np.nonzero(ok)
    score, i, j = part[i, j], rows[i], cols[j]
    for m in range(n + 1, len(cuts) - 1):
        a, b = cuts[m], cuts[m + 1]
        score = score + np.einsum("ij,ij->j", q[a:b, i], c[a:b, j])
        hold = score + over(left_q[m + 1, i] * left_c[m + 1, j]) >= floor[i]
        i, j, score = i[hold], j[hold], score[hold]
        if alive is not None:
            alive[m] += len(i)
    hold = score >= floor[i]
    return i[hold], j[hold], score[hold]


def remaining(m: np.ndarray, cuts: list) -> np.ndarray:
    """Norm of each vector's components from each cut on."""
    return np.sqrt(np.array([(m[a:].astype(np.float64) ** 2).sum(0) for a in cuts])).astype(np.float32)


def search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, alive: np.ndarray | None = None):
    """(query id, candidate id, score) of each query's k best among the candidates, without those under its floor."""
    kind = float_type(q, c)
    cuts = [*range(0, len(c), STEP), len(c)]
    if kind is np.int64:  # no bounds where floats aren't exact
        cuts = [0, len(c)]
    left_q, left_c = remaining(q, cuts), remaining(c, cuts)
    by = np.argsort(-left_c[0], kind="stable")  # large norms first: they raise the k-th best early
    out = []
    for s in range(0, len(q_ids), STRIP):
        own, ids = q[:, s : s + STRIP].astype(kind), q_ids[s : s + STRIP]
        best = Best(len(ids), k, np.where(np.isfinite(floor[s : s + STRIP]), floor[s : s + STRIP], np.iinfo(np.int64).min if kind is np.int64 else -np.inf).astype(kind))
        a, size = 0, FIRST
        while a < len(by):  # small blocks first, so that the k-th best rises before most candidates come
            at = by[a : a + size]
            a, size = a + size, min(BLOCK, 2 * size)
            i, j, score = scan_block(own, c[:, at].astype(kind), left_q[:, s : s + STRIP], left_c[:, at], cuts, best.floor, alive)
            other = ids[i] != c_ids[at][j]
            best.add(i[other], score[other], c_ids[at][j[other]])
        out.append((ids[best.query], best.id, best.score.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def exact_topk(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """Top k other rows by inner product of floor(scale * x), for each row whose vec_id is divisible by every.

    df: vec_id, embedding. Vectors that are null, empty, or hold null or non-finite components, take no part, nor do rows
    without an id; shorter vectors count as padded with zeros. Ties go to the smaller vec_id. Of a repeated vec_id every
    row is a candidate, never of its own id, and the smallest vector, component by component, is the query. Fewer than k
    other rows: all of them. Scores must fit 64 bits.

    A tile of TILE queries and a chunk of up to CHUNK candidates meet in one task: with 64 components of a byte that
    moves 64 bytes a candidate for every TILE queries, and as much a query for every CHUNK candidates. Only the sample
    of SAMPLE vectors, counts, and one number a dimension come to the driver.
    """
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(ok).select(F.col("vec_id").cast("long").alias("id"), F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))
    rows = rows.where(F.size("v") > 0)
    is_query = F.col("id") % every == 0
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    mass = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x") * F.col("x")).alias("m")).collect()
    order = np.array([r.d for r in sorted(mass, key=lambda r: (-r.m, r.d))], np.int64)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sample = [(r.id, r.v) for r in rows.orderBy(norm.desc(), "id").limit(SAMPLE).collect()]
    s_ids, s_mat = np.array([i for i, _ in sample], np.int64), unpacked(*packed([v for _, v in sample], order), len(sample)) if sample else None

    tiles = max(1, -(-counts.q // TILE))
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, -(-counts.n // CHUNK), min(wide, -(-counts.n // LEAST)))

    def floors(ids: np.ndarray, mat: np.ndarray) -> np.ndarray:
        """Of each query, the k-th best score in the sample; -inf where that holds fewer."""
        out = np.full(len(ids), -np.inf)
        if len(s_ids):
            q, _, score = search(ids, mat, out, s_ids, s_mat, k)
            at = np.searchsorted(ids, q)  # ids are sorted and distinct
            full = np.bincount(at, minlength=len(ids)) == k
            low = np.full(len(ids), np.inf)
            np.minimum.at(low, at, score)
            out[full] = low[full]
        return out

    def pack_candidates(batches):
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                kind, mat = packed(part.column("v").to_pylist(), order)
                ids = np.asarray(part.column("id").to_pylist(), np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (kind, ids, mat)], ["kind", "ids", "mat"])

    def pack_tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = np.asarray(table.column("id").to_pylist(), np.int64)
        kind, mat = packed(table.column("v").to_pylist(), order)
        row = (table.column("qb")[0].as_py(), kind, ids.tobytes(), mat, floors(ids, unpacked(kind, mat, len(ids))).tobytes())
        return pa.table([pa.array([x]) for x in row], ["qb", "kind", "ids", "mat", "floor"])

    def meet(tile: pa.Table, chunk: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if len(tile) and len(chunk):
            t = tile.to_pylist()[0]
            q_ids, blocks = np.frombuffer(t["ids"], np.int64), chunk.to_pylist()
            c_ids = np.concatenate([np.frombuffer(b["ids"], np.int64) for b in blocks])
            c = np.concatenate([unpacked(b["kind"], b["mat"], len(b["ids"]) // 8) for b in blocks], 1)
            found = search(q_ids, unpacked(t["kind"], t["mat"], len(q_ids)), np.frombuffer(t["floor"]), c_ids, c, k)
        return pa.table([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    tile_schema, block_schema = "qb long,kind string,ids binary,mat binary,floor binary", "kind string,ids binary,mat binary"
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(tiles)))
    left = queries.groupBy("qb").applyInArrow(pack_tile, tile_schema).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = rows.mapInArrow(typed(pack_candidates, block_schema), block_schema).withColumn("cb", F.pmod(F.xxhash64("ids"), F.lit(chunks)).cast("int"))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    local = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, "query_id long,vec_id long,score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return local.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
