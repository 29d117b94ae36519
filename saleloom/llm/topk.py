"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to some pivots are computed once. For a query q and a candidate x the
distance is at least the largest |d(q, p) - d(x, p)|, so the inner product, (|q|^2 + |x|^2 - d^2) / 2,
is at most what that bound leaves. Candidates are evaluated in the order of their bounds, and a search
ends where the next bound is below the k-th best score. Candidates lie in parts of bounded size; every
query visits every part, and only k rows of each visit are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleloom.llm.common import ship
from saleloom.session import stored

PIVOTS = 16
PART_ROWS = 8192  # candidates that one task holds, on average
CHUNK = 512  # candidates evaluated at once
NO_ID = 2**63 - 1


def quantised(vectors: DataFrame, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """uid (one for each row), vec_id and v, the components as floor(scale * x).

    Vectors that are null or hold a null, infinite or not-a-number component are left out.
    """
    e = F.col(f"`{embedding}`")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(e.isNotNull() & sound)
    ints = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("uid"),
                       F.coalesce(F.col(f"`{vec_id}`").cast("long"), F.lit(NO_ID)).alias("vec_id"), ints.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the vectors; shorter ones are filled with zeros, which leaves inner products as they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _scores(matrix: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits they stop at the largest and smallest long."""
    bound = float(np.abs(matrix).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if bound < 2**53:
        return (matrix.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return matrix @ q
    wide = matrix.astype(object) @ q.astype(object)
    return np.array([max(-2**63, min(2**63 - 1, int(s))) for s in wide], dtype=np.int64)


class PivotTable:
    """Vectors of one part with their distances to the pivots."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, matrix: np.ndarray, pivots: np.ndarray):
        order = np.lexsort((uids, ids))
        self.uids, self.ids, self.matrix, self.pivots = uids[order], ids[order], matrix[order], pivots
        real = self.matrix.astype(np.float64)
        self.squares = (real * real).sum(axis=1)
        self.apart = self._distances(real)

    def _distances(self, real: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((real - p) ** 2).sum(axis=1)) for p in self.pivots.astype(np.float64)]) \
            if len(self.pivots) else np.zeros((1, len(real)))

    def search(self, uid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the k best, the row ``uid`` left out, and how many were evaluated."""
        real = q.astype(np.float64)[None, :]
        square = float((real * real).sum())
        least = np.abs(self.apart - self._distances(real)).max(axis=0) if len(self.pivots) else np.zeros(len(self.ids))
        most = (square + self.squares - least * least) / 2
        most += 0.5 + 1e-9 * (square + self.squares)  # what rounding may have taken
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, seen = np.flatnonzero(self.uids != uid), 0
        while len(left):
            bounds = most[left]
            if len(score) >= k:
                open_ = bounds >= score[k - 1]
                left, bounds = left[open_], bounds[open_]
                if not len(left):
                    break
            if len(left) > CHUNK:
                cut = np.argpartition(-bounds, CHUNK)
                now, left = left[cut[:CHUNK]], left[cut[CHUNK:]]
            else:
                now, left = left, left[:0]
            seen += len(now)
            best = np.concatenate([best, now])
            score = np.concatenate([score, _scores(self.matrix[now], q)])
            keep = np.lexsort((best, -score))[:k]  # rows stand in the order of their ids
            best, score = best[keep], score[keep]
        return best, score, seen


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS,
          vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query row.

    ``is_query`` is a condition on vec_id. Ties go to the smaller vec_id, rows without vec_id come last
    and are no queries. A row is no candidate of itself, but an equal row is one. Vectors of different
    length meet as if the shorter one ended in zeros. Fewer candidates than k give fewer rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(quantised(vectors, scale, vec_id, embedding), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width = max(size["w"] or 0, 1)
    parts = max(1, -(-size["n"] // PART_ROWS))
    chosen = rows.orderBy(F.xxhash64("uid"), "uid").limit(pivots).select("v").collect()
    at = np.zeros((len(chosen), width), dtype=np.int64)
    for row, c in zip(at, chosen, strict=True):
        row[:len(c["v"])] = c["v"]
    candidates = rows.select(F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"),
                             "uid", "vec_id", "v")
    asked = (rows.filter(is_query & (F.col("vec_id") != NO_ID))
             .select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("side"),
                     "uid", "vec_id", "v"))
    names = ["query_uid", "query_id", "uid", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, index = None, None
        for batch in batches:
            for piece in _runs(batch):
                key = (piece.column("part")[0].as_py(), piece.column("side")[0].as_py())
                if key[0] != part:
                    part, index, held = key[0], None, []
                if key[1] == 0:
                    held.append(piece)
                    continue
                if index is None and held:
                    t = pa.Table.from_batches(held)
                    index = PivotTable(t["uid"].to_numpy(), t["vec_id"].to_numpy(), _matrix(t["v"], width), at)
                if index is None:
                    continue
                out: dict[str, list] = {n: [] for n in names}
                for uid, name, q in zip(piece.column("uid").to_pylist(), piece.column("vec_id").to_pylist(),
                                        _matrix(piece.column("v"), width), strict=True):
                    best, score, _ = index.search(uid, q, k)
                    out["query_uid"] += [uid] * len(best)
                    out["query_id"] += [name] * len(best)
                    out["uid"] += index.uids[best].tolist()
                    out["vec_id"] += index.ids[best].tolist()
                    out["score"] += score.tolist()
                yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

    def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        key = batch.column("part").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)

    # ranges of part numbers, not their hashes, so that each task gets one part
    met = (candidates.unionByName(asked).repartitionByRange(parts, "part").sortWithinPartitions("part", "side")
           .mapInArrow(run, ", ".join(f"{n} long" for n in names)))
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return (met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score"))
