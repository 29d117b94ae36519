"""Vector codes: each quarter of a vector gives way to its nearest codebook entry, found under adaptive bounds.

Codebooks move from round to round, most entries by little. A quarter therefore keeps a list of its b closest
entries, nearest first, with a lower bound on the distance to each, and one outer bound on the distance to all
entries beyond the list. After a move the bounds fall by what the entries moved, and the distance to the
present entry is taken anew. While every bound lies above it, nothing can have changed. If bounds of the list
do not, these entries' distances are taken in whole numbers and the list is sorted again. Only where the
outer bound does not hold either are all entries compared. The lists stand in the stored rows, so a round
reads what the last one has left, on whatever executor.

b follows the data: the rows note how deep in its list a quarter had to look, and the next round's lists are
as long as nearly all quarters needed, or twice as long where many had to leave theirs.

Bounds are floating-point numbers, rounded away from deciding; every decision is one between exact integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.llm.common import ship
from saleloom.session import discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
FIRST_LIST, SHORTEST_LIST = 16, 2  # entries; the longest list is a quarter of the codebook
NEED, LEAVING = 0.99, 0.1  # lists serve this share of the quarters; they double where so many leave theirs
NO_ID = MOST = 2**63 - 1
ROWS = 4096  # vectors compared with a codebook at once


def quantised(vectors: DataFrame, scale: float, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label and v, the components as floor(scale * x), of vectors of finite components only."""
    e = F.col(f"`{embedding}`")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.filter(e.isNotNull() & sound).select(
        F.coalesce(F.col(f"`{vec_id}`").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(f"`{label}`").alias("label"),
        ints.alias("v"))


def _kind(x: np.ndarray, c: np.ndarray) -> type:
    """The numbers in which squared distances between x and c are exact."""
    far = [max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0)))) for a in (x, c)]
    most = sum(far) ** 2 * max(1, x.shape[1])
    return np.float64 if most < 2**52 else np.int64 if most < 2**61 else object


def to_all(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c, exact."""
    kind = _kind(x, c)
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def to_own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to the same row of c, exact."""
    kind = _kind(x, c)
    apart = x.astype(kind) - c.astype(kind)
    return (apart * apart).sum(axis=1)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def moved_by(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry of one codebook has moved, rounded up."""
    return _root(to_own(new, old)) * (1 + 1e-12)


@dataclass
class Lists:
    """What the quarters at one part position know: their entry, the closest entries, bounds and depth of the last look."""

    code: np.ndarray
    square: np.ndarray  # exact squared distance to ``code``
    near: np.ndarray  # rows by b, -1 where a list is shorter
    lower: np.ndarray
    outer: np.ndarray
    depth: np.ndarray  # entries of the list that were looked at, -1 where all were


def compare_all(x: np.ndarray, entries: np.ndarray, b: int) -> Lists:
    """Lists of length b from the distances to all entries."""
    n, k = len(x), len(entries)
    out = Lists(np.zeros(n, np.int64), np.zeros(n, object), np.full((n, b), -1), np.full((n, b), np.inf),
                np.full(n, np.inf), np.full(n, -1))
    for at in range(0, n, ROWS):
        part = slice(at, min(n, at + ROWS))
        squares = to_all(x[part], entries)
        code = squares.argmin(axis=1)
        rows = np.arange(len(code))
        out.code[part], out.square[part] = code, squares[rows, code]
        apart = _root(squares)
        apart[rows, code] = -1  # the entry itself opens the list, whatever ties with it
        shown = min(b, k)
        order = np.argpartition(apart, min(shown, k - 1), axis=1)[:, :shown + 1]
        order = np.take_along_axis(order, np.take_along_axis(apart, order, axis=1).argsort(axis=1, kind="stable"), axis=1)
        out.near[part, :shown] = order[:, :shown]
        out.lower[part, :shown] = np.take_along_axis(apart, order[:, :shown], axis=1)
        out.lower[part, 0] = _root(out.square[part])
        if k > shown:
            out.outer[part] = apart[rows, order[:, shown]]
    return out


def follow(x: np.ndarray, last: Lists, entries: np.ndarray, drift: np.ndarray, b: int) -> Lists:
    """Lists of length b after the entries have moved by ``drift``."""
    code, near, rows = last.code.copy(), last.near, np.arange(len(x))
    square = to_own(x, entries[code]).astype(object)
    reach = _root(square) * (1 + 1e-12)
    lower = np.where(near >= 0, last.lower - drift[near], np.inf)
    lower[:, 0] = _root(square)
    outer = last.outer - drift.max(initial=0)
    leave = outer <= reach
    look = lower <= reach[:, None]
    look[:, 0] = False
    look[leave] = False
    depth = np.where(look.any(axis=1), look.shape[1] - look[:, ::-1].argmax(axis=1), 0)
    row, place = np.nonzero(look)
    if len(row):
        entry = near[row, place]
        found = to_own(x[row], entries[entry])
        lower[row, place] = _root(found)
        order = np.lexsort((entry, found, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        r, e, s = row[first], entry[first], found[first].astype(object)
        better = (s < square[r]) | ((s == square[r]) & (e < code[r]))
        code[r[better]], square[r[better]] = e[better], s[better]
        ahead = np.where(near == code[:, None], -1.0, lower)
        order = ahead.argsort(axis=1, kind="stable")
        near, lower = np.take_along_axis(near, order, axis=1), np.take_along_axis(lower, order, axis=1)
    if near.shape[1] > b:
        outer = np.minimum(outer, lower[:, b:].min(axis=1))
        near, lower = near[:, :b], lower[:, :b]
    elif near.shape[1] < b:
        more = ((0, 0), (0, b - near.shape[1]))
        near, lower = np.pad(near, more, constant_values=-1), np.pad(lower, more, constant_values=np.inf)
    out = Lists(code, square, near.copy(), lower.copy(), outer, depth)
    if leave.any():
        again = compare_all(x[leave], entries, b)
        for name in ("code", "square", "near", "lower", "outer", "depth"):
            getattr(out, name)[leave] = getattr(again, name)
    return out


def next_length(depths: dict[int, int], now: int, entries: int) -> int:
    """The length of the next lists from how many quarters looked how deep; -1 are those that left their list."""
    total = sum(depths.values())
    longest = max(SHORTEST_LIST, entries // 4)
    if total and depths.get(-1, 0) > LEAVING * total:
        return min(longest, 2 * now)
    seen, need = depths.get(-1, 0), SHORTEST_LIST
    for depth in sorted(d for d in depths if d >= 0):
        seen += depths[depth]
        need = max(need, depth + 1)
        if seen >= NEED * total:
            break
    return min(longest, max(SHORTEST_LIST, need))


def _floats(values: np.ndarray) -> pa.Array:
    """As 32-bit numbers that are not above the given ones."""
    with np.errstate(over="ignore"):
        near = values.astype(np.float32)
    return pa.array(np.where(np.isinf(near), near, np.nextafter(near, np.float32(-np.inf))).reshape(-1))


def _lists(values: pa.Array, rows: int) -> pa.Array:
    width = len(values) // rows if rows else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), values)


def assigned(state: DataFrame, codebook: np.ndarray, drift: np.ndarray | None, b: int) -> DataFrame:
    """Rows with the code under ``codebook``; without ``drift`` there are no lists to follow yet."""
    parts, _, width = codebook.shape
    names = ["vec_id", "label", "v", "code", "error", "near", "lower", "outer", "depth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                n = part.num_rows
                v = part.column("v").flatten().to_numpy().reshape(n, parts, width)
                if drift is not None:
                    old = {c: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, parts, -1)
                           for c in ("code", "near", "lower", "outer")}
                found = []
                for p in range(parts):
                    if drift is None:
                        found.append(compare_all(v[:, p], codebook[p], b))
                    else:
                        last = Lists(old["code"][:, p, 0].astype(np.int64), None, old["near"][:, p].astype(np.int64),
                                     old["lower"][:, p].astype(np.float64), old["outer"][:, p, 0].astype(np.float64), None)
                        found.append(follow(v[:, p], last, codebook[p], drift[p], b))
                error = [min(MOST, int(s)) for s in sum(f.square for f in found)]

                def side_by_side(name: str) -> np.ndarray:
                    return np.stack([getattr(f, name) for f in found], axis=1)

                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("v"),
                     _lists(pa.array(side_by_side("code").reshape(-1), pa.int32()), n), pa.array(error, pa.int64()),
                     _lists(pa.array(side_by_side("near").reshape(-1), pa.int32()), n),
                     _lists(_floats(side_by_side("lower")), n), _lists(_floats(side_by_side("outer")), n),
                     _lists(pa.array(side_by_side("depth").reshape(-1), pa.int32()), n)], names=names)

    longs, ints, floats = (T.ArrayType(t) for t in (T.LongType(), T.IntegerType(), T.FloatType()))
    kinds = dict(zip(names, (T.LongType(), state.schema["label"].dataType, longs, ints, T.LongType(), ints, floats, floats, ints)))
    return state.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in kinds.items()]))


def sums_of(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Sums of the quarters of every entry, their counts, and how many quarters looked how deep.

    Tasks hand on their sums; the driver sees one number for each component of the codebooks.
    """
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], int] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(n, parts, width)
            far = max(abs(int(v.min(initial=0))), abs(int(v.max(initial=0))))
            v = v.astype(object) if far * n >= 2**62 else v
            code = batch.column("code").flatten().to_numpy().reshape(n, parts)
            for p in range(parts):
                order = code[:, p].argsort(kind="stable")
                mine = code[order, p]
                begin = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                added = np.add.reduceat(v[order, p], begin, axis=0) if width else np.zeros((len(begin), 0), np.int64)
                for e, row, count in zip(mine[begin].tolist(), added.tolist(), np.diff(np.r_[begin, n]).tolist(), strict=True):
                    place = p * entries + e
                    sums["count", place] = sums.get(("count", place), 0) + count
                    for i, x in enumerate(row, place * width):
                        sums["sum", i] = sums.get(("sum", i), 0) + x
            for depth, count in zip(*np.unique(batch.column("depth").flatten().to_numpy(), return_counts=True)):
                sums["depth", int(depth)] = sums.get(("depth", int(depth)), 0) + int(count)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in sums]), pa.array([i for _, i in sums], pa.int64()),
                 pa.array(map(Decimal, sums.values()), pa.decimal128(38, 0))], names=["kind", "place", "n"])

    rows = (state.select("v", "code", "depth").mapInArrow(run, "kind string, place long, n decimal(38,0)")
            .groupBy("kind", "place").agg(F.sum("n").alias("n")).collect())
    sums, counts, depths = np.zeros(parts * entries * width, object), np.zeros(parts * entries, object), {}
    for kind, place, n in rows:
        if kind == "depth":
            depths[place] = int(n)
        else:
            (sums if kind == "sum" else counts)[place] = int(n)
    return sums.reshape(shape), counts.reshape(parts, entries), depths


def moved(codebook: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The next codebook: floors of the means, unused entries as they were."""
    used = counts > 0
    out = codebook.astype(object)
    out[used] = sums[used] // counts[used][:, None]
    return out.astype(np.int64)


@dataclass
class Codes:
    """Stored rows (vec_id, label, code, error) and the codebooks; one record for each round of (list length, depths)."""

    rows: DataFrame
    codebook: np.ndarray
    looks: list[tuple[int, dict[int, int]]]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebook.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
             vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> Codes | None:
    """Codes of all vectors of finite components; None where there are none.

    A codebook starts as the parts of the vectors of the ``entries`` smallest vec_ids; rows of one vec_id go by
    their components, rows without vec_id come last. Fewer vectors make a smaller codebook. Vectors of
    different length are filled with zeros up to the longest, and that up to a multiple of ``parts``.
    Components beyond 64 bits stop at the largest and smallest long, errors at the largest.
    """
    ship(vectors.sparkSession)
    kept = stored(quantised(vectors, scale, vec_id, embedding, label), "vectors")
    width = kept.agg(F.max(F.size("v")).alias("w")).first()["w"]
    if width is None:
        discard(kept)
        return None
    width = math.ceil(width / parts)
    rows = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("v"))))
    first = np.array([r["v"] for r in rows.orderBy("vec_id", "v").limit(entries).select("v").collect()], dtype=np.int64)
    codebook = np.ascontiguousarray(first.reshape(len(first), parts, width).swapaxes(0, 1))
    b = max(SHORTEST_LIST, min(FIRST_LIST, len(first) // 4))
    state = stored(assigned(rows, codebook, None, b), "codes")
    discard(kept)
    looks = []
    for _ in range(rounds):
        sums, counts, depths = sums_of(state, codebook.shape)
        looks.append((b, depths))
        last, codebook = codebook, moved(codebook, sums, counts)
        drift = np.stack([moved_by(o, n) for o, n in zip(last, codebook)])
        if len(looks) > 1:  # the first round had no lists to look into
            b = next_length(depths, b, len(first))
        older, state = state, stored(assigned(state, codebook, drift, b), "codes")
        discard(older)
    return Codes(state.select("vec_id", "label", "code", "error"), codebook, looks)


def code_digests(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code in hex digits, error, label_error and codebooks_sha256 of every vector that ``compress`` keeps.

    Repeated rows are kept. Rows without label share one label_error. An empty table, or one without a
    vector of finite components, gives no rows. Other columns are ignored, whatever their names.
    """
    found = compress(vectors, vec_id=vec_id, embedding=embedding, label=label)
    if found is None:
        kind = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], kind)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_label = found.rows.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label")
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return (found.rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
            .select(F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), F.array_join(digits, "").alias("code"),
                    "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256")))
