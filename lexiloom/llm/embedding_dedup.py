"""Embedding near-duplicates by tiled comparison in the order of principal components.

Unit vectors are rotated so that their variance falls from dimension to dimension. A tile pair adds up dot products over
the leading dimensions first; what the rest can still add is at most the product of the two suffix norms, and pairs
that cannot reach the threshold are dropped before the rest is computed. What is left within rounding of the threshold is
decided on the original vectors, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import connected_components, durable

#: Rows of a tile, and dimensions after which pairs are tested.
TILE, STEPS = 4096, (8, 16, 32)
#: What rounding may take from a bound or a cosine.
_SLACK = 1e-9


def usable(column: str = "embedding") -> Column:
    """Not null, nor zero, nor with a null or non-finite component."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square leaves the range of doubles; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows (of `a` with one row or with its own row of `b`), adding up in the order of dimensions."""
    total = a[..., 0] * b[..., 0]
    for k in range(1, a.shape[-1]):
        total = total + a[..., k] * b[..., k]
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of scaled vectors in double precision; equal vectors have equal cosines."""
    return dots(a, b) / (np.sqrt(dots(a, a)) * np.sqrt(dots(b, b)))


def second_moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector the sum of outer products of all unit vectors, added up in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = pc.list_value_length(batch.column(0)).to_numpy()
            for n in np.unique(lengths).tolist():
                x = unit(matrix(batch.column(0).filter(pa.array(lengths == n))))
                total[n] = total.get(n, 0) + x.T @ x
        for n, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * n * n, pa.int32()), pa.array(range(n * n), pa.int32()), pa.array(m.ravel())], names=["n", "at", "value"])

    cells = vectors.select("embedding").mapInArrow(run, "n int, at int, value double")
    rows = cells.groupBy("n", "at").agg(F.sum("value").alias("value")).toPandas()
    return {int(n): g.sort_values("at")["value"].to_numpy().reshape(n, n) for n, g in rows.groupby("n")}


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthogonal matrices onto principal components, the widest first; a d x d matrix for each length d in use."""
    return {n: np.linalg.eigh(m)[1][:, ::-1] for n, m in second_moments(vectors).items()}


def tiles(classes: DataFrame, width: float, turn: dict[int, np.ndarray]) -> DataFrame:
    """(label, dim, cell, part, ids, copies, rows): classes packed to blobs of about TILE vectors as they are.

    A cell is a span of `width` of the first component inside a label, so that pairs of distant cells need no look;
    a cell's vectors are dealt by hash to as many tiles as it takes. `turn` holds the rotation for each length.
    """
    kind = "<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(3)).to_numpy()
            for n in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == n))
                x = matrix(some.column(3))
                blob = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                cell = pa.array(np.floor(unit(x) @ turn[n][:, 0] / width).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(np.full(len(x), n, np.int32)), cell, blob], names=["id", "label", "copies", "dim", "cell", "x"])

    rows = classes.select("id", "label", "copies", "embedding").mapInArrow(place, "id long, label int, copies long, dim int, cell int, x binary")
    rows = durable(rows, "placed")
    sizes = rows.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    dealt = rows.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        blob = lambda name, kind: [rows[name].to_numpy().astype(kind).tobytes()]
        head = {n: [k.as_py()] for n, k in zip(("label", "dim", "cell", "part"), key, strict=True)}
        return pa.table(head | {"ids": blob("id", np.int64), "copies": blob("copies", np.int64), "rows": [b"".join(rows["x"].to_pylist())]}, schema=shape)

    shape = pa.schema([("label", pa.int32()), ("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int64()), *((n, pa.binary()) for n in ("ids", "copies", "rows"))])
    packed = dealt.groupBy("label", "dim", "cell", "part").applyInArrow(pack, "label int, dim int, cell int, part long, ids binary, copies binary, rows binary")
    return durable(packed, "tiles")


def compare(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of vectors whose cosine reaches the threshold; of one tile, those with i < j."""
    a, b = scaled(a), scaled(b)
    turned_a, turned_b = unit(a) @ turn, unit(b) @ turn
    found_i, found_j = [], []
    dim, steps = a.shape[1], [s for s in STEPS if s < a.shape[1]]
    rest = lambda x, s: np.sqrt((x[:, s:] ** 2).sum(axis=1))
    rest_a, rest_b = [rest(turned_a, s) for s in steps], [rest(turned_b, s) for s in steps]
    first = steps[0] if steps else dim
    for at in range(0, len(a), 512):
        i0 = slice(at, at + 512)
        partial = turned_a[i0, :first] @ turned_b[:, :first].T
        bound = partial + rest_a[0][i0, None] * rest_b[0][None, :] if steps else partial
        i, j = np.nonzero(bound >= threshold - _SLACK)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        part = partial[i - at, j]
        for k, s in enumerate(steps):
            end = steps[k + 1] if k + 1 < len(steps) else dim
            keep = part + rest_a[k][i] * rest_b[k][j] >= threshold - _SLACK
            i, j, part = i[keep], j[keep], part[keep]
            part = part + np.einsum("nd,nd->n", turned_a[i, s:end], turned_b[j, s:end])
        keep = part >= threshold
        edge = np.flatnonzero(np.abs(part - threshold) <= _SLACK)
        keep[edge] = cosines(a[i[edge]], b[j[edge]]) >= threshold
        found_i.append(i[keep])
        found_j.append(j[keep])
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs join what earlier ones left apart: at most one less than there are rows."""
    parent: dict[int, int] = {}
    keep = np.zeros(len(i), bool)

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[y], keep[k] = x, True
    return keep


def _links(threshold: float, turn: dict[int, np.ndarray], kind: str):
    """For pairs of tiles: (id, linked, other): how many vectors an id links to there, or an edge to `other`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same, dim, *blobs = (c[row].as_py() for c in batch.columns)
                ids_a, n_a, ids_b, n_b = (np.frombuffer(b, np.int64) for b in (blobs[0], blobs[1], blobs[3], blobs[4]))
                a, b = (np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64) for x in (blobs[2], blobs[5]))
                i, j = compare(a, b, turn[dim], threshold, same)
                if not len(i):
                    continue
                ids = np.concatenate([ids_a, ids_b])
                linked = np.bincount(i, weights=n_b[j], minlength=len(a)), np.bincount(j, weights=n_a[i], minlength=len(b))
                linked = np.concatenate(linked).astype(np.int64)
                some = np.flatnonzero(linked)
                edge = _forest(i, j if same else j + len(a))
                out = (np.r_[ids[some], ids_a[i[edge]]], np.r_[linked[some], np.zeros(edge.sum(), np.int64)], np.r_[np.full(len(some), -1), ids_b[j[edge]]])
                mask = np.r_[np.ones(len(some), bool), np.zeros(int(edge.sum()), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64(), mask=mask)], names=["id", "linked", "other"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, width: float = 0.05) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding, label).

    Vectors of one label and length link at a cosine of `threshold` or more. Equal vectors are one class before any
    comparison: copies cost one row and count as links of each other. Unusable vectors (see usable) and those without a
    label link with nothing. A null vec_id has its links counted; its component is the smallest id reachable, or null.
    Repeated rows are vectors of their own, as are different vectors of one vec_id; `kept` is false without an id. Ties
    at the threshold link. An empty table gives an empty table. Other columns are not read.
    """
    rows = vectors.select("vec_id", "embedding", "label").withColumn("label", F.col("label").cast("int"))
    good = usable() & F.col("label").isNotNull()
    classes = rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = durable(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    if classes.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    turn = rotations(classes)
    packed = tiles(classes, width, turn)
    kind = "<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    # two unit vectors at the threshold differ by at most the root of 2 - 2 t in any dimension
    reach = int(np.ceil(np.sqrt(max(0.0, 2 - 2 * threshold)) / width)) + 1
    left, right = (packed.select("label", "dim", F.col("cell").alias(f"cell_{s}"), F.col("part").alias(f"part_{s}")) for s in "ab")
    near = F.explode(F.sequence("cell_a", F.col("cell_a") + reach)).alias("cell_b")
    pairs = left.select("*", near).join(right, ["label", "dim", "cell_b"]).where("cell_a < cell_b or part_a <= part_b")
    for s in "ab":
        blobs = packed.select("label", "dim", F.col("cell").alias(f"cell_{s}"), F.col("part").alias(f"part_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "rows")))
        pairs = pairs.join(blobs, ["label", "dim", f"cell_{s}", f"part_{s}"])
    same = ((F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") == F.col("part_b"))).alias("same")
    pairs = pairs.select(same, "dim", *(f"{c}_{s}" for s in "ab" for c in ("ids", "copies", "rows")))
    found = durable(pairs.mapInArrow(_links(threshold, turn, kind), "id long, linked long, other long"), "links")
    others = found.where("other is null").groupBy("id").agg(F.sum("linked").alias("others"))
    parts = connected_components(found.where("other is not null"), "id", "other")
    best = classes.join(parts, classes["id"] == parts["node"]).groupBy("component").agg(F.min("first").alias("least"))
    done = classes.join(parts, classes["id"] == parts["node"], "left").join(best, "component", "left").join(others, "id", "left")
    done = done.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("least"))
    key = rows.withColumn("key", F.when(good, F.col("embedding")))
    out = key.join(done, (F.col("label") == F.col("l")) & (F.col("key") == F.col("e")), "left")
    component = F.when(F.col("l").isNull(), F.col("vec_id")).otherwise(F.col("least")).cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
