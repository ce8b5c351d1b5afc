"""Near-duplicate vectors: PCA-ordered tiled comparison.

Equal vectors of a label are one class. Unit vectors are turned into principal axes, so that their
leading dimensions hold most of a product. Classes of a label are put in the order of cells of the
first axes and cut into tiles of equal size, however large the label is; two tiles are compared only
if the box around each one's leading dimensions, and the norms of what is left, allow a cosine at the threshold. Within a pair
of tiles, products of the leading dimensions are accumulated first; the product of the rest cannot
exceed the product of the suffix norms, so a pair is dropped as soon as its bound falls short. What
is left is decided by the cosine of the vectors as given, in double precision. A pair of tiles
yields counts of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import connected_components
from .mixing import ranked

THRESHOLD = 0.93
#: Vectors in a tile, leading dimensions with a box, axes whose cells give the order, and what rounding may do to a bound.
TILE_ROWS, BOX_DIMS, CELL_AXES, SLACK = 1024, 8, 3, 1e-9
#: Survivors of a tile pair that are looked at together; above this share of a tile pair, products go on for all of it.
PAIRS_AT_ONCE, DENSE = 1 << 16, 0.1


def _usable(vector: Column, label: Column) -> Column:
    """Whether a vector can have links: a label, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of unit vectors that a task has read: dim, axis, sums."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column(0)
        dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            own = vectors.filter(pa.array(dims == dim)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            units = _units(own)
            sums[dim] = sums.get(dim, 0) + units.T @ units
    for dim, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([x.tobytes() for x in total])], names=["dim", "axis", "sums"])


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x) for x in rows["sums"]], axis=0)
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "axis": [rows["axis"].iloc[0]], "sums": [total.tobytes()]})


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the axes (columns), by falling second moment of all unit vectors. They decide speed only.

    Each task adds up its vectors; an axis' sums are added in a task of their own. The driver gets dim x dim numbers.
    """
    schema = "dim int, axis int, sums binary"
    rows = classes.select("vector").mapInArrow(_moments, schema).groupBy("dim", "axis").applyInPandas(_add, schema).collect()
    found: dict[int, np.ndarray] = {}
    for r in rows:
        found.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["axis"]] = np.frombuffer(r["sums"])
    return {dim: np.linalg.eigh(m)[1][:, ::-1] for dim, m in found.items()}


def _cells(axes: dict[int, np.ndarray], width: float):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((len(dims), CELL_AXES))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                rows = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                k = min(CELL_AXES, dim)
                out[own, :k] = _units(rows) @ axes[dim][:, :k]
            out[:, :-1] = np.floor(out[:, :-1] / width)
            for k in range(CELL_AXES):
                batch = batch.append_column(f"c{k}", pa.array(out[:, k]))
            yield batch

    return cells


def _as_tiles(axes: dict[int, np.ndarray], kind: type):
    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        given = np.array(rows["vector"].tolist(), dtype=kind)
        dim = given.shape[1]
        turned = _units(given.astype(np.float64)) @ axes[dim]
        box = turned[:, :BOX_DIMS]
        rest = np.sqrt(np.maximum(0, 1 - (box**2).sum(axis=1)))
        return pd.DataFrame({
            "label": rows["label"].iloc[:1], "dim": rows["dim"].iloc[:1], "tile": rows["tile"].iloc[:1], "last": rows["last"].iloc[:1], "low": [box.min(axis=0).tolist()], "high": [box.max(axis=0).tolist()], "rest": [float(rest.max())],
            "ids": [rows["cls"].to_numpy(np.int64).tobytes()], "sizes": [rows["n"].to_numpy(np.int64).tobytes()], "vectors": [given.tobytes()],
        })

    return tile


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected to by the links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def linked(given_a: np.ndarray, given_b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose cosine reaches the threshold."""
    a, b = given_a.astype(np.float64), given_b.astype(np.float64)
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ya, yb = (a / na[:, None]) @ axes, (b / nb[:, None]) @ axes
    dim, least = a.shape[1], threshold - SLACK
    steps = [k for k in (8, 16, 32, 64, 128, 256, 512) if k < dim] + [dim]
    # norms of what follows the first k dimensions
    after = lambda y: np.sqrt(np.maximum(0, np.cumsum((y**2)[:, ::-1], axis=1)[:, ::-1]))
    rest_a, rest_b = (np.pad(after(y), ((0, 0), (0, 1))) for y in (ya, yb))
    products, k, done = np.zeros((len(a), len(b))), 0, 0
    while done < len(steps):
        upto = steps[done]
        products += ya[:, k:upto] @ yb[:, k:upto].T
        k, done = upto, done + 1
        i, j = np.nonzero(products + rest_a[:, k, None] * rest_b[None, :, k] >= least)
        if not len(i):
            return i, j
        if len(i) <= DENSE * products.size:
            break
    if done == len(steps) and len(i) > DENSE * products.size:
        exact = (a @ b.T) / (na[:, None] * nb[None, :])
        return np.nonzero(exact >= threshold)
    found = []
    for lo in range(0, len(i), PAIRS_AT_ONCE):
        x, y = i[lo : lo + PAIRS_AT_ONCE], j[lo : lo + PAIRS_AT_ONCE]
        sums, at = products[x, y], k
        for upto in steps[done:]:
            sums = sums + np.einsum("ij,ij->i", ya[x, at:upto], yb[y, at:upto])
            at = upto
            open_ = sums + rest_a[x, at] * rest_b[y, at] >= least
            x, y, sums = x[open_], y[open_], sums[open_]
        exact = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
        found.append((x[exact >= threshold], y[exact >= threshold]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(axes: dict[int, np.ndarray], kind: type, threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, row=row, batch=batch: batch.column(batch.schema.get_field_index(name))[row]
                dim, same = get("dim").as_py(), get("tile").as_py() == get("other").as_py()
                ids, sizes, given = ([np.frombuffer(get(p + c).as_py(), dtype=t) for p in ("", "other_")] for c, t in (("ids", np.int64), ("sizes", np.int64), ("vectors", kind)))
                i, j = linked(given[0].reshape(-1, dim), given[1].reshape(-1, dim), axes[dim], threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                n = len(ids[0])
                nodes, weights = (ids[0], sizes[0]) if same else (np.concatenate(ids), np.concatenate(sizes))
                j = j if same else j + n
                links = np.zeros(len(nodes), dtype=np.int64)
                np.add.at(links, i, weights[j])
                np.add.at(links, j, weights[i])
                own = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({"cls": nodes[own], "links": links[own], "near": nodes[_forest(len(nodes), i, j)[own]]})

    return compare


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and the cosine of their vectors, in double precision,
    is threshold or more. Vectors that are null, all zero or hold null or non-finite components,
    rows without label, and vectors of different lengths are linked with nothing. Equal vectors are
    linked with one another, and rows that share a vec_id are rows of their own. component_id is the
    least vec_id reachable by links (null only if no row of a component has one); kept tells
    whether it is the row's. Other columns are ignored; an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    double = dict(vectors.dtypes)["embedding"] not in ("array<float>", "array<smallint>", "array<tinyint>")
    kind, array = (np.float64, "array<double>") if double else (np.float32, "array<float>")
    vector, label = F.col("embedding").cast(array), F.col("label").cast("string")
    text = F.concat_ws("|", F.col("label").cast("string"), vector.cast("string"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), label.alias("label"), F.when(_usable(vector, label), F.unhex(F.sha2(text, 256))).alias("key"))
    used = rows.filter(F.col("key").isNotNull())
    classes = used.groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("cls")), "classes")
    axes = principal_axes(classes)
    found = materialize(_links(classes, axes, kind, threshold, tile_rows), "found")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("cls").alias("a"), F.col("near").alias("b")))
    known = materialize(classes.select("key", "cls", "least", "n").join(counts, "cls", "left").join(labels.select(F.col("node").alias("cls"), F.col("label").alias("root")), "cls", "left"), "known")
    release(found)
    known = known.withColumn("root", F.coalesce("root", "cls"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    verdicts = known.join(least, "root").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    found = used.select("vec_id", "key").join(verdicts, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, axes: dict[int, np.ndarray], kind: type, threshold: float, tile_rows: int) -> DataFrame:
    """cls, links (rows of linked classes), near (another class of the same component, or itself) of each pair of tiles."""
    spark = classes.sparkSession
    array = dict(classes.dtypes)["vector"]
    width = float(np.sqrt(2 - 2 * threshold)) / 2 or 1e-3  # unit vectors that are linked differ by less than two cells in any axis
    axis = [f"c{k}" for k in range(CELL_AXES)]
    ordered = classes.select("cls", "label", "dim", "n", "vector").mapInArrow(_cells(axes, width), f"cls long, label string, dim int, n long, vector {array}, " + ", ".join(f"{c} double" for c in axis))
    placed = ranked(ordered, ["label", "dim"], [*axis, "cls"], total="all")
    placed = placed.select("cls", "label", "dim", "n", "vector", F.expr(f"rank div {tile_rows}").alias("tile"), F.expr(f"(all - 1) div {tile_rows}").alias("last"))
    schema = "label string, dim int, tile long, last long, low array<double>, high array<double>, rest double, ids binary, sizes binary, vectors binary"
    tiles = materialize(placed.groupBy("label", "dim", "tile").applyInPandas(_as_tiles(axes, kind), schema), "tiles")
    box = tiles.select("label", "dim", "tile", "last", "low", "high", "rest")
    each = box.withColumn("other", F.explode(F.sequence("tile", "last")))
    other = box.select("label", "dim", F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("rest").alias("rest2"))
    ways = F.zip_with(F.zip_with("low", "high", lambda x, y: F.struct(x.alias("l"), y.alias("h"))), F.zip_with("low2", "high2", lambda x, y: F.struct(x.alias("l"), y.alias("h"))),
                      lambda x, y: F.greatest(x["l"] * y["l"], x["l"] * y["h"], x["h"] * y["l"], x["h"] * y["h"]))
    bound = F.aggregate(ways, F.lit(0.0), lambda s, x: s + x) + F.col("rest") * F.col("rest2")
    pairs = each.join(other, ["label", "dim", "other"]).filter(bound >= threshold - 1e-6).select("label", "dim", "tile", "other")
    data = tiles.select("label", "dim", "tile", "ids", "sizes", "vectors")
    second = data.select("label", "dim", F.col("tile").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("ids", "sizes", "vectors")])
    both = pairs.join(second, ["label", "dim", "other"]).join(data, ["label", "dim", "tile"])
    return both.mapInArrow(_compare(axes, kind, threshold), "cls long, links long, near long")
