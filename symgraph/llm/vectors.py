"""Exact near-duplicate vectors by a metric range join over pivots.

On unit vectors a cosine bound is a bound r on Euclidean distance. Each vector lives in
the cell of its nearest pivot p and is copied to the cell of another pivot q where a
partner could live: by the triangle inequality only if d(x, q) - d(x, p) <= 2r, and only
if x lies within r of the plane between p and q. Every cell then joins on its own, cut
into tiles where it is crowded. Inside a tile the same inequality holds for every pivot: what
asks is split into leaves of similar distances to the first WINDOWS pivots, and a leaf meets only
the vectors whose distances are within r of the leaf's for each of them. Cells belong to a label and a vector length, so one plan
serves all lengths. Equal vectors are one row with a count from the start, and vectors
travel as packed bytes. A tile compares in single precision with a margin for its
rounding; what passes is decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.llm.components import connected_components, local_forest
from symgraph.storage import materialize

#: Fewest and most pivots (a few MB in a task's closure), and vectors of the largest label and length for each pivot, about.
FEWEST, PIVOTS, PER_PIVOT = 8, 2048, 16_384
#: Pivots whose distances a tile compares, those it splits by, and vectors of a leaf at most.
WINDOWS, SPLITS, LEAF = 8, 3, 128
#: Most vectors on one side of a tile.
TILE = 8192
#: Rows placed at once; pairs held at once.
BAND, PAIRS = 1024, 1_000_000
SLACK = 1e-9


def _units(packed: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors of one length as unit rows in double precision."""
    x = np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), -1).astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def pack(rows: DataFrame) -> tuple[DataFrame, str]:
    """rows(id, label, vector) as (id, label, vector, dim) with packed bytes, and their number format.

    The packed vector is null where the row can link with nothing: id, label or vector
    unknown, no components, one unknown or not finite, or all zero.
    """
    kind = "<f4" if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else "<f8"
    rows = rows if kind == "<f4" else rows.withColumn("vector", F.col("vector").cast("array<double>"))
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("vector", T.BinaryType()), T.StructField("dim", T.IntegerType())])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            column = batch.column(2)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            full = np.concatenate([[0], np.cumsum(values != 0)])
            known = pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()).to_numpy(zero_copy_only=False)
            good = known & (wrong[ends] == wrong[starts]) & (full[ends] > full[starts])
            raw, width = values.tobytes(), values.itemsize
            held = [raw[a * width : b * width] if ok else None for a, b, ok in zip(starts.tolist(), ends.tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary()), pa.array(sizes, pa.int32())], schema.names)

    return rows.mapInArrow(batches, schema), kind


def _leaves(distance: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of at most LEAF, halved by the widest of the SPLITS columns that vary most."""
    columns = np.argsort(-distance.var(axis=0))[:SPLITS] if len(distance) else []
    open_ = [np.arange(len(distance))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF or not len(columns):
            if len(rows):
                yield rows
            continue
        held = distance[rows][:, columns]
        widest = columns[np.ptp(held, axis=0).argmax()]
        order = rows[np.argsort(distance[rows, widest], kind="stable")]
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]


def near_links(classes: DataFrame, kind: str, cosine: float, pivots: int | None = None, tile: int = TILE) -> DataFrame:
    """(id, links, root, compared) for the distinct vectors of classes(id, label, vector, dim, copies).

    links is the number of vectors in other classes within the bound, copies counted, in
    parts that sum up by id; (id, root) are edges of a forest that joins what links. A row
    without id has the number of pairs that a tile compared, either way round.
    """
    radius = float(np.sqrt(2 - 2 * cosine)) + SLACK
    largest = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    count = pivots or int(min(PIVOTS, max(FEWEST, largest // PER_PIVOT)))
    # A bounded sample: the vectors whose hash comes first. A length without a pivot is one cell.
    chosen = classes.select("dim", "vector").orderBy(F.xxhash64("vector"), "vector").limit(count).collect()
    centres: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in chosen}:
        at = [i for i, r in enumerate(chosen) if r.dim == dim]
        centres[dim] = np.array(at, np.int32), _units(pa.array([bytes(chosen[i].vector) for i in at], pa.binary()), kind)

    schema = T.StructType([*classes.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType())])

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for lo in range(0, whole.num_rows, BAND):
                batch = whole.slice(lo, BAND)
                dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
                for dim in np.unique(dims).tolist():
                    some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                    row, cell, home = _cells(some.column(some.schema.get_field_index("vector")), centres.get(dim))
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(row)).columns, pa.array(cell, pa.int32()), pa.array(home)], schema.names)

    def _cells(packed: pa.Array, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every = np.arange(len(packed))
        if known is None:
            return every, np.full(len(every), -1, np.int32), np.ones(len(every), bool)
        number, centre = known
        between = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 0))
        squared = np.maximum(2 - 2 * _units(packed, kind) @ centre.T, 0)
        home = squared.argmin(axis=1)
        least = squared[every, home]
        gap = np.maximum(between[home], 1e-12)
        reach = (np.sqrt(squared) - np.sqrt(least)[:, None] <= 2 * radius) & ((squared - least[:, None]) / (2 * gap) <= radius)
        reach[every, home] = True
        row, cell = np.nonzero(reach)
        return row, number[cell], home[row] == cell

    key = ["label", "dim", "cell"]
    placed = materialize(classes.mapInArrow(place, schema), "vector-cells")
    crowd = placed.groupBy(*key).agg(F.ceil(F.sum(F.col("home").cast("int")) / tile).cast("int").alias("rows"), F.ceil(F.count("*") / tile).cast("int").alias("cols"))
    dealt = placed.join(crowd.where("rows > 0"), key)
    spread = F.xxhash64("id")
    row, col = F.pmod(spread, "rows").cast("int"), F.pmod(F.shiftright(spread, 16), F.col("cols")).cast("int")
    # A home vector asks in its row of tiles; every vector answers in its column; where both meet it travels once.
    as_row = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: F.struct(row.alias("i"), j.alias("j"), F.lit(True).alias("asks"), (j == col).alias("answers"))))
    as_col = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), col.alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers")))
    as_col = F.filter(as_col, lambda t: ~(F.col("home") & (t["i"] == row)))
    none = F.array().cast("array<struct<i:int,j:int,asks:boolean,answers:boolean>>")
    tiles = dealt.select(*key, "id", "copies", "vector", F.explode(F.concat(F.coalesce(as_row, none), as_col)).alias("t")).select(*key, "t.*", "id", "copies", "vector")

    def compare(table: pa.Table) -> pa.Table:
        asks, answers = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("asks", "answers"))
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy().astype(np.int64)
        unit = _units(table.column("vector").combine_chunks(), kind)
        short = unit.astype(np.float32)
        least = cosine - max(1e-5, unit.shape[1] * 2.5e-7)
        links, compared = np.zeros(len(ids), np.int64), 0
        node, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = centres.get(unit.shape[1])
        distance = np.sqrt(np.maximum(2 - 2 * unit @ known[1][:WINDOWS].T, 0)) if known else np.zeros((len(ids), 0))
        near_to = distance[answers]
        for leaf in _leaves(distance[asks]):
            some = asks[leaf]
            low, high = (distance[some].min(axis=0) - reach, distance[some].max(axis=0) + reach) if known else (0, 0)
            others = answers[((near_to >= low) & (near_to <= high)).all(axis=1)]
            compared += len(some) * len(others)
            x, y = np.nonzero(short[some] @ short[others].T >= least)
            for at in range(0, len(x), PAIRS):
                a, b = some[x[at : at + PAIRS]], others[y[at : at + PAIRS]]
                near = (np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine) & (ids[a] != ids[b])
                a, b = a[near], b[near]
                np.add.at(links, a, copies[b])
                node, root = local_forest(np.concatenate([node, ids[a]]), np.concatenate([root, ids[b]]))
        hit = np.flatnonzero(links)
        return pa.table({
            "id": pa.array([*ids[hit].tolist(), *node.tolist(), None], pa.int64()),
            "links": pa.array([*links[hit].tolist(), *[0] * (len(node) + 1)], pa.int64()),
            "root": pa.array([*[None] * len(hit), *root.tolist(), None], pa.int64()),
            "compared": pa.array([*[None] * (len(hit) + len(node)), compared], pa.int64()),
        })

    reach = radius + 1e-6  # distances are rounded
    return tiles.groupBy(*key, "i", "j").applyInArrow(compare, "id long, links long, root long, compared long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", pivots: int | None = None, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; only equal labels are compared.

    Vectors link at a cosine of at least `cosine`, in double precision. A null id, label or
    vector, a zero vector, and one with a null or non-finite component links with nothing
    and is its own component. Vectors of different lengths never link. Rows that repeat
    an id with an equal vector count as vectors of their own; ids are integers and else taken as unique.
    Other columns are ignored; an empty table stays empty.
    """
    rows, kind = pack(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")))
    rows = materialize(rows, "vectors")
    good = rows.where("vector is not null")
    classes = materialize(good.groupBy("label", "dim", "vector").agg(F.min("id").alias("first"), F.count("*").alias("copies")).select(F.col("first").alias("id"), "label", "vector", "dim", "copies"), "vector-classes")
    found = materialize(near_links(classes, kind, cosine, pivots, tile), "vector-links")
    counts = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, "id", "left").join(comps, F.col("id") == F.col("node"), "left").select(
        F.col("label").alias("l"), F.col("vector").alias("v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c")
    )
    linked = good.join(known, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
