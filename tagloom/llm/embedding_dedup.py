"""Operator 5, embedding near-dedup: an exact metric range join.

On unit vectors cosine >= c is distance <= r with r^2 = 2 (1 - c). Pivots (a
bounded sample of the vectors) partition the vectors: each has its home in the
cell of its nearest pivot. By the triangle inequality a vector y can only be
within r of a vector x with home i if

    (d(y, p_i) - d(y, p_home)) / 2 <= r     and     d(y, p_i) <= R_i + r

where R_i is the cell's radius (the largest distance of a home vector to its
pivot). The home vectors of a cell are packed into blocks of ``TILE`` at most,
with the cells that some of them can reach; two blocks that reach each other's
cells meet in a row read from the stored blocks, so vectors are shuffled once,
by cell, whatever can be pruned. A task holds the rows of a few pairs of
blocks, and a hot cell spreads over many tasks. Nothing is dropped.

Equal vectors are one row with a count, so copies are never expanded. A pair of
blocks returns, per vector, the number of linked vectors, and a spanning forest of
its links (not all pairs), from which the components follow.

On vectors without clusters (random directions in many dimensions) no metric
bound can prune: each two blocks then meet and the work is that of all pairs. That is a property of the exact join.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing and are components of their own;
vectors of different lengths never link; repeated rows are copies of each
other; a null vec_id is counted as a vector but names a component only if all
members are null; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import components, staged
from tagloom.session import Rounds

COSINE = 0.9
#: most pivots (one per ``TILE`` vectors up to this), and vectors drawn per pivot
PIVOTS = 4096
DRAWN = 4
TILE = 4096
#: pairs this close to the limit are decided again by the plain formula
EDGE = 1e-9


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine of two equally long matrices."""
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def units(vectors) -> np.ndarray:
    m = vectors.astype(np.float64) if isinstance(vectors, np.ndarray) else np.array([np.asarray(v, np.float64) for v in vectors])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def pick_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal from the first vector."""
    chosen = [0]
    far = 1 - vectors @ vectors[0]
    while len(chosen) < min(n, len(vectors)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (m @ pivots.T)))


def _rows(column, dim: int) -> np.ndarray:
    """A list column of vectors of one length as a matrix."""
    return np.asarray(column.flatten()).reshape(-1, dim)


def _homes(pivots: dict[int, np.ndarray]):
    """Rows with the cell of the nearest pivot and the distance to it."""
    def run(batches):
        for b in batches:
            for dim, at in _by_dim(b):
                part = b.take(pa.array(at))
                d = _distances(units(_rows(part.column("embedding"), dim)), pivots[dim])
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int32()), pa.array(d[np.arange(len(home)), home])],
                                                 names=[*part.schema.names, "cell", "distance"])
    return run


def _by_dim(b: pa.RecordBatch):
    dims = np.asarray(b.column("dim"))
    return [(int(x), np.flatnonzero(dims == x)) for x in np.unique(dims)]


SLACK = 1e-9


def _pack(pivots: dict[int, np.ndarray], radius: dict, place: dict, r: float):
    """A block's vectors as one row, with the places of the cells that some of
    them can reach (``place`` numbers the cells)."""
    def run(t: pa.Table) -> pa.Table:
        dim, cell = t.column("dim")[0].as_py(), t.column("cell")[0].as_py()
        m = _rows(t.column("embedding").combine_chunks(), dim)
        d = _distances(units(m), pivots[dim])
        reach = np.array([radius.get((dim, c), -1.0) for c in range(d.shape[1])])
        near = ((d - d[:, cell:cell + 1]) / 2 <= r + SLACK) & (d <= reach + r + SLACK) & (reach >= 0)
        to = sorted({place[dim, int(c)] for c in np.flatnonzero(near.any(axis=0))} | {place[dim, cell]})
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "at": pa.array([place[dim, cell]], pa.int32()),
                         "reach": pa.array([to], pa.list_(pa.int32())), "node": pa.array([t.column("node").to_pylist()], pa.list_(pa.int64())),
                         "n": pa.array([t.column("n").to_pylist()], pa.list_(pa.int64())), "vec": pa.array([m.tobytes()], pa.binary())})
    return run


_PACKED = "dim int, cell int, at int, reach array<int>, node array<long>, n array<long>, vec binary"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reachable) of the graph with edges a - b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            break
        low = new
    off = low != np.arange(len(nodes))
    return nodes[off], nodes[low[off]]


def _reaches(x: np.ndarray, own: np.ndarray, other: np.ndarray, radius: float, r: float) -> np.ndarray:
    """Places of the home vectors x of the pivot ``own`` that can be within r
    of a vector whose home is the pivot ``other``."""
    d, home = _distances(x, other[None])[:, 0], _distances(x, own[None])[:, 0]
    return np.flatnonzero(((d - home) / 2 <= r + SLACK) & (d <= radius + r + SLACK))


def _pairs(least: float, pivots: dict[int, np.ndarray], radius: dict, r: float, kind: type):
    """Rows (node, links, to) of rows that hold two blocks."""
    def side(b: pa.RecordBatch, i: int, end: str):
        get = lambda c: b.column(c + end)[i]
        dim, cell = get("dim").as_py(), get("cell").as_py()
        raw = np.frombuffer(get("vec").as_buffer(), kind).reshape(-1, dim)
        return dim, cell, raw, units(raw), np.asarray(get("node").values), np.asarray(get("n").values)

    def met(one, two, same: bool) -> pa.RecordBatch:
        (dim, cx, raw_x, x, a, n), (_, cy, raw_y, y, b, m) = one, two
        p = pivots[dim]
        at_x, at_y = np.arange(len(a)), np.arange(len(b))
        if cx != cy:
            at_x, at_y = _reaches(x, p[cx], p[cy], radius[dim, cy], r), _reaches(y, p[cy], p[cx], radius[dim, cx], r)
        links_x, links_y = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        from_, to, sub = [], [], y[at_y]
        for lo in range(0, len(at_x) if len(at_y) else 0, 512):
            c = x[at_x[lo:lo + 512]] @ sub.T
            i, j = np.nonzero(c >= least - EDGE)
            close = np.abs(c[i, j] - least) < EDGE
            i, j = at_x[i + lo], at_y[j]
            ok = a[i] != b[j]
            for k in np.flatnonzero(close & ok):
                ok[k] = cosine(raw_x[i[k]].astype(float)[None], raw_y[j[k]].astype(float)[None])[0] >= least
            i, j = i[ok], j[ok]
            np.add.at(links_x, i, m[j])
            if not same:
                np.add.at(links_y, j, n[i])
            if len(i):
                f, t = forest(a[i], b[j])
                from_.append(f)
                to.append(t)
        f, t = forest(np.concatenate(from_), np.concatenate(to)) if from_ else (np.zeros(0, int), np.zeros(0, int))
        hit, hit_y = np.flatnonzero(links_x), np.flatnonzero(links_y)
        col = lambda *v: pa.array(np.concatenate(v), pa.int64())
        return pa.RecordBatch.from_arrays([col(a[hit], b[hit_y], f), col(links_x[hit], links_y[hit_y], np.zeros(len(f), np.int64)),
                                           col(a[hit], b[hit_y], t)], names=["node", "links", "to"])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield met(side(b, i, ""), side(b, i, "_"), b.column("block")[i] == b.column("block_")[i])
    return run


def digest(column: str, kind) -> Column:
    """32 bytes in place of a vector; equal for equal ones (0 and -0 are equal)."""
    return F.unhex(F.sha2(F.to_json(F.struct(F.transform(column, lambda x: x + F.lit(0).cast(kind.elementType)))), 256))


def linkable(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding) with ``ok``."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "embedding", F.coalesce(finite & some, F.lit(False)).alias("ok"))


def group(vectors: DataFrame, least: float = COSINE, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = linkable(vectors)
    classes = rows.filter("ok").groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    # what blocks hold: numbers as they are, other kinds as doubles
    kind = classes.schema["embedding"].dataType
    single = kind.elementType.simpleString() == "float"
    vec = F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding")
    # a class's node is a number of its own, fixed by writing it; from its row on, a vector is told by its digest
    numbered = Rounds(vectors.sparkSession)
    nodes = numbered.keep(classes.select("n", "first_id", F.size("embedding").cast("int").alias("dim"), F.monotonically_increasing_id().alias("node"),
                                         digest("embedding", kind).alias("vec"), vec))
    n_pivots = min(pivots, -(-nodes.count() // tile))
    drawn = nodes.select("dim", "embedding").orderBy(F.xxhash64("embedding")).limit(DRAWN * n_pivots).collect()
    dims = [r["dim"] for r in nodes.select("dim").distinct().collect()]
    seeds = {d: [x["embedding"] for x in drawn if x["dim"] == d] for d in dims}
    for d in dims:  # a length that the sample misses gets one pivot
        seeds[d] = seeds[d] or [nodes.filter(F.col("dim") == d).select("embedding").first()[0]]
    picked = {d: pick_pivots(units(v), n_pivots) for d, v in seeds.items()}
    r = float(np.sqrt(2 - 2 * least))
    # written: a vector between two pivots has one home
    homes = staged(nodes.mapInArrow(_homes(picked), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
                                    + ", cell int, distance double"), "vector-homes")
    numbered.drop()
    # at most one row per pivot
    cells = homes.groupBy("dim", "cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()
    radius = {(c["dim"], c["cell"]): c["radius"] for c in cells}
    place = {k: i for i, k in enumerate(sorted(radius))}
    large = {place[c["dim"], c["cell"]]: -(-c["n"] // tile) for c in cells if c["n"] > tile}  # these have several blocks
    at = F.create_map(*[F.lit(x) for (dim, cell), i in place.items() for x in (f"{dim} {cell}", i)])
    parts = F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[at[F.concat_ws(" ", "dim", "cell")]] if large else F.lit(1)
    packed = homes.select("dim", "cell", F.pmod(F.xxhash64("node"), F.coalesce(parts, F.lit(1))).alias("part"), "node", "n", "embedding") \
        .groupBy("dim", "cell", "part").applyInArrow(_pack(picked, radius, place, r), _PACKED)
    packed = staged(packed.withColumn("block", F.monotonically_increasing_id()), "vector-blocks", **{"parquet.block.size": str(1 << 20)})
    other = packed.select(*[F.col(c).alias(f"{c}_") for c in packed.columns]).hint("shuffle_replicate_nl")
    near = F.array_contains("reach", F.col("at_")) & F.array_contains("reach_", F.col("at"))
    found = staged(packed.join(other, (F.col("block") <= F.col("block_")) & near).mapInArrow(
        _pairs(least, picked, radius, r, np.float32 if single else np.float64), "node long, links long, to long"), "vector-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.filter("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")), "vector-edges")
    named = homes.select("node", "vec", "n", "first_id").join(linked, "node", "left") \
        .join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = named.join(least_id, "component").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    good = rows.filter("ok").select("vec_id", digest("embedding", kind).alias("vec")).join(told, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
