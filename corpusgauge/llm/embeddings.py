"""Near duplicates among vectors: epsilon grid order and a join of sequence intervals."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corpusgauge.llm.components import components, local_roots
from corpusgauge.llm.shared import new_folder, place, stored

#: Vectors that the principal axes are fitted on, at most; they only set the order, never the result.
FIT_ROWS = 20_000
#: Leading axes with a grid, vectors of a block, and intervals at most that the driver compares.
GRID_AXES, BLOCK_ROWS, MAX_INTERVALS = 4, 2048, 2048
#: What a task holds at most of one side: blocks, and their bytes. Blocks of the other side that it reads one after another.
LEFT_BLOCKS, LEFT_BYTES, RIGHT_BLOCKS = 8, 1 << 24, 64
#: Intervals that a table of so many blocks has at least, so that there is work for many tasks, and tasks of the join at most.
LEAST_INTERVALS, MAX_TASKS = 24, 100_000


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors in double precision, NaN for null elements; rows of NaN where a vector is null or of another width."""
    out = np.full((len(vectors), width), np.nan)
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    out[fits.to_numpy(zero_copy_only=False)] = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of NaN where one is zero or not finite."""
    with np.errstate(all="ignore"):
        out = rows / np.abs(rows).max(axis=1, keepdims=True)
        out = out / np.sqrt((out * out).sum(axis=1, keepdims=True))
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def _unit(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one in double precision; rows of NaN where a vector is null, zero, not finite, or of another width."""
    return _scaled(_matrix(vectors, width))


def principal_axes(df: DataFrame, vector: str, width: int, rows: int = FIT_ROWS) -> np.ndarray:
    """Axes of a bounded sample, the widest first."""
    n = df.count()
    sample = df if n <= rows else df.sample(fraction=min(1.0, rows / n), seed=11)
    found = [_unit(b.column(0), width) for b in sample.select(F.col(vector)).limit(2 * rows).toArrow().to_batches()]
    x = np.concatenate([*found, np.zeros((0, width))])
    x = x[~np.isnan(x).any(axis=1)]
    if len(x) < 2:
        return np.eye(width)
    x = x - x.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def interval_pairs(low: np.ndarray, high: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Pairs i <= j of intervals of the order that may hold points within reach: halves are compared by their bounding boxes, and distant ones left out whole."""
    n = len(low)
    if not n:
        return []
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in boxes:
            boxes[a, b] = low[a:b].min(axis=0), high[a:b].max(axis=0)
        return boxes[a, b]

    out, todo = [], [((0, n), (0, n))]
    while todo:
        x, y = todo.pop()
        (lx, hx), (ly, hy) = box(*x), box(*y)
        gap = np.maximum(0, np.maximum(lx - hy, ly - hx))
        if x != y and (gap * gap).sum() > reach * reach:
            continue
        parts = [[(a, b)] if b - a == 1 else [(a, (a + b) // 2), ((a + b) // 2, b)] for a, b in (x, y)]
        if len(parts[0]) == len(parts[1]) == 1:
            out.append((x[0], y[0]))
        else:
            todo += [(p, q) for p in parts[0] for q in parts[1] if p <= q]
    return sorted(out)


@dataclass
class _Layout:
    """Where the vectors in order lie: a file per partition, in blocks of BLOCK_ROWS, each the corners of its box and its vectors."""

    width: int
    kind: np.dtype
    rows: int
    files: list[str]
    sizes: np.ndarray

    def __post_init__(self) -> None:
        self.nodes = np.cumsum([0, *self.sizes])
        self.blocks = np.cumsum([0, *-(-self.sizes // self.rows)])

    def read(self, block: int, near: Callable[[np.ndarray, np.ndarray], bool] = lambda low, high: True) -> _Block | None:
        """A block, or nothing if its box is not near."""
        part = int(np.searchsorted(self.blocks, block, side="right")) - 1
        at = (block - int(self.blocks[part])) * self.rows
        n = min(self.rows, int(self.sizes[part]) - at)
        fs, path = place(self.files[part])
        head, row = 16 * self.width, self.kind.itemsize * self.width
        with fs.open_input_file(path) as f:
            f.seek(at // self.rows * head + at * row)
            low, high = np.frombuffer(f.read(head)).reshape(2, -1)
            if not near(low, high):
                return None
            raw = np.frombuffer(f.read(n * row), self.kind).reshape(-1, self.width)
        return _Block(int(self.nodes[part]) + at, low, high, raw, _scaled(raw.astype(float)).astype(np.float32))


@dataclass
class _Block:
    """Vectors that follow each other in the order: the number of the first, their box, as read, and of length one."""

    first: int
    low: np.ndarray
    high: np.ndarray
    raw: np.ndarray
    unit: np.ndarray

    def near(self, low: np.ndarray, high: np.ndarray, reach: float) -> bool:
        gap = np.maximum(0, np.maximum(self.low - high, low - self.high))
        return bool((gap * gap).sum() <= reach * reach)


def _hits(a: _Block, b: _Block, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of two blocks in strips. Single precision settles what is clear of the limit by more than its error, double the rest."""
    error = 1.2e-7 * (a.unit.shape[1] + 4)
    for i in range(0, len(a.unit), 512):
        cosine = a.unit[i : i + 512] @ b.unit.T
        x, y = np.nonzero(cosine >= least - error)
        unsure = np.flatnonzero(cosine[x, y] < least + error)
        wrong = [np.zeros(0, np.int64)]
        for j in range(0, len(unsure), 65536):
            at = unsure[j : j + 65536]
            exact = np.einsum("ij,ij->i", _scaled(a.raw[i + x[at]].astype(float)), _scaled(b.raw[y[at]].astype(float)))
            wrong.append(at[exact < least])
        wrong = np.concatenate(wrong)
        yield np.delete(x, wrong) + i, np.delete(y, wrong)


def _join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the ends of some edges; `root` has the smallest place that each place reaches."""
    while True:
        u, v = root[x], root[y]
        far = u != v
        if not far.any():
            return
        x, y, u, v = x[far], y[far], u[far], v[far]
        # one edge per end at a time: the rest is mostly joined by then
        one = np.full((2, len(root)), -1)
        one[0, u] = one[1, v] = np.arange(len(u))
        one = np.unique(one[one >= 0])
        nodes, roots = local_roots(u[one], v[one])
        to = np.arange(len(root))
        to[nodes] = roots
        root[:] = to[root]


def _links(layout: _Layout, own: range, others: list[range], least: float, reach: float) -> Iterator[pa.RecordBatch]:
    """Links of the vectors of some blocks with those of others, which don't stand before them: per vector how many, and one that it reaches."""

    def batch(nodes: np.ndarray, counts: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts), pa.array(roots)], ["node", "n", "root"])

    held = max(1, min(LEFT_BLOCKS, LEFT_BYTES // (4 * layout.width * layout.rows)))
    for start in range(own.start, own.stop, held):
        left = [layout.read(k) for k in range(start, min(own.stop, start + held))]
        places = np.cumsum([0, *[len(x.unit) for x in left]])
        count, root = np.zeros(places[-1] + layout.rows, np.int64), np.arange(places[-1] + layout.rows)
        node = np.concatenate([x.first + np.arange(len(x.unit)) for x in left])
        for k in (k for other in others for k in other if k >= start):
            inside = k - start < len(left)
            block = left[k - start] if inside else layout.read(k, lambda low, high: any(x.near(low, high, reach) for x in left))
            if block is None:
                continue
            base = places[k - start] if inside else places[-1]
            for j, x in enumerate(left[: k - start + 1]):
                if not x.near(block.low, block.high, reach):
                    continue
                for a, b in _hits(x, block, least):
                    if x is block:
                        a, b = a[a != b], b[a != b]
                    if not len(a):
                        continue
                    a, b = a + places[j], b + base
                    count += np.bincount(a, minlength=len(count))
                    if x is not block:
                        count += np.bincount(b, minlength=len(count))
                    _join(root, a, b)
            if not inside:
                linked = np.flatnonzero(count[base:])
                if len(linked):
                    yield batch(block.first + linked, count[base + linked], node[root[base + linked]])
                count[base:], root[base:] = 0, np.arange(base, len(root))
        linked = np.flatnonzero(count[: places[-1]])
        if len(linked):
            yield batch(node[linked], count[linked], node[root[linked]])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in tables of so many, the last one shorter."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, rows - n))
            b, n = b.slice(rows - n), n + held[-1].num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(df: DataFrame, key: str, vector: str, least: float = 0.9) -> DataFrame:
    """Every row of `df` (key, vector) with n_links, component_id and kept.

    Two rows link if the cosine of their vectors in double precision is at least `least`. component_id is the smallest
    key reachable by links, kept tells whether that is the row's own. Null, zero and not finite vectors, and those of another width than
    most, link with nothing. Rows with equal keys count one by one; null keys are never smallest unless alone.

    Vectors are sorted by the cells of an epsilon grid on the leading principal axes and written once, in this order, to files
    of blocks on the shared folder. Intervals of blocks are joined where their boxes come within epsilon: a task holds blocks of
    one interval and reads those of others from the files one by one, so no vector is copied for the pairs it may be in. It sends on one
    row per vector with a link. What the driver holds is bounded: axes, and boxes of at most MAX_INTERVALS intervals.
    """
    spark = df.sparkSession
    sizes_seen = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sizes_seen["n"] if sizes_seen else 1
    axes = principal_axes(df.where(F.col(vector).isNotNull()), vector, width)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) * (1 + 1e-9) + 1e-9
    cells = [f"c{i}" for i in range(min(GRID_AXES, width))]
    # what is given in single precision is written so, and read into the same doubles
    single = isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind, rows = np.dtype(np.float32 if single else np.float64), BLOCK_ROWS

    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _matrix(b.column(1), width)
            unit = _scaled(raw)
            ok = ~np.isnan(unit).any(axis=1)
            turned = unit[ok] @ axes
            grid = np.floor(turned[:, : len(cells)] / max(reach, 1e-6)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column(0)).filter(pa.array(ok)), *[pa.array(grid[:, i]) for i in range(len(cells))], pa.array(turned[:, 0]),
                 pa.array([v.tobytes() for v in raw[ok].astype(kind)], pa.binary())], ["key", *cells, "lead", "raw"])

    schema = "key long, " + ", ".join(f"{c} int" for c in cells) + ", lead double, raw binary"
    order = [*cells, "lead", "raw", "key"]
    table = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v")).mapInArrow(gridded, schema)
    folder = new_folder(spark, "vectors")

    def laid_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # a repeated attempt has a file of its own, which only its own rows name
        part, at, name, out = TaskContext.get().partitionId(), 0, f"{folder}/{uuid.uuid4().hex}", None
        for b in _blocks(batches, rows):
            if out is None:
                fs, path = place(name)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path)
            raw, n = b"".join(b.column("raw").to_pylist()), b.num_rows
            turned = _scaled(np.frombuffer(raw, kind).reshape(-1, width).astype(float)) @ axes
            corners = [turned.min(axis=0), turned.max(axis=0)]
            out.write(b"".join([*[x.tobytes() for x in corners], raw]))
            box = [pa.array([x.tolist(), *[None] * (n - 1)], pa.list_(pa.float64())) for x in corners]
            key_ = b.column("key").combine_chunks()
            yield from pa.Table.from_arrays([key_, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array([name, *[None] * (n - 1)], pa.string()), *box], ["key", "part", "at", "file", "low", "high"]).to_batches()
            at += n
        if out is not None:
            out.close()

    ranked = stored(table.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(laid_down, "key long, part int, at long, file string, low array<double>, high array<double>"), "ordered")
    # one row per partition each
    parts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    files = ranked.where("at = 0").select("part", "file").orderBy("part").collect()
    layout = _Layout(width, kind, rows, [r["file"] for r in files], np.array([r["n"] for r in parts], np.int64))
    n_blocks = int(layout.blocks[-1])
    run = max(1, min(LEFT_BLOCKS, n_blocks // LEAST_INTERVALS), -(-n_blocks // MAX_INTERVALS))  # blocks of an interval
    before = spark.createDataFrame([(r["part"], int(s), int(k)) for r, s, k in zip(parts, layout.nodes, layout.blocks, strict=False)], "part int, before long, blocks long")
    placed = ranked.join(F.broadcast(before), "part").withColumn("node", F.col("before") + F.col("at"))
    spread = placed.where("file is not null").withColumn("interval", F.floor((F.col("blocks") + F.floor(F.col("at") / rows)) / run).cast("int"))
    joined = spread.groupBy("interval").agg(*[F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c) for c, f in (("low", F.min), ("high", F.max))])
    found = joined.orderBy("interval").collect()  # at most MAX_INTERVALS rows
    pairs = interval_pairs(np.array([r["low"] for r in found]), np.array([r["high"] for r in found]), reach)
    chunk, near = max(1, RIGHT_BLOCKS // run), {}
    for i, j in pairs:
        near.setdefault(i, []).append(j)
    units = [(i, js[k : k + chunk]) for i, js in near.items() for k in range(0, len(js), chunk)]
    # a task each: what one of them joins doesn't grow with the table
    work = spark.createDataFrame([(at, i, js) for at, (i, js) in enumerate(units)], "unit long, i int, js array<int>").repartitionByRange(min(max(1, len(units)), MAX_TASKS), "unit")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit in b.to_pylist():
                own, *others = (range(i * run, min(n_blocks, (i + 1) * run)) for i in (unit["i"], *unit["js"]))
                yield from _links(layout, own, others, least, reach)

    linked = stored(work.mapInArrow(links, "node long, n long, root long"), "links")
    counts = linked.groupBy("node").agg(F.sum("n").alias("n_links"))
    groups = components(linked, "node", "root")
    keyed = placed.select("node", "key").join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = keyed.where("n_links is not null").groupBy("component").agg(F.min("key").alias("least_key"))
    good = keyed.join(smallest, "component", "left").select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least_key", "key").alias("component_id"))
    return _with_bad(df, key, vector, width, good)


def _with_bad(df: DataFrame, key: str, vector: str, width: int, good: DataFrame) -> DataFrame:
    """Adds the rows whose vectors link with nothing."""
    v = F.col("v")
    fine = F.coalesce(v.isNotNull() & (F.size(v) == width) & F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    bad = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(~fine).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return good.unionByName(bad).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
