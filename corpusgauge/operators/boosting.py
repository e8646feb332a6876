"""Many small classifiers over one table at a time: boosted trees and ridge logistic regressions.

Every feature set, every fold and the fit behind the importances is a fit of its own, on its own rows and columns. They grow together:
one pass over the table gives the histograms of one level of one tree of all fits, or the slopes of all regressions,
summed per task first, and what reaches the driver is a table whose size depends on fits, features and bins alone. So the
number of passes does not depend on how many fits there are, and no task or driver ever holds the rows. The passes of the trees read
the rows in blocks of arrays, so that nothing is turned from rows into arrays again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpusgauge.caching import keep, written

#: Bins of a feature, levels of a tree, least rows of a leaf, shrinkage of a tree's values, least curvature that is divided by.
BINS, DEPTH, LEAF_ROWS, RATE, LEAST_CURVATURE = 64, 4, 20, 0.1, 1e-3
#: Trees after which the rows' sums so far are kept beside them, and trees after which they are written, so that plans stay short.
REFRESH, WRITTEN = 5, 25
#: Partial tables that the driver adds up itself; more are added up by tasks first.
PARTIALS = 64
#: Rows of a block.
BLOCK_ROWS = 10_000
NEWTON_STEPS, SETTLED = 40, 1e-8


@dataclass
class Fit:
    """One model: columns of `x` it may use, the set whose complete rows it takes, and the fold held out (None: the quarter)."""

    columns: list[int]
    of_set: int
    fold: int | None
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def since(self, tree: int) -> Fit:
        """The fit with its trees from one on: all that a pass has to take along."""
        return Fit(self.columns, self.of_set, self.fold, self.base, self.feature[tree:], self.cut[tree:], self.value[tree:])

    def trains(self, rows: Rows | Block) -> np.ndarray:
        return rows.complete[:, self.of_set] & (rows.fold != self.fold if self.fold is not None else ~rows.quarter)


@dataclass
class Rows:
    """A batch as arrays."""

    x: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    quarter: np.ndarray
    complete: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Rows:
        def flat(name: str) -> np.ndarray:
            return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)

        bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(len(b), -1)
        one = [b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "quarter")]
        return cls(flat("x"), bins, *one, flat("complete").astype(bool))


@dataclass
class Block:
    """Some rows as arrays that need no turning: a row of `bins` per feature and of `margin` per fit (None: all at the bases)."""

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    quarter: np.ndarray
    complete: np.ndarray
    margin: np.ndarray | None

    @classmethod
    def each(cls, b: pa.RecordBatch) -> Iterator[Block]:
        types = {"bins": np.uint8, "y": float, "fold": np.int32, "quarter": bool, "complete": bool, "margin": float}
        for i in range(len(b)):
            n = b.column("n")[i].as_py()
            found = {c: np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in types.items()}
            margin = found["margin"].reshape(-1, n) if len(found["margin"]) else None
            # complete: a row per row, as in Rows
            yield cls(found["bins"].reshape(-1, n), found["y"], found["fold"], found["quarter"], found["complete"].reshape(-1, n).T, margin)


def _packed(table: DataFrame) -> DataFrame:
    """The table's rows in blocks, a row each, without x and with room for margins."""
    columns = ["bins", "y", "fold", "quarter", "complete"]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        rows = [np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(len(t), -1).T, t.column("y").to_numpy().astype(float), t.column("fold").to_numpy().astype(np.int32),
                t.column("quarter").to_numpy().astype(bool), t.column("complete").combine_chunks().flatten().to_numpy().reshape(len(t), -1).T > 0]
        return pa.RecordBatch.from_arrays([pa.array([len(t)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in rows], pa.array([b""], pa.binary())], ["n", *columns, "margin"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, BLOCK_ROWS - n))
                b, n = b.slice(BLOCK_ROWS - n), n + held[-1].num_rows
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return table.select(*columns).mapInArrow(go, "n int, " + ", ".join(f"{c} binary" for c in (*columns, "margin")))


def _leaf(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row after some levels of a tree, counted from 0 within the level; `columns`: the bins, a row per feature.

    A node without a split sends all to the left. Nodes are few and their comparisons are of bytes that lie together.
    """
    node = np.zeros(columns.shape[1], np.uint8)
    for level in range(levels):
        right = np.zeros(len(node), bool)
        for k in range(1 << level):
            at = (1 << level) - 1 + k
            if feature[at] >= 0:
                # a plain number: one of 64 bits would widen every byte
                right |= (node == k) & (columns[feature[at]] > int(cut[at]))
        node = 2 * node + right
    return node


def raw_scores(fit: Fit, bins: np.ndarray, trees: slice = slice(None)) -> np.ndarray:
    """Sum of some trees for binned rows, without the base."""
    return _scores(fit, np.ascontiguousarray(bins.T), trees)


def raw_tree(fit: Fit, columns: np.ndarray, tree: int) -> np.ndarray:
    """What one tree adds; `columns`: the bins, a row per feature."""
    return fit.value[tree][_leaf(columns, fit.feature[tree], fit.cut[tree], DEPTH)]


def _scores(fit: Fit, columns: np.ndarray, trees: slice = slice(None), only: np.ndarray | slice = slice(None)) -> np.ndarray:
    out = np.zeros(len(only) if isinstance(only, np.ndarray) else columns.shape[1])
    for feature, cut, value in zip(fit.feature[trees], fit.cut[trees], fit.value[trees], strict=True):
        out += value[_leaf(columns, feature, cut, DEPTH)[only]]
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _each(b: pa.RecordBatch) -> Iterator[Rows]:
    yield Rows.of(b)


def _added(table: DataFrame, parts: int, one: Callable[[Rows | Block], np.ndarray], size: int, each: Callable[[pa.RecordBatch], Iterator[Rows | Block]] = _each) -> np.ndarray:
    """Sum over all rows, in so many partitions, of the arrays that `one` gives for batches or for what `each` makes of one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                for rows in each(b):
                    total += one(rows)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    found = table.mapInArrow(partial, "sums binary")
    if parts > PARTIALS:

        def add(group: pa.Table) -> pa.Table:
            total = np.zeros(size)
            for x in group.column("sums"):
                total += np.frombuffer(x.as_buffer())
            return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

        share = F.pmod(F.spark_partition_id(), F.lit(PARTIALS))
        found = found.groupBy(share.alias("share")).applyInArrow(add, "sums binary")
    total = np.zeros(size)
    for x in found.toArrow().column(0):  # PARTIALS rows of a size that the fits set
        total += np.frombuffer(x.as_buffer())
    return total


def bin_cuts(df: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Where the bins of some columns end, from one pass of quantile sketches without missing values; a few numbers per column."""
    values = [F.col(c).cast("double") for c in names]
    found = df.select(*[F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(values)]).approxQuantile([f"c{i}" for i in range(len(names))], [i / BINS for i in range(1, BINS)], 0.25 / BINS)
    return [np.unique(np.array(c, float)) for c in found]


def with_bins(df: DataFrame, x: str, cuts: list[np.ndarray], out: str = "bins") -> DataFrame:
    """Adds the bin numbers of an array column as binary, a byte each: how many cuts lie below the value; a missing one is in the last bin."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(b.schema.get_field_index(x)).flatten().to_numpy().reshape(len(b), -1)
            bins = np.column_stack([np.where(np.isnan(v), BINS - 1, np.searchsorted(own, v)) for v, own in zip(values.T, cuts, strict=True)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([row.tobytes() for row in bins], pa.binary())], [*b.schema.names, out])

    return df.mapInArrow(go, StructType([*df.schema.fields, StructField(out, BinaryType())]))


def _grow(fit: Fit, sums: np.ndarray, level: int) -> None:
    """Chooses the splits of a level, or leaves nodes as they are, and the values of their children."""
    g, h, n = np.cumsum(sums, axis=-1)
    left = [x[:, :, :-1] for x in (g, h, n)]
    whole = [x[:, :1, -1:] for x in (g, h, n)]
    right = [w - x for w, x in zip(whole, left, strict=True)]

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / np.maximum(h, LEAST_CURVATURE)

    gain = worth(left[0], left[1]) + worth(right[0], right[1]) - worth(whole[0], whole[1])
    gain[(left[2] < LEAF_ROWS) | (right[2] < LEAF_ROWS)] = 0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    for node, (at, own) in enumerate(zip(best, flat[np.arange(len(flat)), best], strict=True)):
        i = (1 << level) - 1 + node
        f, c = divmod(int(at), gain.shape[2])
        split = own > 1e-10
        fit.feature[-1][i], fit.cut[-1][i] = (fit.columns[f], c) if split else (-1, 0)
        if level == DEPTH - 1:
            sides = [(left[0][node, f, c], left[1][node, f, c]), (right[0][node, f, c], right[1][node, f, c])] if split else [(whole[0][node, 0, 0], whole[1][node, 0, 0])] * 2
            fit.value[-1][2 * node : 2 * node + 2] = [-RATE * a / max(b, LEAST_CURVATURE) for a, b in sides]


def _histograms(block: Block, fits: list[Fit], level: int) -> np.ndarray:
    """Sums of slope, curvature and rows by node and bin of each fit's columns at a level of its last tree."""
    out, nodes = [], 1 << level
    whole: dict[int, tuple] = {}  # per set: its complete rows, taken out once for all its fits
    for j, fit in enumerate(fits):
        if fit.of_set not in whole:
            at = np.flatnonzero(block.complete[:, fit.of_set])
            whole[fit.of_set] = (slice(None), block.bins, block.y) if len(at) == len(block.y) else (at, np.take(block.bins, at, axis=1), block.y[at])
        at, columns, y = whole[fit.of_set]
        use = np.flatnonzero(block.fold[at] != fit.fold if fit.fold is not None else ~block.quarter[at])
        own = np.zeros((3, nodes, len(fit.columns), BINS))
        if len(use):
            margin = fit.base if block.margin is None else block.margin[j][at][use]
            p = sigmoid(margin + _scores(fit, columns, slice(-1), use))
            node = _leaf(columns, fit.feature[-1], fit.cut[-1], level)[use].astype(np.int64) * BINS
            weights = (p - y[use], p * (1 - p), None)
            for i, c in enumerate(fit.columns):
                cell = node + columns[c][use]
                for k, w in enumerate(weights):
                    own[k, :, i] = np.bincount(cell, w, minlength=nodes * BINS).reshape(nodes, BINS)
        out.append(own.ravel())
    return np.concatenate(out)


def boost(table: DataFrame, fits: list[Fit], rounds: int) -> None:
    """Grows `rounds` trees of every fit on the log loss. `table`: x, bins, y, fold, quarter, complete."""
    shapes = [(1 << level, sum(len(f.columns) for f in fits)) for level in range(DEPTH)]

    def odds(rows: Block) -> np.ndarray:
        use = np.stack([f.trains(rows) for f in fits])
        return np.concatenate([use.sum(axis=1), use @ rows.y])

    base = written(_packed(table), "blocks")
    parts = base.rdd.getNumPartitions()
    n, pos = np.split(_added(base, parts, odds, 2 * len(fits), Block.each), 2)
    for fit, a, b in zip(fits, n, pos, strict=True):
        share = min(max(b / max(a, 1), 1e-6), 1 - 1e-6)
        fit.base = float(np.log(share / (1 - share)))
    current, at_base, done = keep(base), 0, 0
    for r in range(rounds):
        if r - done == REFRESH:
            # each from the written table: one from the other would make plans that grow with the rounds
            newer, done, last = _with_margins(base, [f.since(at_base) for f in fits]), r, current
            if r - at_base == WRITTEN:
                newer = base = written(newer, "blocks")
                at_base = r
            current = keep(newer)
            current.count()
            last.unpersist()
        for fit in fits:
            fit.feature.append(np.full((1 << DEPTH) - 1, -1))
            fit.cut.append(np.zeros((1 << DEPTH) - 1, np.int64))
            fit.value.append(np.zeros(1 << DEPTH))
        for level, (nodes, width) in enumerate(shapes):
            recent = [f.since(done) for f in fits]

            def histograms(block: Block, level: int = level, recent: list[Fit] = recent) -> np.ndarray:
                return _histograms(block, recent, level)

            sums, at = _added(current, parts, histograms, 3 * nodes * width * BINS, Block.each), 0
            for fit in fits:
                size = 3 * nodes * len(fit.columns) * BINS
                _grow(fit, sums[at : at + size].reshape(3, nodes, len(fit.columns), BINS), level)
                at += size
    current.unpersist()


def _with_margins(table: DataFrame, fits: list[Fit]) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in enumerate(Block.each(b)):
                old = [f.base for f in fits] if block.margin is None else block.margin
                new = np.stack([m + _scores(f, block.bins) for f, m in zip(fits, old, strict=True)])
                yield b.slice(i, 1).set_column(b.schema.get_field_index("margin"), "margin", pa.array([new.tobytes()], pa.binary()))

    return table.mapInArrow(go, table.schema)


@dataclass
class Line:
    """A fitted logistic regression over raw values."""

    columns: list[int]
    weights: np.ndarray
    bias: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x[:, self.columns] @ self.weights + self.bias)


def regress(table: DataFrame, fits: list[Fit], strength: float = 1.0) -> list[Line]:
    """Logistic regressions with penalty |w|^2 / (2 strength) on features scaled by each fit's own rows; Newton's method for all at once."""
    sizes, parts = [len(f.columns) for f in fits], table.rdd.getNumPartitions()

    def moments(rows: Rows) -> np.ndarray:
        out = []
        for f in fits:
            x = rows.x[f.trains(rows)][:, f.columns]
            out += [[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]
        return np.concatenate(out)

    sums, at, scale = _added(table, parts, moments, sum(1 + 2 * m for m in sizes)), 0, []
    for m in sizes:
        n, mean = max(sums[at], 1.0), sums[at + 1 : at + 1 + m] / max(sums[at], 1.0)
        var = np.maximum(sums[at + 1 + m : at + 1 + 2 * m] / n - mean**2, 0)
        scale.append((mean, np.where(var > 1e-14 * np.maximum(mean**2, 1e-300), np.sqrt(var), 1.0)))
        at += 1 + 2 * m

    w = [np.zeros(m + 1) for m in sizes]
    last: list[tuple[float, np.ndarray] | None] = [None] * len(fits)
    open_ = set(range(len(fits)))
    for _ in range(NEWTON_STEPS):
        asked = sorted(open_)

        def slopes(rows: Rows, asked: list[int] = asked, w: list[np.ndarray] = w) -> np.ndarray:
            out = []
            for j in asked:
                use = fits[j].trains(rows)
                mean, std = scale[j]
                x = np.column_stack([(rows.x[use][:, fits[j].columns] - mean) / std, np.ones(use.sum())])
                z, y = x @ w[j], rows.y[use]
                p = sigmoid(z)
                out += [[float((np.logaddexp(0, z) - y * z).sum())], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]
            return np.concatenate(out)

        sums, at = _added(table, parts, slopes, sum(1 + (m := sizes[j] + 1) + m * m for j in asked)), 0
        for j in asked:
            m = sizes[j] + 1
            penalty = np.append(np.full(m - 1, 1 / strength), 0.0)
            loss = sums[at] + 0.5 * float((penalty * w[j] ** 2).sum())
            slope = sums[at + 1 : at + 1 + m] + penalty * w[j]
            curve = sums[at + 1 + m : at + 1 + m + m * m].reshape(m, m) + np.diag(np.maximum(penalty, 1e-10))
            at += 1 + m + m * m
            if last[j] is not None and loss > last[j][0] + 1e-9 * abs(last[j][0]):
                w[j] = (w[j] + last[j][1]) / 2  # the step went too far
                continue
            step = np.linalg.solve(curve, slope)
            last[j] = (loss, w[j])
            w[j] = w[j] - step
            if np.abs(step).max() < SETTLED:
                open_.discard(j)
        if not open_:
            break
    return [Line(f.columns, v[:-1] / std, float(v[-1] - (v[:-1] * mean / std).sum())) for f, v, (mean, std) in zip(fits, w, scale, strict=True)]
