"""Reverse-mode gradients of tensor relations.

A Var wraps a TensorFrame and remembers how it came about; backward() walks the graph from a scalar and builds, for each
leaf, the DataFrame plan of its gradient. Nothing runs until a gradient is read, but within written(). Ids grow, so descending ids are a
reverse topological order.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shape as S
from ..errors import AutodiffError
from ..frame import TensorFrame
from ..functions import scalar
from ..operators import contraction, elemwise, indexing, movement, reduce, scan

_ids = count()
_enabled: ContextVar[bool] = ContextVar("enabled", default=True)
_settling: ContextVar[tuple] = ContextVar("settling", default=(None, 0))


@contextmanager
def no_grad():
    """Within it, nothing is recorded."""
    token = _enabled.set(False)
    try:
        yield
    finally:
        _enabled.reset(token)


@contextmanager
def written(settle: Callable[[DataFrame], DataFrame], most: int = 4):
    """Within it, a tensor or a gradient whose plan reads more than most tables is written by settle, once, and its users share the table.

    Without it, plans are only built, and each use of a tensor is another copy of its plan.
    """
    token = _settling.set((settle, most))
    try:
        yield
    finally:
        _settling.reset(token)


def _shared(t: TensorFrame) -> TensorFrame:
    settle, most = _settling.get()
    if settle is None or t.df._jdf.queryExecution().analyzed().collectLeaves().length() <= most:
        return t
    return TensorFrame(settle(t.df), t.shape)


class Var:
    """A tensor with its place in the graph. name: of a leaf that gradients are wanted for."""

    def __init__(self, tensor: TensorFrame, name: str | None = None, parents: tuple = (), pull: Callable | None = None) -> None:
        self.tensor, self.name, self.id = _shared(tensor), name, next(_ids)
        self.parents = parents if _enabled.get() else ()
        self.pull = pull
        self.tracked = name is not None or any(p.tracked for p in self.parents)

    @property
    def shape(self) -> S.Shape:
        return self.tensor.shape

    def detach(self) -> Var:
        return Var(self.tensor)

    def __add__(self, other):
        return add(self, _var(self, other))

    def __sub__(self, other):
        return sub(self, _var(self, other))

    def __mul__(self, other):
        return mul(self, _var(self, other))

    def __truediv__(self, other):
        return div(self, _var(self, other))

    def __matmul__(self, other):
        return matmul(self, other)

    def __neg__(self):
        return affine(self, -1.0, 0.0)


def _var(like: Var, x) -> Var:
    return x if isinstance(x, Var) else Var(TensorFrame(like.tensor.df.sparkSession.range(1).select(F.lit(float(x)).alias("v")), ()))


def backward(loss: Var, retain: dict[str, Var] | None = None) -> dict[str, TensorFrame]:
    """The gradients of a one-element Var by the names of its leaves; a leaf that is used more than once has the sum.

    retain: further Vars within the graph whose gradients are wanted, by names for them. The graph is kept: backward can be called again.
    """
    if not loss.tracked:
        raise AutodiffError("the loss depends on no named leaf")
    if loss.tensor.size != 1:
        raise AutodiffError(f"a loss of shape {loss.shape}")
    nodes, stack = {}, [loss]
    while stack:
        v = stack.pop()
        if v.id not in nodes and v.tracked:
            nodes[v.id] = v
            stack.extend(v.parents)
    flows: dict[int, list[TensorFrame]] = {loss.id: [loss.tensor.map(lambda _: F.lit(1.0))]}
    out: dict[str, list[TensorFrame]] = {}
    for k in sorted(nodes, reverse=True):
        v, parts = nodes[k], flows.pop(k, [])
        if not parts:
            continue
        g = _shared(parts[0] if len(parts) == 1 else elemwise.add_all(parts))
        for name in [v.name] if v.name is not None else []:
            out.setdefault(name, []).append(g)
        for name, wanted in (retain or {}).items():
            if wanted.id == v.id:
                out.setdefault(name, []).append(g)
        if v.pull is not None and v.parents:
            for parent, part in zip(v.parents, v.pull(g)):
                if parent.tracked and part is not None:
                    flows.setdefault(parent.id, []).append(part)
    return {n: p[0] if len(p) == 1 else elemwise.add_all(p) for n, p in out.items()}


def _pointwise(x: Var, f: Callable, slope: Callable) -> Var:
    """slope: the derivative as a column of the input and output values."""

    def pull(g: TensorFrame) -> list[TensorFrame]:
        return [elemwise.binary(g, x.tensor, lambda d, v: d * slope(v, f(v)))]

    return Var(x.tensor.map(f), parents=(x,), pull=pull)


def affine(x: Var, scale: float, shift: float) -> Var:
    return Var(x.tensor.map(lambda v: v * scale + shift), parents=(x,), pull=lambda g: [g.map(lambda v: v * scale)])


def exp(x: Var) -> Var:
    return _pointwise(x, F.exp, lambda v, y: y)


def log(x: Var) -> Var:
    return _pointwise(x, scalar.flog, lambda v, y: scalar.recip(v))


def sqrt(x: Var) -> Var:
    return _pointwise(x, F.sqrt, lambda v, y: scalar.fdiv(scalar.number(0.5), y))


def rsqrt(x: Var) -> Var:
    return _pointwise(x, scalar.rsqrt, lambda v, y: -0.5 * y * y * y)


def recip(x: Var) -> Var:
    return _pointwise(x, scalar.recip, lambda v, y: -y * y)


def absolute(x: Var) -> Var:
    return _pointwise(x, F.abs, lambda v, y: scalar.sign(v))


def tanh(x: Var) -> Var:
    return _pointwise(x, F.tanh, lambda v, y: 1 - y * y)


def sigmoid(x: Var) -> Var:
    return _pointwise(x, scalar.sigmoid, lambda v, y: y * (1 - y))


def sin(x: Var) -> Var:
    return _pointwise(x, F.sin, lambda v, y: F.cos(v))


def cos(x: Var) -> Var:
    return _pointwise(x, F.cos, lambda v, y: -F.sin(v))


def erf(x: Var) -> Var:
    return _pointwise(x, scalar.erf, lambda v, y: F.exp(-v * v) * 1.1283791670955126)


def relu(x: Var) -> Var:
    return _pointwise(x, scalar.relu, lambda v, y: scalar.gt(v, scalar.number(0)))


def silu(x: Var) -> Var:
    return _pointwise(x, scalar.silu, lambda v, y: scalar.sigmoid(v) * (1 + v * (1 - scalar.sigmoid(v))))


def softplus(x: Var) -> Var:
    return _pointwise(x, scalar.softplus, lambda v, y: scalar.sigmoid(v))


def powf(x: Var, a: float) -> Var:
    return _pointwise(x, lambda v: F.pow(v, F.lit(float(a))), lambda v, y: a * F.pow(v, F.lit(float(a - 1))))


def round_straight_through(x: Var) -> Var:
    return _pointwise(x, scalar.round_half_away, lambda v, y: scalar.number(1))


def wrap_to(x: Var, period: float) -> Var:
    return _pointwise(x, lambda v: scalar.wrap_to(v, period), lambda v, y: scalar.number(1))


def clamp(x: Var, low: float, high: float) -> Var:
    """The gradient is 1 strictly between the bounds and 0 at and outside them."""
    return _pointwise(x, lambda v: scalar.clamp(v, low, high), lambda v, y: F.when((v > low) & (v < high), 1.0).otherwise(0.0))


def _two(a: Var, b: Var, f: Callable, da: Callable, db: Callable) -> Var:
    def pull(g: TensorFrame) -> list[TensorFrame]:
        ga = elemwise.mul(g, elemwise.binary(a.tensor, b.tensor, da)) if da else g
        gb = elemwise.mul(g, elemwise.binary(a.tensor, b.tensor, db)) if db else g
        return [reduce.reduce_to(ga, a.shape), reduce.reduce_to(gb, b.shape)]

    return Var(elemwise.binary(a.tensor, b.tensor, f), parents=(a, b), pull=pull)


def add(a: Var, b: Var) -> Var:
    return _two(a, b, lambda x, y: x + y, None, None)


def sub(a: Var, b: Var) -> Var:
    return _two(a, b, lambda x, y: x - y, None, lambda x, y: scalar.number(-1))


def mul(a: Var, b: Var) -> Var:
    return _two(a, b, lambda x, y: x * y, lambda x, y: y, lambda x, y: x)


def div(a: Var, b: Var) -> Var:
    return _two(a, b, scalar.fdiv, lambda x, y: scalar.recip(y), lambda x, y: -scalar.fdiv(x, y * y))


def maximum(a: Var, b: Var) -> Var:
    """Where both are equal, b has the whole gradient."""
    return _two(a, b, F.greatest, lambda x, y: scalar.gt(x, y), lambda x, y: 1 - scalar.gt(x, y))


def matmul(a: Var, b: Var) -> Var:
    def pull(g: TensorFrame) -> list[TensorFrame]:
        return [
            reduce.reduce_to(contraction.matmul_nt(g, b.tensor), a.shape),
            reduce.reduce_to(contraction.matmul_tn(a.tensor, g), b.shape),
        ]

    return Var(contraction.matmul(a.tensor, b.tensor), parents=(a, b), pull=pull)


def sum_dim(x: Var, axis: int, scale: float = 1.0) -> Var:
    return Var(reduce.sum_dim(x.tensor, axis, scale), parents=(x,), pull=lambda g: [elemwise.expand(g, x.shape).map(lambda v: v * scale)])


def mean_dim(x: Var, axis: int) -> Var:
    return sum_dim(x, axis, 1 / max(1, x.shape[axis]))


def max_dim(x: Var, axis: int) -> Var:
    """Equal maxima share the gradient."""
    top = reduce.max_dim(x.tensor, axis)

    def pull(g: TensorFrame) -> list[TensorFrame]:
        won = elemwise.binary(x.tensor, top, scalar.eq)
        return [elemwise.mul(won, elemwise.div(g, reduce.sum_dim(won, axis)))]

    return Var(top, parents=(x,), pull=pull)


def sum_all(x: Var) -> Var:
    return Var(reduce.sum_all(x.tensor), parents=(x,), pull=lambda g: [elemwise.expand(g, x.shape)])


def mean_all(x: Var) -> Var:
    return affine(sum_all(x), 1 / x.tensor.size, 0.0)


def reshape(x: Var, shape: S.Shape) -> Var:
    return Var(movement.reshape(x.tensor, shape), parents=(x,), pull=lambda g: [movement.reshape(g, x.shape)])


def permute(x: Var, order: list[int]) -> Var:
    back = [order.index(k) for k in range(len(order))]
    return Var(movement.permute(x.tensor, order), parents=(x,), pull=lambda g: [movement.permute(g, back)])


def flip(x: Var, axis: int) -> Var:
    return Var(movement.flip(x.tensor, axis), parents=(x,), pull=lambda g: [movement.flip(g, axis)])


def narrow(x: Var, axis: int, start: int, length: int) -> Var:
    after = x.shape[axis] - start - length
    return Var(movement.narrow(x.tensor, axis, start, length), parents=(x,), pull=lambda g: [movement.pad(g, axis, start, after)])


def cat(parts: list[Var], axis: int) -> Var:
    sizes = [p.shape[axis] for p in parts]
    return Var(movement.cat([p.tensor for p in parts], axis), parents=tuple(parts), pull=lambda g: movement.split(g, sizes, axis))


def expand(x: Var, shape: S.Shape) -> Var:
    return Var(elemwise.expand(x.tensor, shape), parents=(x,), pull=lambda g: [reduce.reduce_to(g, x.shape)])


def cumsum(x: Var, axis: int) -> Var:
    return Var(scan.cumsum(x.tensor, axis), parents=(x,), pull=lambda g: [scan.cumsum_reverse(g, axis)])


def cumsum_exclusive(x: Var, axis: int) -> Var:
    return Var(scan.cumsum_exclusive(x.tensor, axis), parents=(x,), pull=lambda g: [scan.cumsum_reverse_exclusive(g, axis)])


def shift_by(x: Var, axis: int, n: int) -> Var:
    return Var(scan.shift_by(x.tensor, axis, n), parents=(x,), pull=lambda g: [scan.shift_by(g, axis, -n)])


def log_softmax(x: Var, axis: int) -> Var:
    shifted = sub(x, Var(reduce.max_dim(x.tensor, axis)))
    return sub(shifted, log(sum_dim(exp(shifted), axis)))


def softmax(x: Var, axis: int) -> Var:
    return exp(log_softmax(x, axis))


def cross_entropy(logits: Var, targets: TensorFrame, smoothing: float = 0.0, ignored: int | None = None) -> Var:
    """Mean negative log-likelihood for logits [rows, classes].

    targets: one-hot of that shape, or the classes [rows]. smoothing shares so much of the target out to all classes. Rows of the
    class ignored count neither in the sum nor in the mean (a mean of no rows is 0).
    """
    rows, classes = logits.shape
    hot = targets if targets.rank == 2 else indexing.one_hot(targets, classes)
    if smoothing:
        hot = hot.map(lambda v: v * (1 - smoothing) + smoothing / classes)
    count = Var(TensorFrame(hot.df.sparkSession.range(1).select(F.lit(float(rows)).alias("v")), ()))
    if ignored is not None:
        if targets.rank != 1:
            raise AutodiffError("an ignored class needs targets [rows]")
        kept = targets.map(lambda v: F.when(v == ignored, 0.0).otherwise(1.0))
        hot = elemwise.mul(hot, movement.unsqueeze(kept, 1))
        count = Var(reduce.sum_all(kept).map(lambda v: F.greatest(v, scalar.number(1))))
    return affine(div(sum_all(mul(log_softmax(logits, 1), Var(hot))), count), -1.0, 0.0)


def gather_rows(x: Var, ids: TensorFrame) -> Var:
    """Rows of a table [n, columns] by ids [m]; the gradient adds up at rows that are named more than once."""
    rows, columns = x.shape
    named = ids.df.select(F.col("i0").alias("_r"), F.col("v").cast("bigint").alias("id"))
    found = indexing.gather_rows(x.tensor, named).select(F.col("_r").alias("i0"), "i1", "v")

    def pull(g: TensorFrame) -> list[TensorFrame]:
        return [indexing.scatter_add_rows(g.df.join(elemwise.sided(named, ids.size), F.col("i0") == F.col("_r")).select("id", "i1", "v"), rows, columns)]

    return Var(TensorFrame(found, (ids.shape[0], columns)), parents=(x,), pull=pull)


def take_along_last(x: Var, ids: TensorFrame) -> Var:
    def pull(g: TensorFrame) -> list[TensorFrame]:
        return [elemwise.mul(indexing.one_hot(ids, x.shape[-1]), movement.unsqueeze(g, g.rank))]

    return Var(indexing.take_along_last(x.tensor, ids), parents=(x,), pull=pull)


def reverse_bands(x: Var, axis: int, bands: list[tuple[int, int]]) -> Var:
    return Var(movement.reverse_bands(x.tensor, axis, bands), parents=(x,), pull=lambda g: [movement.reverse_bands(g, axis, bands)])


def split(x: Var, sizes: list[int], axis: int) -> list[Var]:
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    return [narrow(x, axis, s, n) for s, n in zip(starts, sizes)]


def rotate_halves(x: Var, cos: Var, sin: Var) -> Var:
    """Planes of the halves of the last axis, turned; cos and sin broadcast to a half."""
    axis, half = len(x.shape) - 1, x.shape[-1] // 2
    first, second = split(x, [half, half], axis)
    return cat([sub(mul(first, cos), mul(second, sin)), add(mul(first, sin), mul(second, cos))], axis)


def causal_conv(x: Var, weights: Var, axis: int) -> Var:
    """weights [k], of which the last is that of the cell itself, over cells before along an axis; missing ones are zeros."""
    size, out = weights.shape[0], None
    for j in range(size):
        term = mul(shift_by(x, axis, size - 1 - j) if j < size - 1 else x, narrow(weights, 0, j, 1))
        out = term if out is None else add(out, term)
    return out


def exp_decay(a: Var, floor_at: float = -60.0) -> Var:
    return exp(clamp(a, floor_at, 0.0))


def trapezoid_weights(dt: Var, lam: Var, axis: int) -> tuple[Var, Var]:
    """(g, w): g = lambda dt, and w = g + (1 - lambda) dt of the cell after along an axis."""
    g = mul(lam, dt)
    return g, add(g, shift_by(sub(dt, g), axis, -1))


def band(log_decay: Var, w: Var, g: Var) -> Var:
    """[T, T] of a chunk's weights: g on the diagonal, w below it, times the decay from column to row; zeros above."""
    n, spark = log_decay.shape[0], log_decay.tensor.df.sparkSession
    total = cumsum(log_decay, 0)
    decay = exp_decay(sub(reshape(total, (n, 1)), reshape(total, (1, n))))
    cells = lambda f: Var(TensorFrame.generated(spark, (n, n), f))
    below, on = cells(lambda i, j: F.when(j < i, 1.0).otherwise(0.0)), cells(lambda i, j: F.when(j == i, 1.0).otherwise(0.0))
    return mul(add(mul(reshape(w, (1, n)), below), mul(reshape(g, (1, n)), on)), decay)


def linear_scan(log_decay: Var, inputs: Var) -> Var:
    """The states h[t] = exp(log_decay[t]) h[t-1] + inputs[t] of one chunk, [T], as a product of a lower triangle with the inputs."""
    n = log_decay.shape[0]
    ones = Var(log_decay.tensor.map(lambda _: scalar.number(1)))
    return reshape(matmul(band(log_decay, ones, ones), reshape(inputs, (n, 1))), (n,))


def mse(a: Var, b: Var) -> Var:
    d = sub(a, b)
    return mean_all(mul(d, d))
