"""Blocks of networks as plans over tensor relations and their gradients."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import ShapeError
from ..frame import TensorFrame
from ..functions import scalar
from ..functions.permutation import Permutation
from ..operators import contraction, elemwise
from . import adapters


def gated(x: TensorFrame, up: TensorFrame, gate: TensorFrame, down: TensorFrame, activation: str = "silu") -> TensorFrame:
    """A gated feed-forward block: (f(x gate) * (x up)) down."""
    opened = contraction.matmul(x, gate).map(scalar.ACTIVATIONS[activation])
    return contraction.matmul(elemwise.mul(opened, contraction.matmul(x, up)), down)


def positional(x: TensorFrame, table: TensorFrame, start: int = 0) -> TensorFrame:
    """x [..., T, D] plus the rows start, start + 1, ... of a table [most, D] of positions."""
    steps = x.shape[-2]
    if table.shape[-1] != x.shape[-1] or start + steps > table.shape[0]:
        raise ShapeError(f"positions {start} to {start + steps} of a table {table.shape} for {x.shape}")
    rows = table.df.where((F.col("i0") >= start) & (F.col("i0") < start + steps)).withColumn("i0", F.col("i0") - start)
    return elemwise.add(x, TensorFrame(rows, (steps, table.shape[1])))


def quantized_linear(x: TensorFrame, weight: TensorFrame, bits: int = 8, bias: TensorFrame | None = None, lora=None, observed=None) -> TensorFrame:
    """x W with both at their levels (the weight by output column); an adapter sees x as it is."""
    y = contraction.matmul(adapters.quantize(x, bits, observed=observed), adapters.quantize(weight, bits, axis=1))
    if lora is not None:
        y = elemwise.add(y, adapters.lora_delta(x, *lora))
    return elemwise.add(y, bias) if bias is not None else y


def merged_adapters(parameters: dict[str, TensorFrame], alpha: float) -> dict[str, TensorFrame]:
    """All parameters with every adapter (name.lora_a, name.lora_b) merged into the weight name, and its B zeros."""
    out = dict(parameters)
    for key in parameters:
        if key.endswith(".lora_a"):
            name = key.removesuffix(".lora_a")
            out[name], out[f"{name}.lora_b"] = adapters.merged(parameters[name], parameters[key], parameters[f"{name}.lora_b"], alpha)
    return out


def shuffled(ids: TensorFrame, seed: int) -> TensorFrame:
    """The values [n] in an order that a keyed permutation gives, for any partitioning; nothing is sorted."""
    return TensorFrame(ids.df.select(Permutation(ids.shape[0], seed).forward(F.col("i0")).alias("i0"), "v"), ids.shape)
