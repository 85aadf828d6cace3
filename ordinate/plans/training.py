"""Losses, optimizers, schedules and the trainer: parameters are a table (param, idx, v, trainable), updates are joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import arrays, scalar


def mean_cross_entropy(df: DataFrame, logits: str, target: str, smoothing: float = 0.0, ignore: int | None = None) -> DataFrame:
    """One row with loss, perplexity, accuracy and the rows counted; it fails if no row is left."""
    kept = df if ignore is None else df.where(F.col(target) != ignore)
    loss = F.avg(arrays.cross_entropy(F.col(logits), F.col(target), smoothing))
    hit = F.when(arrays.argmax(F.col(logits)) == F.col(target), 1.0).otherwise(0.0)
    out = kept.agg(loss.alias("loss"), F.avg(hit).alias("accuracy"), F.count("*").alias("n"))
    none = F.raise_error(F.lit("no row has a target")).cast("double")
    return out.select(F.when(F.col("n") == 0, none).otherwise(F.col("loss")).alias("loss"), F.exp("loss").alias("perplexity"), "accuracy", "n")


def mse(a: Column, b: Column) -> Column:
    return F.avg((a - b) * (a - b))


def mae(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


@dataclass(frozen=True)
class Schedule:
    """Learning rate by step, from 1. kind: constant, cosine, linear, step or inverse_sqrt; ratio: what is left at the end."""

    kind: str = "constant"
    warmup: int = 0
    total: int = 0
    ratio: float = 0.1
    every: int = 1
    gamma: float = 0.5

    @staticmethod
    def cosine(total: int) -> Schedule:
        return Schedule("cosine", max(total // 50, 1), total, 0.1)

    def at(self, base: float, step: Column) -> Column:
        step = step.cast("double")
        warm = base * step / max(1, self.warmup)
        span = max(1, self.total - self.warmup)
        done = F.least(F.greatest((step - self.warmup) / span, F.lit(0.0)), F.lit(1.0))
        if self.kind == "constant":
            return F.lit(float(base))
        if self.kind == "cosine":
            late = base * (self.ratio + (1 - self.ratio) * 0.5 * (1 + F.cos(done * math.pi)))
        elif self.kind == "linear":
            late = base * (1 - (1 - self.ratio) * done)
        elif self.kind == "step":
            return base * F.pow(F.lit(float(self.gamma)), F.floor(step / self.every)) if self.every else F.lit(float(base))
        elif self.kind == "inverse_sqrt":
            late = base * F.sqrt(max(1, self.warmup) / F.greatest(step, F.lit(1.0)))
        else:
            raise ConfigError(f"no schedule {self.kind}")
        return F.when(step < self.warmup, warm).otherwise(late)


def gradient_norm(grads: DataFrame) -> DataFrame:
    """One row with the norm of all of grads(param, idx, g); 0 without any."""
    return grads.agg(F.sqrt(F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0.0))).alias("norm"))


def clip_factor(norm: Column, most: float, scale: float = 1.0) -> Column:
    """What gradients are multiplied with: scale, less where scale * norm is over most; odd norms leave scale."""
    c = scalar.fdiv(scalar.number(most), norm * scale + 1e-6)
    odd = F.isnan(norm) | (F.abs(norm) == float("inf"))
    return F.when(~odd & (c > 0) & (c < 1), c * scale).otherwise(F.lit(float(scale)))


def clip_value(norm: float, most: float, scale: float = 1.0) -> float:
    """clip_factor() of a norm that is known; most of 0 or less clips nothing."""
    c = most / (norm * scale + 1e-6) if most > 0 and math.isfinite(norm) else 1.0
    return c * scale if 0 < c < 1 else scale


@dataclass(frozen=True)
class AdamW:
    """decay_rank: parameters of at least so many axes (column rank) decay."""

    learning_rate: float = 1e-3
    beta1: float = 0.9
    beta2: float = 0.95
    eps: float = 1e-8
    decay: float = 0.1
    decay_rank: int = 2

    def step(self, params: DataFrame, grads: DataFrame, number: int, rate: float | Column | None = None, factor: Column | float = 1.0) -> DataFrame:
        """params(param, idx, v, m, s, rank, trainable) after one step, the number-th from 1; what has no gradient stays."""
        lr = F.lit(self.learning_rate) if rate is None else rate if isinstance(rate, Column) else F.lit(rate)
        both = params.join(grads.select("param", "idx", "g"), ["param", "idx"], "left")
        moved = F.col("g").isNotNull() & F.col("trainable")
        g = F.col("g") * factor
        m = self.beta1 * F.col("m") + (1 - self.beta1) * g
        s = self.beta2 * F.col("s") + (1 - self.beta2) * g * g
        hat_m, hat_s = m / (1 - self.beta1**number), s / (1 - self.beta2**number)
        decay = F.when(F.col("rank") >= self.decay_rank, self.decay * F.col("v")).otherwise(0.0)
        v = F.col("v") - lr * (hat_m / (F.sqrt(hat_s) + self.eps) + decay)
        new = {"v": v, "m": m, "s": s}
        return both.select("param", "idx", *[F.when(moved, new[c]).otherwise(F.col(c)).alias(c) for c in ("v", "m", "s")], "rank", "trainable")


@dataclass(frozen=True)
class Sgd:
    learning_rate: float = 1e-2
    momentum: float = 0.0
    nesterov: bool = False
    decay: float = 0.0

    def step(self, params: DataFrame, grads: DataFrame, number: int, rate: float | Column | None = None, factor: Column | float = 1.0) -> DataFrame:
        """As AdamW.step; m is the velocity, that of the first step the gradient itself."""
        lr = F.lit(self.learning_rate) if rate is None else rate if isinstance(rate, Column) else F.lit(rate)
        both = params.join(grads.select("param", "idx", "g"), ["param", "idx"], "left")
        moved = F.col("g").isNotNull() & F.col("trainable")
        d = F.col("g") * factor + self.decay * F.col("v")
        m = d if number == 1 else self.momentum * F.col("m") + d
        by = (d + self.momentum * m if self.nesterov else m) if self.momentum else d
        new = {"v": F.col("v") - lr * by, "m": m if self.momentum else F.col("m")}
        return both.select("param", "idx", *[F.when(moved, new[c]).otherwise(F.col(c)).alias(c) for c in ("v", "m")], "s", "rank", "trainable")


def parameters(values: DataFrame, rank: int = 2, trainable: bool = True) -> DataFrame:
    """Parameter rows of values(param, idx, v) with zero moments."""
    return values.select("param", "idx", "v", F.lit(0.0).alias("m"), F.lit(0.0).alias("s"), F.lit(rank).alias("rank"), F.lit(trainable).alias("trainable"))


def frozen(params: DataFrame, patterns: list[str], trainable: bool = False) -> DataFrame:
    """params with those whose names hold one of the patterns frozen (or freed); no pattern means all."""
    hit = F.lit(not patterns)
    for p in patterns:
        hit = hit | F.col("param").contains(p)
    return params.withColumn("trainable", F.when(hit, F.lit(trainable)).otherwise(F.col("trainable")))


#: The name under which a loss travels with the gradients.
LOSS = "__loss__"


@dataclass(frozen=True)
class StepInfo:
    """One step: the mean loss of its batches before it, the norm of their mean gradient, what that was multiplied with, and the rate."""

    number: int
    loss: float
    norm: float
    factor: float
    rate: float


@dataclass
class TrainReport:
    """All steps of a run."""

    steps: list[StepInfo] = field(default_factory=list)

    @property
    def losses(self) -> list[float]:
        return [s.loss for s in self.steps]

    @property
    def final_loss(self) -> float | None:
        return self.steps[-1].loss if self.steps else None

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s.number, s.loss, s.norm, s.factor, s.rate) for s in self.steps]
        return spark.createDataFrame(rows, "step int, loss double, norm double, factor double, rate double")


@dataclass
class Trainer:
    """Runs steps: gradients of micro-batches are summed by a grouped sum, averaged, clipped and applied.

    gradients(params, batch) returns (param, idx, g) rows and loss(params, batch) a one-row table; both are plans, and
    only losses and norms come to the driver, as observed metrics of the job that writes the summed gradients. settle(params) cuts the lineage,
    such as by a written table. on_step is called with the StepInfo of every log_every-th step; report has all of them.
    """

    optimizer: AdamW | Sgd
    gradients: Callable[[DataFrame, DataFrame], DataFrame]
    loss: Callable[[DataFrame, DataFrame], DataFrame]
    settle: Callable[[DataFrame], DataFrame]
    schedule: Schedule = field(default_factory=Schedule)
    learning_rate: float = 1e-3
    max_norm: float = 1.0
    accumulation: int = 1
    max_steps: int = 1 << 30
    number: int = 0
    on_step: Callable[[StepInfo], None] | None = None
    log_every: int = 1
    report: TrainReport = field(default_factory=TrainReport)

    def __post_init__(self) -> None:
        if self.learning_rate <= 0 or self.accumulation < 1 or self.log_every < 1:
            raise ConfigError(f"learning rate {self.learning_rate}, accumulation {self.accumulation}, a report every {self.log_every}")

    @property
    def losses(self) -> list[float]:
        return self.report.losses

    def step(self, params: DataFrame, batches: list[DataFrame]) -> DataFrame:
        if not batches:
            raise ConfigError("a step without batches")
        self.number += 1
        total = None
        for b in batches:
            lost = self.loss(params, b)
            lost = lost.select(F.lit(LOSS).alias("param"), F.lit(0).alias("idx"), F.col(lost.columns[0]).cast("double").alias("g"))
            part = self.gradients(params, b).select("param", "idx", "g").unionByName(lost)
            total = part if total is None else total.unionByName(part)
        own, seen = F.col("param") != LOSS, Observation()
        squares, loss = F.sum(F.when(own, F.col("g") * F.col("g"))).alias("squares"), F.sum(F.when(~own, F.col("g"))).alias("loss")
        total = self.settle(total.groupBy("param", "idx").agg(F.sum("g").alias("g")).observe(seen, squares, loss)).where(own)
        scale, norm = 1 / len(batches), math.sqrt(seen.get["squares"] or 0.0)
        lost = seen.get["loss"]
        factor = clip_value(norm, self.max_norm, scale)
        rate, rated = self.schedule.at(self.learning_rate, F.lit(self.number)).cast("double"), Observation()
        params = self.settle(self.optimizer.step(params, total, self.number, rate, factor).observe(rated, F.max(rate).alias("rate")))
        info = StepInfo(self.number, math.nan if lost is None else lost * scale, norm * scale, factor, rated.get["rate"] or 0.0)
        self.report.steps.append(info)
        if self.on_step and self.number % self.log_every == 0:
            self.on_step(info)
        return params

    def fit(self, params: DataFrame, batches: Iterable[DataFrame]) -> DataFrame:
        """Groups of accumulation batches, the last of which may be smaller, until max_steps."""
        group = []
        for b in batches:
            group.append(b)
            if len(group) == self.accumulation:
                params, group = self.step(params, group), []
                if self.number >= self.max_steps:
                    return params
        return self.step(params, group) if group and self.number < self.max_steps else params

    def evaluate(self, params: DataFrame, batches: Iterable[DataFrame]) -> float:
        """The mean of the batches' losses; 0 without any."""
        losses = [self.loss(params, b).first()[0] for b in batches]
        return sum(losses) / len(losses) if losses else 0.0
