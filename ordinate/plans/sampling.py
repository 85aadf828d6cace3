"""Sampling of next tokens from tables of logits, and generation for many sequences at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators.sequence import linear_scan
from ..streaming.run import settled, shared_path

#: Cells of a model's matrix at most: it goes to all executors.
MODEL_CELLS = 1 << 22


@dataclass(frozen=True)
class Sampler:
    """temperature 0 is greedy, and takes the last of equal maxima; top_k 0 keeps all tokens."""

    temperature: float = 1.0
    top_k: int = 0
    top_p: float = 1.0
    repetition_penalty: float = 1.0

    def __post_init__(self) -> None:
        if self.temperature < 0 or self.top_k < 0 or not 0 < self.top_p <= 1 or self.repetition_penalty <= 0:
            raise ConfigError(str(self))

    def penalised(self, logits: DataFrame, history: DataFrame | None) -> DataFrame:
        """logits(seq, token, logit) with tokens of history(seq, token) made less likely, once for each occurrence."""
        if history is None or self.repetition_penalty == 1:
            return logits
        seen = history.groupBy("seq", "token").agg(F.count("*").alias("_n"))
        power = F.pow(F.lit(float(self.repetition_penalty)), F.coalesce("_n", F.lit(0)))
        value = F.when(F.col("logit") > 0, F.col("logit") / power).otherwise(F.col("logit") * power)
        return logits.join(seen, ["seq", "token"], "left").select("seq", "token", value.alias("logit"))

    def probabilities(self, logits: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(seq, token, p, rank) of the tokens that may be drawn: the top_k first, of those the shortest head of top_p."""
        given = self.penalised(logits, history)
        if self.temperature == 0:
            best = given.groupBy("seq").agg(F.max(F.struct("logit", "token")).alias("b"))
            return best.select("seq", F.col("b.token").alias("token"), F.lit(1.0).alias("p"), F.lit(1).alias("rank"))
        order = Window.partitionBy("seq").orderBy(F.desc("logit"), "token")
        own = Window.partitionBy("seq")
        ranked = given.withColumn("rank", F.row_number().over(order))
        if self.top_k:
            ranked = ranked.where(F.col("rank") <= self.top_k)
        e = F.exp((F.col("logit") - F.max("logit").over(own)) / self.temperature)
        ranked = ranked.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(own))
        if self.top_p < 1:
            before = F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")
            ranked = ranked.withColumn("_before", before).where(F.col("_before") < self.top_p)
            ranked = ranked.withColumn("p", F.col("p") / F.sum("p").over(own))
        return ranked.select("seq", "token", "p", "rank")

    def sample(self, logits: DataFrame, seed: int, step: int = 0, history: DataFrame | None = None) -> DataFrame:
        """(seq, token): one draw for each sequence, by a hash of seed, step and sequence."""
        p = self.probabilities(logits, history)
        order = Window.partitionBy("seq").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        u = _uniform(seed, step)
        reached = p.withColumn("_c", F.sum("p").over(order)).withColumn("_hit", F.col("_c") > u)
        # Where rounding leaves the last sum below u, the last token is drawn.
        key = F.struct((~F.col("_hit")).alias("no"), F.when(F.col("_hit"), F.col("rank")).otherwise(-F.col("rank")).alias("r"), "token")
        return reached.groupBy("seq").agg(F.min(key).alias("b")).select("seq", F.col("b.token").alias("token"))

    def drawn(self, logits: str, seed: int, step: int = 0, counts: str | None = None) -> Column:
        """The token of a row whose logits are an array by token: what sample() draws from the same logits, without a shuffle.

        counts: an array of how often each token was seen.
        """

        @F.arrow_udf("bigint")
        def draw(rows: pa.Array, u: pa.Array, seen: pa.Array) -> pa.Array:
            return pa.array([self._drawn(z.values.to_numpy(), v, None if counts is None else n.values.to_numpy()) for z, v, n in zip(rows, u.to_pylist(), seen)], pa.int64())

        return draw(F.col(logits).cast("array<double>"), _uniform(seed, step), F.col(counts or logits))

    def _drawn(self, z: np.ndarray, u: float, seen: np.ndarray | None) -> int:
        if seen is not None and self.repetition_penalty != 1:
            power = self.repetition_penalty ** seen.astype(float)
            z = np.where(z > 0, z / power, z * power)
        if self.temperature == 0:
            return int(len(z) - 1 - np.argmax(z[::-1]))
        order = np.argsort(-z, kind="stable")
        order = order[: self.top_k] if self.top_k else order
        e = np.exp((z[order] - z[order[0]]) / self.temperature)
        p = e / e.sum()
        if self.top_p < 1:
            kept = np.cumsum(p) - p < self.top_p
            order, p = order[kept], p[kept] / p[kept].sum()
        return int(order[min(int(np.searchsorted(np.cumsum(p), u, "right")), len(p) - 1)])


def _uniform(seed: int, step: int) -> Column:
    """A number of [0, 1) for each row's seq."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "seq"), F.lit(1 << 53)).cast("double") / float(1 << 53)


def generate(prompts: DataFrame, next_logits: Callable[[DataFrame], DataFrame], sampler: Sampler, settle: Callable[[DataFrame], DataFrame], most: int = 64, eos: int | None = None, seed: int = 0) -> DataFrame:
    """prompts(seq, pos, token) with generated tokens added at the next positions, for all sequences step by step.

    next_logits turns the tokens so far (unfinished sequences) into (seq, token, logit). A sequence stops after eos,
    which is part of it. settle cuts the lineage of each step. Every sequence needs a token to begin with.
    """
    tokens = settle(prompts)
    if tokens.limit(1).count() == 0:
        raise ConfigError("an empty prompt")
    live = settle(tokens.groupBy("seq").agg(F.max("pos").alias("last")))
    for step in range(most):
        current = tokens.join(live.select("seq"), "seq", "left_semi")
        drawn = sampler.sample(next_logits(current), seed, step, current.select("seq", "token"))
        added = settle(live.join(drawn, "seq").select("seq", (F.col("last") + 1).alias("pos"), "token"))
        tokens = settle(tokens.unionByName(added))
        live = added.select("seq", F.col("pos").alias("last")) if eos is None else added.where(F.col("token") != eos).select("seq", F.col("pos").alias("last"))
        if live.limit(1).count() == 0:
            break
    return tokens


def bigram_logits(counts: DataFrame, smoothing: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """Logits by the last token from counts(token, next, n): a language model that is one table."""
    vocabulary = counts.select("next").union(counts.select("token")).distinct().withColumnRenamed("next", "_v")

    def next_logits(tokens: DataFrame) -> DataFrame:
        last = tokens.groupBy("seq").agg(F.max_by("token", "pos").alias("token"))
        spread = last.crossJoin(F.broadcast(vocabulary))  # the logits of a step are sequences times vocabulary
        known = spread.join(counts, (spread["token"] == counts["token"]) & (F.col("_v") == counts["next"]), "left")
        return known.select(spread["seq"], F.col("_v").alias("token"), F.log(F.coalesce("n", F.lit(0.0)) + smoothing).alias("logit"))

    return next_logits


def generate_with_state(live: DataFrame, advance: Callable[[DataFrame], DataFrame], sampler: Sampler, most: int = 64, eos: int | None = None, seed: int = 0) -> DataFrame:
    """(seq, pos, token) of generated tokens, for sequences whose state is one row each.

    live(seq, last, logits, ...) has each sequence's last position and the logits of what follows, and its state in further columns. advance turns
    (seq, last, token, ...) with a token that was drawn, the old state with it, into a row of the same columns, token kept. A step is a pass over these rows:
    nothing is joined or shuffled, tokens are appended to a table of their own and never read again, and only the states are replaced. With a repetition
    penalty, live needs counts, an array of how often each token was seen. A sequence ends after eos, which is part of it.
    """
    spark, kind = live.sparkSession, live.schema["seq"].dataType.simpleString()
    penal = sampler.repetition_penalty != 1
    if penal and "counts" not in live.columns:
        raise ConfigError("a repetition penalty needs the counts of tokens")
    path = shared_path(spark, "tokens")
    for step in range(most):
        token = sampler.drawn("logits", seed, step, "counts" if penal else None)
        added = live.withColumns({"token": token, "last": F.col("last") + 1}).drop("logits")
        if penal:
            added = added.withColumn("counts", F.transform("counts", lambda n, i: n + (i == F.col("token")).cast("int")))
        now = settled(advance(added))
        now.select("seq", F.col("last").alias("pos"), "token").write.parquet(f"{path}/step={step}")
        live = (now if eos is None else now.where(F.col("token") != eos)).drop("token")
        if live.isEmpty():
            break
    columns = f"seq {kind}, pos bigint, token bigint"
    return spark.read.schema(f"{columns}, step int").parquet(path).drop("step") if most else spark.createDataFrame([], columns)


@dataclass(frozen=True)
class ScanModel:
    """A language model whose state is a decaying sum of its tokens' vectors; logits are products of a matrix with it."""

    vectors: np.ndarray
    readout: np.ndarray
    decay: float

    def __post_init__(self) -> None:
        if self.vectors.ndim != 2 or self.vectors.shape != self.readout.shape or not 0 < self.decay < 1:
            raise ConfigError("a model needs two matrices of one shape, tokens by width, and a decay between 0 and 1")
        if self.vectors.size > MODEL_CELLS:
            raise ConfigError(f"a matrix of {self.vectors.size} cells is too large to send to all executors")

    def _of(self, token: str) -> Column:
        @F.arrow_udf("array<double>")
        def vector(tokens: pa.Array) -> pa.Array:
            return pa.array(list(self.vectors[tokens.to_numpy(zero_copy_only=False)]), pa.list_(pa.float64()))

        return vector(F.col(token).cast("bigint"))

    def _logits(self, h: str) -> Column:
        @F.arrow_udf("array<double>")
        def logits(states: pa.Array) -> pa.Array:
            h = states.flatten().to_numpy(zero_copy_only=False).reshape(len(states), -1)
            return pa.array(list(h @ self.readout.T), pa.list_(pa.float64()))

        return logits(F.col(h))

    def prefill(self, prompts: DataFrame, penal: bool = False) -> DataFrame:
        """The rows that generate_with_state() begins with, by a scan of prompts(seq, pos, token), pos from 0 without gaps."""
        given = prompts.withColumns({"_d": F.lit(float(np.log(self.decay))), "_u": self._of("token")})
        scanned = linear_scan(settled(given), ["seq"], "pos", "_d", "_u", "h")
        last = F.max_by(F.struct(F.col("pos").alias("last"), "h"), "pos").alias("_s")
        seen = F.collect_list("token").alias("_seen")  # a prompt's own tokens
        live = scanned.groupBy("seq").agg(last, *([seen] if penal else [])).select("seq", F.col("_s.last").cast("bigint").alias("last"), "_s.h", *(["_seen"] if penal else []))
        if penal:
            tokens = F.sequence(F.lit(0), F.lit(len(self.vectors) - 1))
            live = live.withColumn("counts", F.transform(tokens, lambda k: F.size(F.filter("_seen", lambda t: t == k)))).drop("_seen")
        return settled(live.withColumn("logits", self._logits("h")))

    def advance(self, drawn: DataFrame) -> DataFrame:
        moved = drawn.withColumn("_u", self._of("token"))
        moved = moved.withColumn("h", F.zip_with("h", "_u", lambda h, u: h * self.decay + u)).drop("_u")
        return moved.withColumn("logits", self._logits("h"))
