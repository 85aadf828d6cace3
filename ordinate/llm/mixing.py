"""Mixing sources to target weights: raking, then sampling by calibrated probabilities. DataFrame functions only.

Documents are summed to cells of source, language and topic. Iterative proportional fitting scales the cells'
token weights to the target marginals of one attribute after another. Each cell's probability is its fitted
weight over its tokens, times a constant that makes the expected tokens of the sample the wanted share; a cell
that would exceed 1 is taken whole, and the constant raised for the others.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, small, written

#: Attributes and how much of the difference between their categories' shares the targets keep: share ** power.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Fitting ends when no marginal is off its target by more; rounds, each over all attributes, after which a warning says that it has not.
TOLERANCE, SWEEPS = 1e-9, 200
#: Share of the tokens that the sample has, in expectation.
SHARE = 0.6
SEED = 11
#: Name of a null category.
NONE = "(none)"
#: Topics by what a text has: the first that applies counts.
TOPICS = (
    ("license", ("Licensed under", "All rights reserved", "Copyright")),
    ("table", (" | ",)),
    ("symbols", ("***", "$$$", "%%%", "&&&", "###")),
    ("shouting", ("!! ",)),
)
OTHER = "prose"
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER)
    for name, marks in reversed(TOPICS):
        found = F.lit(False)
        for m in marks:
            found = found | text.contains(m)
        out = F.when(found, name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Words of a text, split at ASCII white space; none of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cells_of(docs: DataFrame, attributes: dict[str, Column], tokens: Column) -> DataFrame:
    """(attributes, tokens): tokens of each combination; those without tokens are left out."""
    by = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in attributes.items()]
    return docs.select(*by, tokens.alias("tokens")).groupBy(*attributes).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def fitted(cells: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells with weight: token shares raked to the targets, a written table.

    targets: for an attribute, a table (its name, target) with a row for each category; without it, the target of a
    category is its token share to the attribute's power, scaled to sum 1. Categories without a target get 0. A round scales to
    each attribute in turn, by grouped sums; rounds go on until no marginal is off its target by more than TOLERANCE (where targets
    contradict each other or have categories without cells, until none changes by more). A warning says that SWEEPS rounds have not done it.
    """
    total = float(max(1, cells.agg(F.sum("tokens")).first()[0] or 0))
    wanted = {}
    for k, power in powers.items():
        if targets and k in targets:
            wanted[k] = targets[k].select(F.col(k), F.col("target").cast("double").alias("target"))
        else:
            raised = cells.groupBy(k).agg(F.pow(F.sum("tokens") / F.lit(total), F.lit(power)).alias("target"))
            sums = raised.agg(F.sum("target")).first()[0] or 1.0
            wanted[k] = raised.withColumn("target", F.col("target") / F.lit(sums))
        wanted[k] = written(wanted[k], "targets")
    # Each cell has its categories' targets beside it (null: none), so that a round joins only its sums.
    aimed = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for k in powers:
        aimed = aimed.join(wanted[k].select(F.col(k).alias("_category"), F.col("target").alias(f"_target_{k}")), F.col(k) == F.col("_category"), "left").drop("_category")
    now = written(aimed, "cells")
    off = None
    for _ in range(SWEEPS):
        step = now
        for k in powers:
            sums = step.groupBy(k).agg(F.sum("weight").alias("sum"), F.first(f"_target_{k}").alias("target"))
            factor = sums.select(F.col(k).alias("_category"), F.coalesce(F.try_divide("target", "sum"), F.lit(0.0)).alias("_factor"))
            step = step.join(factor, F.col(k) == F.col("_category")).withColumn("weight", F.col("weight") * F.col("_factor")).drop("_category", "_factor")
        following = written(step, "cells")
        last, off = off, _gaps(following, list(powers))
        dropped(now)
        now = following
        if max(off.values(), default=0.0) <= TOLERANCE or (last and all(abs(off[k] - last[k]) <= TOLERANCE / 100 for k in off)):
            break
    else:
        warnings.warn(f"marginals are off their targets by up to {max(off.values())} after {SWEEPS} rounds", stacklevel=2)
    dropped(*wanted.values())
    out = now.drop(*[f"_target_{k}" for k in powers])
    out._scratch_path = now._scratch_path
    return out


def _gaps(cells: DataFrame, wanted: list[str]) -> dict[str, float]:
    """How far the marginals of each attribute are off their targets, at most."""
    gaps = None
    for k in wanted:
        sums = cells.groupBy(k).agg(F.sum("weight").alias("sum"), F.first(f"_target_{k}").alias("target"))
        one = sums.select(F.lit(k).alias("attribute"), F.abs(F.col("sum") - F.coalesce("target", F.lit(0.0))).alias("gap"))
        gaps = one if gaps is None else gaps.union(one)
    found = {r.attribute: r.gap for r in gaps.groupBy("attribute").agg(F.max("gap").alias("gap")).collect()}
    return {k: found.get(k) or 0.0 for k in wanted}


def calibrated(weights: DataFrame, share: float = SHARE) -> DataFrame:
    """weights(tokens, weight) with probability; the expected tokens are share of all, or what cells with weight have.

    The constant is raised until no further cell is taken whole.
    """
    wanted = share * (weights.agg(F.sum("tokens")).first()[0] or 0)
    constant, taken = wanted / (weights.agg(F.sum("weight")).first()[0] or 1.0), None
    while True:
        whole = F.col("tokens") <= F.lit(constant) * F.col("weight")
        r = weights.agg(F.count_if(whole).alias("n"), F.sum(F.when(whole, F.col("tokens")).otherwise(0)).alias("t"), F.sum(F.when(~whole, F.col("weight")).otherwise(0.0)).alias("w")).first()
        if r.n == taken or not r.w:
            break
        constant, taken = max(0.0, wanted - r.t) / r.w, r.n
    return weights.withColumn("probability", F.least(F.lit(1.0), F.lit(float(constant)) * F.col("weight") / F.col("tokens")))


def chance(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 (exclusive) by the id: from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The sampled rows of docs(doc_id, text, source, lang), with topic, n_tokens and probability.

    These replace columns of their names. Null sources, languages and ids are categories and an id of their own.
    Texts that are null or without words have no weight and are never sampled. Rows of one doc_id have the same
    chance, so that repeated rows stay or go together. Texts of any length are counted whole. An empty table stays empty.
    """
    text = F.col("text").cast("string")
    attributes = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.coalesce(text, F.lit("")))}
    cells = written(cells_of(docs, attributes, tokens_of(text)), "cells")
    weights = fitted(cells, powers, targets)
    pre = fresh(docs, "_mix")
    renamed = [F.col(k).alias(f"{pre}{k}") for k in attributes]
    chosen = written(calibrated(weights, share).select(*renamed, F.col("probability").alias(f"{pre}p")), "probabilities")
    dropped(cells)
    on = [F.coalesce(c.cast("string"), F.lit(NONE)) == F.col(f"{pre}{k}") for k, c in attributes.items()]
    out = docs.join(small(chosen), on).where(chance(F.col("doc_id"), seed) < F.col(f"{pre}p"))
    out = out.withColumns({"topic": attributes["topic"], "n_tokens": tokens_of(text), "probability": F.col(f"{pre}p")}).where("n_tokens > 0")
    return out.drop(*chosen.columns)
