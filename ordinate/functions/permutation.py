"""A keyed permutation of [0, n) in column functions: a row's new place follows from its old one, without sorting or shuffling.

A number is a pair (left, right) of a grid of about sqrt(n) by sqrt(n) cells. Rounds add to one half a hash of the other, which can be undone. The grid
has a few cells more than n; a number that lands on one of these is moved on until it lands below n.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError

ROUNDS, PRIME = 6, (1 << 31) - 1


@dataclass(frozen=True)
class Permutation:
    """Of the numbers 0 to n - 1, by a seed. Others, and nulls, give null."""

    n: int
    seed: int

    def __post_init__(self) -> None:
        if not 1 <= self.n < 1 << 60:
            raise ConfigError(f"a permutation of {self.n}")

    @property
    def sides(self) -> tuple[int, int]:
        a = math.isqrt(self.n - 1) + 1
        return a, -(-self.n // a)

    @property
    def walks(self) -> int:
        """Moves after which no number is left on a spare cell: for certain if the spare cells are few, else but for one of 10^30."""
        a, b = self.sides
        return min(a * b - self.n, 4 + math.ceil(70 / math.log(b))) if b > 1 else a * b - self.n

    @property
    def keys(self) -> list[tuple[int, int, int]]:
        """(factor, addend, factor) of each round's hash."""
        out = []
        for k in range(ROUNDS):
            d = hashlib.sha256(f"{self.seed}:{k}".encode()).digest()
            out.append(tuple(1 + int.from_bytes(d[8 * i : 8 * i + 8], "big") % (PRIME - 1) for i in range(3)))
        return out

    def _moved(self, x: Column, sign: int) -> Column:
        """All rounds on, or back. Rounds are a fold over their keys, so that no expression is written out more than once."""
        a, b = self.sides
        rounds = [F.struct(*[F.lit(v).cast("bigint").alias(f"k{i}") for i, v in enumerate(key)], F.lit(bool(r % 2)).alias("odd")) for r, key in enumerate(self.keys)]

        def step(s: Column, key: Column) -> Column:
            h = (F.when(key.odd, s.left).otherwise(s.right) % PRIME * key.k0 + key.k1) % PRIME
            mixed = _let(h, lambda v: v.bitwiseXOR(F.shiftright(v, 15)) % PRIME * key.k2 % PRIME * sign)
            left = F.when(key.odd, s.left).otherwise(F.pmod(s.left + mixed, F.lit(a)))
            return F.struct(left.cast("bigint").alias("left"), F.when(key.odd, F.pmod(s.right + mixed, F.lit(b))).otherwise(s.right).cast("bigint").alias("right"))

        # Quotients are exact: doubles are up to 2^53, decimals beyond.
        kind = "double" if self.n < 1 << 53 else "decimal(20,0)"
        pair = _let(x, lambda v: F.struct((v % a).cast("bigint").alias("left"), ((v - v % a).cast(kind) / F.lit(a).cast(kind)).cast("bigint").alias("right")))
        return F.aggregate(F.array(*(rounds if sign > 0 else rounds[::-1])), pair, step, lambda s: s.left + s.right * a)

    def _walked(self, x: Column, sign: int) -> Column:
        moved = self._moved(x.cast("bigint"), sign)
        if self.walks:
            moved = F.aggregate(F.sequence(F.lit(1), F.lit(self.walks)), moved, lambda y, _: F.when(y < self.n, y).otherwise(self._moved(y, sign)))
        lost = F.raise_error(F.lit("a number stayed on a spare cell")).cast("bigint")
        return F.when((x >= 0) & (x < self.n), _let(moved, lambda y: F.when(y < self.n, y).otherwise(lost)))

    def forward(self, x: Column) -> Column:
        """Where the number x goes."""
        return self._walked(x, 1)

    def inverse(self, y: Column) -> Column:
        """Which number goes to y."""
        return self._walked(y, -1)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def next_index(counter: Column, n: int, seed: int) -> Column:
    """A number of [0, n) for each value of a counter, the same ones for the same seed."""
    if n < 1:
        raise ConfigError(f"an index below {n}")
    u = F.pmod(F.xxhash64(F.lit(seed), counter), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return F.least(F.floor(u * n), F.lit(n - 1)).cast("bigint")
