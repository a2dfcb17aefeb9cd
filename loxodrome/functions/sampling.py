"""Randomness as a pure function of (seed, row key, slot): the same rows for any partitioning and after any retry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import let

COORD_LAT, COORD_LON = 89.5, 179.5


class Draws:
    """Uniform draws of one row key; every use names a slot of its own."""

    def __init__(self, key: Column, seed: int = 0):
        self.key, self.seed = key, seed

    def uniform(self, slot: str | Column) -> Column:
        """In [0, 1), with 52 bits."""
        slot = F.lit(slot) if isinstance(slot, str) else slot
        key = F.coalesce(F.concat(self.key.cast("string"), F.lit(":")), F.lit(""))
        digest = F.md5(F.concat(F.lit(f"{self.seed}:"), key, slot))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)

    def between(self, slot: str, low: float, high: float) -> Column:
        return low + (high - low) * self.uniform(slot)

    def choose(self, options: Sequence[str] | Column, slot: str) -> Column:
        """One of the options, all alike."""
        if not isinstance(options, Column) and len(options) == 1:
            return F.lit(options[0])
        many = F.size(options) if isinstance(options, Column) else len(options)
        options = options if isinstance(options, Column) else F.array(*[F.lit(x) for x in options])
        return F.element_at(options, (F.floor(self.uniform(slot) * many) + 1).cast("int"))

    def one_of(self, options: Sequence[Column], slot: str) -> Column:
        """As `choose`, of columns of which only the one drawn is evaluated."""
        if len(options) == 1:
            return options[0]

        def drawn(at: Column) -> Column:
            out = F.when(at == 0, options[0])
            for i, x in enumerate(options[1:-1], 1):
                out = out.when(at == i, x)
            return out.otherwise(options[-1])

        return let(F.floor(self.uniform(slot) * len(options)).cast("int"), drawn)

    def weighted(self, weights: Mapping[str, float], slot: str) -> Column:
        """A key by weight; negative weights are 0, and without any weight it is the first key."""
        total = sum(max(0.0, w) for w in weights.values())
        keys = list(weights)
        if total <= 0:
            return F.lit(keys[0])

        def drawn(at: Column) -> Column:
            out, reached = None, 0.0
            for k in keys:
                reached += max(0.0, weights[k])
                out = F.when(at <= reached, k) if out is None else out.when(at <= reached, k)
            return out.otherwise(keys[-1])

        return let(self.uniform(slot) * total, drawn)

    def maybe(self, p: float, slot: str) -> Column:
        if p <= 0 or p >= 1:
            return F.lit(p >= 1)
        return self.uniform(slot) < min(1.0, max(0.0, p))

    def sample(self, options: Column, k: int | Column, slot: str) -> Column:
        """k of the options without replacement, in random order."""
        dealt = F.transform(options, lambda x, i: F.struct(self.uniform(F.concat_ws(":", F.lit(slot), i.cast("string"))).alias("u"), x.alias("x")))
        return F.slice(F.transform(F.array_sort(dealt), lambda s: s.x), F.lit(1), F.lit(k) if isinstance(k, int) else k)

    def coord(self, slot: str) -> tuple[Column, Column]:
        """Latitude and longitude away from the poles and the antimeridian."""
        return self.between(f"{slot}:lat", -COORD_LAT, COORD_LAT), self.between(f"{slot}:lon", -COORD_LON, COORD_LON)
