"""Time-decayed scores: an exact integer form, and a Column form that aggregates over events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scale of a score (8 fractional bits) and the steps a half-life is cut into.
SCALE, STEPS, BITS = 256, 16, 32
FACTORS = [round(256 * 2 ** (-k / STEPS)) for k in range(STEPS)]


@dataclass
class Score:
    """A score in 1/256 and when it was last touched (ns)."""

    scaled: int = 0
    at: int = 0

    def read(self, now: int, half_life: int) -> int:
        """The decayed score: exact at whole half-lives, between them by STEPS steps; time that runs backwards decays nothing."""
        if not half_life or now <= self.at:
            return self.scaled
        halvings, rest = divmod(now - self.at, half_life)
        return 0 if halvings >= BITS else (self.scaled >> halvings) * FACTORS[rest * STEPS // half_life] >> 8

    def touch(self, now: int, half_life: int, points: int = 1) -> None:
        """Decay to ``now`` and add points; the score stops at its ceiling rather than wrap."""
        self.scaled = min((1 << BITS) - 1, self.read(now, half_life) + points * SCALE)
        self.at = max(self.at, now)


def decayed(weight: Column, age_seconds: Column, half_life: float) -> Column:
    """A weight after its age: weight * 2 ** (-age / half_life).  Summed, it is a group's score."""
    return weight * F.pow(F.lit(2.0), -age_seconds / F.lit(float(half_life)))


def decayed_steps(scaled: Column, age: Column, half_life: int) -> Column:
    """The integer form of ``Score.read`` over bigint columns, within code generation."""
    halvings = F.call_function("div", age, F.lit(half_life))
    step = F.call_function("div", (age % F.lit(half_life)) * STEPS, F.lit(half_life))
    factor = F.element_at(F.array(*map(F.lit, FACTORS)), (step + 1).cast("int")).cast("bigint")
    whole = F.call_function("div", scaled, F.pow(F.lit(2.0), F.least(halvings, F.lit(BITS))).cast("bigint"))
    return F.when(age <= 0, scaled).when(halvings >= BITS, F.lit(0).cast("bigint")).otherwise(F.call_function("div", whole * factor, F.lit(256)))
