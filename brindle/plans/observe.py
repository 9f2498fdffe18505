"""What the engine learns from statements: access statistics, trails, observed values, structure and layout advice.

All of it is advisory: results never depend on it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from ..functions.decay import Score

#: Fixed values.
SIGHTINGS, TRAIL_ENTRIES = 4096, 253
OBSERVED_VALUES, OBSERVED_ENTRIES = 4096, 4096
ONE = 1 << 16  # a whole in 16.16 fixed point


@dataclass
class Access:
    """How often, and when last, a (kind, relation, columns) access ran."""

    counts: Counter = field(default_factory=Counter)
    last: dict = field(default_factory=dict)
    scores: dict = field(default_factory=dict)

    def record(self, kind: str, relation: str, columns: tuple[str, ...], now: int, half_life: int) -> None:
        key = (kind, relation.lower(), columns)
        self.counts[key] += 1
        self.last[key] = now
        self.scores.setdefault(key, Score()).touch(now, half_life)

    def walks(self, relation: str, now: int, half_life: int) -> float:
        """How often the relation is read whole, decayed."""
        return sum(s.read(now, half_life) / 256 for k, s in self.scores.items() if k[:2] == ("FilterScan", relation.lower()) or k[:2] == ("Scan", relation.lower()))

    def rows(self, now: int, half_life: int) -> list[tuple]:
        return [(*k[:2], ",".join(k[2]), n, self.last[k], self.scores[k].read(now, half_life) / 256) for k, n in sorted(self.counts.items())]


class TrailRecorder:
    """Recorded row keys of statement instances: automatic ones from their second sighting, declared ones from the first."""

    def __init__(self):
        self.seen: Counter = Counter()
        self.trails: dict[tuple[int, int], tuple[int, ...]] = {}

    def offer(self, instance: tuple[int, int], keys: list[int], declared: bool = False) -> bool:
        """Record the keys a statement touched; whole or not at all."""
        if len(self.seen) >= SIGHTINGS and instance not in self.seen:
            self.seen.clear()
        self.seen[instance] += 1
        if len(keys) > TRAIL_ENTRIES or self.seen[instance] < (1 if declared else 2):
            return False
        if len(self.trails) >= SIGHTINGS:
            self.trails.clear()  # bounded; a trail that is gone is recorded again
        self.trails[instance] = tuple(keys)
        return True


class ObservedValues:
    """Which values of a column have their rows recorded; caps refuse, entries only grow until a value is let go."""

    def __init__(self):
        self.values: dict[object, set[int]] = {}

    def observe(self, value, keys: set[int]) -> bool:
        if value not in self.values and len(self.values) >= OBSERVED_VALUES or len(keys) > OBSERVED_ENTRIES:
            return False
        self.values[value] = set(keys)
        return True

    def add(self, value, key: int) -> bool:
        """A new row with an observed value; a set that would pass its cap is let go, which is always right."""
        if value not in self.values:
            return False
        if len(self.values[value]) >= OBSERVED_ENTRIES:
            self.forget(value)
            return False
        self.values[value].add(key)
        return True

    def forget(self, value) -> None:
        self.values.pop(value, None)

    def rows(self, value) -> set[int] | None:
        return self.values.get(value)


# ---- structure advice
@dataclass(frozen=True)
class Shape:
    """Evidence of one statement shape: executions and pages read, both decayed (1/256); ``cabin``: what serves it now, 0: nothing."""

    relation: int
    column: int
    frequency: int
    pages: int
    cabin: int = 0


@dataclass(frozen=True)
class Quality:
    """Decayed counts (1/256) of a cabin: lookups, hints that failed, values it didn't cover."""

    cabin: int
    lookups: int
    failures: int = 0
    misses: int = 0


@dataclass(frozen=True)
class Action:
    what: str
    reason: str
    relation: int
    column: int
    cabin: int
    benefit: int
    cost: int


@dataclass(frozen=True)
class Policy:
    """The optimizer's settings, ratios in 16.16."""

    create: int = 3 * ONE
    drop: int = ONE // 2
    swap: int = 2 * ONE
    extend: int = ONE // 5
    heal: int = ONE // 10
    confirm: int = 3
    budget: int = 1024
    lookup_pages: int = 2
    heal_pages: int = 2
    amortised: int = 64 * ONE
    cooldown: int = 128
    half_life: int = 600_000_000_000
    estimate_divisor: int = 8


def times(a: int, b: int) -> int:
    return a * b >> 16


def over(a: int, b: int) -> int:
    return (a << 16) // b if b else 0


@dataclass
class _Entry:
    state: str = "candidate"  # candidate, building, active, decaying
    streak: int = 0
    cabin: int = 0
    pages: int = 0
    baseline: int = 0
    since: int = 0
    healed: bool = False


@dataclass
class _Sums:
    """A candidate's evidence in one snapshot."""

    saved: int = 0
    scan: int = 0
    frequency: int = 0
    lookups: int = 0
    failing: int = 0
    missing: int = 0
    foreign: bool = False


class StructureOptimizer:
    """Decides from snapshots which lookup structures to create, extend, heal and drop; pure over its own state.

    A candidate's benefit is the pages it would save at the rate its shapes run;
    its cost a scan spread over the time a build is good for, and the repairs of
    failing hints.  Both thresholds and a run of confirming snapshots keep it from flapping.
    """

    def __init__(self, policy: Policy = Policy()):
        self.policy, self.entries = policy, {}

    def built(self, relation: int, column: int, cabin: int, pages: int) -> None:
        e = self.entries[relation, column]
        e.state, e.cabin, e.pages = "active", cabin, pages

    def failed(self, relation: int, column: int) -> None:
        self.entries.pop((relation, column), None)

    def dropped(self, relation: int, column: int) -> None:
        self.entries.pop((relation, column), None)

    def _gather(self, shapes: list[Shape], qualities: list[Quality]) -> dict:
        p, sums = self.policy, {k: _Sums() for k in self.entries}
        for s in shapes:
            key = (s.relation, s.column)
            own = sums.setdefault(key, _Sums())
            if s.cabin and (key not in self.entries or self.entries[key].cabin != s.cabin):
                own.foreign = True
                continue
            rate, mean = s.frequency << 8, over(s.pages << 8, s.frequency << 8)
            own.saved += times(rate, max(0, mean - p.lookup_pages * ONE))
            own.scan = max(own.scan, mean)
            own.frequency += rate
        by_cabin = {q.cabin: q for q in qualities}
        for key, e in self.entries.items():
            if e.cabin in by_cabin and e.cabin:
                q, own = by_cabin[e.cabin], sums[key]
                own.lookups, own.failing, own.missing = q.lookups << 8, over(q.failures, q.lookups), over(q.misses, q.lookups)
        return dict(sorted(sums.items()))

    def _worth(self, e: _Entry, s: _Sums) -> tuple[int, int]:
        p = self.policy
        kept = e.baseline if e.state in ("active", "decaying") else 0
        benefit = times(s.frequency, max(0, kept - p.lookup_pages * ONE)) if kept else s.saved
        return benefit, over(kept or s.scan, p.amortised) + times(times(s.failing, s.lookups), p.heal_pages * ONE)

    def decide(self, shapes: list[Shape], qualities: list[Quality], now: int) -> list[Action]:
        sums, actions, acted = self._gather(shapes, qualities), [], set()
        for key, s in sums.items():
            if s.foreign or key in acted or (key not in self.entries and not s.saved):
                continue
            e = self.entries.setdefault(key, _Entry())
            benefit, cost = self._worth(e, s)

            def act(what, reason, at=key, cabin=None, value=benefit):
                acted.add(at)
                actions.append(Action(what, reason, *at, e.cabin if cabin is None else cabin, value, cost))

            getattr(self, "_" + e.state)(key, e, s, sums, benefit, cost, now, act)
        return actions

    def _candidate(self, key, e, s, sums, benefit, cost, now, act) -> None:
        p = self.policy
        e.streak = e.streak + 1 if benefit > times(p.create, cost) else 0
        if not e.streak or e.streak < p.confirm:
            return
        pages = max(1, (s.scan >> 16) // p.estimate_divisor)
        if sum(x.pages for x in self.entries.values()) + pages > p.budget:
            rivals = [(self._worth(x, sums[k])[0], k) for k, x in self.entries.items() if x.state == "active"]
            if not rivals or benefit <= times(p.swap, min(rivals)[0]):
                return
            worst, at = min(rivals)
            act("DROP", "budget-swap", at, self.entries[at].cabin, worst)
            self.entries[at].state, self.entries[at].since = "decaying", now
        e.state, e.pages, e.streak, e.baseline = "building", pages, 0, s.scan
        act("CREATE", "sustained-benefit", cabin=0)

    def _building(self, *_) -> None:
        """The build's outcome is reported by ``built`` or ``failed``."""

    def _active(self, key, e, s, sums, benefit, cost, now, act) -> None:
        p = self.policy
        if not benefit or benefit < times(p.drop, cost):
            e.state, e.since = "decaying", now
        elif s.failing > p.heal:
            act(*(("DROP", "quality-collapse") if e.healed else ("HEAL", "quality-heal")))
            e.healed = True
        else:
            e.healed = False
            if s.missing > p.extend and times(benefit, s.missing) > times(p.create, times(cost, s.missing)):
                act("EXTEND", "coverage-expansion")

    def _decaying(self, key, e, s, sums, benefit, cost, now, act) -> None:
        if benefit > times(self.policy.create, cost):
            e.state = "active"
        elif e.cabin and now - e.since >= self.policy.cooldown * self.policy.half_life:
            act("DROP", "sustained-decay")


# ---- layout advice
def relayout(files: list[int], target: int = 128 << 20, walks: float = 1.0) -> list[dict]:
    """What rewriting a relation's files (sizes in bytes) would save: benefit = files saved x how often it is walked."""
    small = [n for n in files if n < target // 2]
    after = max(1, math.ceil(sum(small) / target)) if small else 0
    saved = len(small) - after
    blocked = "fewer than two small files" if len(small) < 2 else "never walked" if walks <= 0 else None
    return [{"action": "compact", "files": len(small), "files_after": after, "benefit": max(0, saved) * walks, "blocked": blocked}]


def id_budget(used: int) -> dict:
    """How much of the key space is used, and whether to warn (from 90 %)."""
    from ..functions.types import KEY_MAX

    return {"capacity": KEY_MAX, "used": used, "left": KEY_MAX - used, "warn": used * 10 >= KEY_MAX * 9}
