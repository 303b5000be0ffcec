"""Pattern detection: a small builder that compiles to window functions, and state machines as folds."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold


@dataclass(frozen=True)
class Step:
    name: str
    condition: Column | None = None
    times: int = 1
    strict: bool = False


@dataclass(frozen=True)
class Pattern:
    """``Pattern.begin("a").where(...).times(3).consecutive().next("b").where(...).within(5)``.

    ``next`` means the very next row of the key. ``times(n)`` alone skips rows that its step's condition doesn't hold for;
    with ``consecutive`` the n rows follow each other.
    """

    steps: tuple[Step, ...] = field(default=())
    within_s: float | None = None

    @classmethod
    def begin(cls, name: str) -> Pattern:
        return cls((Step(name),))

    def _last(self, **changes) -> Pattern:
        return replace(self, steps=(*self.steps[:-1], replace(self.steps[-1], **changes)))

    def where(self, condition: Column) -> Pattern:
        """Further conditions of a step must all hold."""
        before = self.steps[-1].condition
        return self._last(condition=condition if before is None else before & condition)

    def times(self, n: int) -> Pattern:
        return self._last(times=n)

    def consecutive(self) -> Pattern:
        return self._last(strict=True)

    def next(self, name: str) -> Pattern:
        return replace(self, steps=(*self.steps, Step(name)))

    def within(self, seconds: float) -> Pattern:
        return replace(self, within_s=seconds)

    @property
    def flat(self) -> list[tuple[str, Column]]:
        always = F.lit(True)
        return [(s.name if s.times == 1 else f"{s.name}_{i + 1}", s.condition if s.condition is not None else always) for s in self.steps for i in range(s.times)]


def _micros(column) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def match(df: DataFrame, pattern: Pattern, keys: list[str], ts: str, order: list[str] | None = None) -> DataFrame:
    """A row per match (overlapping ones included): the keys and <step>_ts of each step's row. One sort per key."""
    if any(s.times > 1 and not s.strict for s in pattern.steps):
        if len(pattern.steps) > 1:
            raise ValueError("times() without consecutive() is for patterns of one step")
        if (condition := pattern.steps[0].condition) is not None:
            df = df.where(condition)
    w = W.partitionBy(*keys).orderBy(*(order or [ts]))
    steps = pattern.flat
    n = len(steps)
    rows = df.select(*keys, ts, *(order or []), *(c.alias(f"_c{i}") for i, (_, c) in enumerate(steps)))
    back = lambda c, i: F.lag(c, n - 1 - i).over(w) if i < n - 1 else F.col(c)
    rows = rows.select(*keys, *(back(f"_c{i}", i).alias(f"_h{i}") for i in range(n)), *(back(ts, i).alias(f"{name}_ts") for i, (name, _) in enumerate(steps)))
    hit = F.lit(True)
    for i in range(n):
        hit = hit & F.coalesce(F.col(f"_h{i}"), F.lit(False))
    if pattern.within_s is not None and n > 1:
        hit = hit & (_micros(f"{steps[-1][0]}_ts") - _micros(f"{steps[0][0]}_ts") < int(pattern.within_s * 1e6))
    return rows.where(hit).select(*keys, *(f"{name}_ts" for name, _ in steps))


def match_or_timeout(df: DataFrame, pattern: Pattern, keys: list[str], ts: str, order: list[str] | None = None) -> DataFrame:
    """For each row that begins a two-step pattern: matched, if the very next row completes it within the time, timeout
    if that row comes too late or never, and nothing if it comes in time but is another. Adds status."""
    (first, begins), (second, completes) = pattern.flat
    w = W.partitionBy(*keys).orderBy(*(order or [ts]))
    rows = df.select(*keys, ts, F.coalesce(begins, F.lit(False)).alias("_b"), F.lead(F.coalesce(completes, F.lit(False))).over(w).alias("_n"), F.lead(ts).over(w).alias("_t")).where("_b")
    in_time = _micros("_t") - _micros(ts) < int(pattern.within_s * 1e6)
    status = F.when(F.col("_t").isNull() | ~in_time, "timeout").when(F.col("_n"), "matched")
    out = rows.withColumn("status", status).where("status IS NOT NULL")
    return out.select(*keys, F.col(ts).alias(f"{first}_ts"), F.when(F.col("status") == "matched", F.col("_t")).alias(f"{second}_ts"), "status")


def state_machine(df: DataFrame, transitions: dict[tuple[str, str], str], start: str, emits: dict[str, tuple[str, str]], keys: list[str], event: str, ts: str, order: list[str]) -> DataFrame:
    """Fold each key's events, in order, through a transition table; unknown events leave the state as it is.

    ``emits`` maps a state to (output, state to go on from). Columns: keys, ts, output.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), df.schema[ts], T.StructField("output", T.StringType())])

    class Machine:
        def __init__(self, key):
            self.key, self.state = key, start

        def row(self, event, at):
            self.state = transitions.get((self.state, event), self.state)
            if self.state not in emits:
                return ()
            output, self.state = emits[self.state]
            return [(*self.key, at, output)]

        def end(self):
            return ()

    return fold(df, keys, order, [event, ts], schema, Machine)


def rising_alerts(df: DataFrame, keys: list[str], ts: str, order: list[str], value: str, for_ms: int) -> DataFrame:
    """An alert where values have not fallen for ``for_ms`` since their first rise.

    A rise arms a timer unless one runs, a fall disarms it, an equal value does neither; a timer due at the time of a row
    fires before the row. After an alert the next rise arms again. ``order`` begins with ``ts``. A fold that holds the
    last value and the timer of one key. Columns: keys, alert_ms.
    """
    rows = df.select(*keys, *order, F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms"), F.col(value).alias("_v"))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("alert_ms", T.LongType())])

    class Alerts:
        def __init__(self, key):
            self.key, self.last, self.armed = key, None, None

        def row(self, ms, v):
            before, self.last = self.last, v
            if before is None or v is None or v == before or v > before and self.armed is not None and ms < self.armed:
                return ()
            out = self.end() if self.armed is not None and self.armed <= ms else ()
            self.armed = ms + for_ms if v > before else None
            return out

        def end(self):
            return [(*self.key, self.armed)] if self.armed is not None else ()

    return fold(rows, keys, order, ["_ms", "_v"], schema, Alerts)
