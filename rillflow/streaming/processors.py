"""Stateful processors for ``transformWithState``, one for each kind of keyed state and timer.

Rows of a micro-batch come unsorted: each processor sorts them by ``seq``. Spark hands a processor a batch's rows before
the timers that the batch has made due, so processors with deadlines check them against the watermark first.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAX = (1 << 63) - 1


def _sorted(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r.seq)


def _columns(rows: Iterator[Row], *names: str) -> list[tuple]:
    """The named columns of the rows, the first of which they are sorted by; looked up by name once, not for every row."""
    first = next(rows, None)
    if first is None:
        return []
    take = itemgetter(*(first.__fields__.index(n) for n in names))
    return sorted((take(tuple(r)) for r in chain([first], rows)), key=itemgetter(0))


class Statistics(StatefulProcessor):
    """Value state: min, max, sum, count and truncating average after each row. Input: key, seq, v."""

    OUTPUT = "key bigint, seq bigint, min bigint, max bigint, sum bigint, count bigint, avg bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acc = handle.getValueState("acc", "min bigint, max bigint, sum bigint, count bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        acc = tuple(self.acc.get()) if self.acc.exists() else None
        for r in _sorted(rows):
            acc = (r.v, r.v, r.v, 1) if acc is None else (min(acc[0], r.v), max(acc[1], r.v), acc[2] + r.v, acc[3] + 1)
            yield Row(key=key[0], seq=r.seq, min=acc[0], max=acc[1], sum=acc[2], count=acc[3], avg=int(acc[2] / acc[3]) if abs(acc[2]) < 1 << 52 else abs(acc[2]) // acc[3] * (1 if acc[2] >= 0 else -1))
        if acc is not None:
            self.acc.update(acc)


class SortedHistory(StatefulProcessor):
    """List state: all values so far, sorted, after each row. Input: key, seq, v."""

    OUTPUT = "key bigint, seq bigint, history string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "v bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        values = [x[0] for x in self.seen.get()]
        for r in _sorted(rows):
            values.append(r.v)
            self.seen.appendValue((r.v,))
            yield Row(key=key[0], seq=r.seq, history=",".join(map(str, sorted(values))))


class CountPerValue(StatefulProcessor):
    """Map state: how often each value came, after each row, as the changed entry. Input: key, seq, value."""

    OUTPUT = "key bigint, seq bigint, value string, cnt bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "value string", "cnt bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in _sorted(rows):
            n = 1 + (self.counts.getValue((r.value,))[0] if self.counts.containsKey((r.value,)) else 0)
            self.counts.updateValue((r.value,), (n,))
            yield Row(key=key[0], seq=r.seq, value=r.value, cnt=n)


class Bounded:
    """A watermark generator: each row's time less a bound and 1 ms."""

    def __init__(self, bound: int = 0):
        self.bound = bound

    def __call__(self, row: Row) -> int | None:
        return row.ms - self.bound - 1


class Punctuated:
    """A watermark generator that only marked rows move, to their time less 1 ms, or to the end of time."""

    def __init__(self, column: str, to_end: bool = False):
        self.column, self.to_end = column, to_end

    def __call__(self, row: Row) -> int | None:
        return None if not row[self.column] else MAX if self.to_end else row.ms - 1


class LateSplitter(StatefulProcessor):
    """An own watermark, for all rows under one key: the largest that the generator has given after each row (``Bounded``,
    ``Punctuated`` or any function of a row; None: no change).

    Rows below it are tagged late. A row whose ``flush`` is true moves the watermark to the end of time. Runs with
    timeMode none: under event time Spark would drop late rows before they get here. Input: bucket, seq, ms, flush.
    """

    OUTPUT = "seq bigint, ms bigint, wm_before bigint, tag string"

    def __init__(self, generator: int | Callable[[Row], int | None]):
        self.generator = Bounded(generator) if isinstance(generator, int) else generator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wm = handle.getValueState("wm", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        wm = self.wm.get()[0] if self.wm.exists() else None
        for r in _sorted(rows):
            yield Row(seq=r.seq, ms=r.ms, wm_before=wm, tag="late" if wm is not None and r.ms < wm else "main")
            new = MAX if r.flush else self.generator(r)
            if new is not None:
                wm = new if wm is None else max(wm, new)
        if wm is not None:
            self.wm.update((wm,))


class LateWindows(StatefulProcessor):
    """Tumbling counts with an own watermark, allowed lateness and a late output. Input: bucket, seq, ms, k, flush.

    A window fires when the watermark reaches its end - 1 ms, again for each row within the lateness, and is dropped
    after it; rows that come later are tagged late. ``purge`` empties a window when it fires.
    """

    OUTPUT = "tag string, k bigint, end_ms bigint, cnt bigint, seq bigint"

    def __init__(self, size: int, bound: int, lateness: int, purge: bool = False):
        self.size, self.bound, self.lateness, self.purge = size, bound, lateness, purge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wm = handle.getValueState("wm", "ms bigint")
        self.windows = handle.getMapState("windows", "k bigint, end_ms bigint", "cnt bigint, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        wm = self.wm.get()[0] if self.wm.exists() else None
        before = {tuple(at): tuple(w) for at, w in self.windows.iterator()}
        held = {at: list(w) for at, w in before.items()}
        by_end: dict[int, list[tuple]] = {}  # the held windows; a row looks at those alone that the watermark passes
        for at in held:
            by_end.setdefault(at[1], []).append(at)
        to_fire, to_drop = sorted({at[1] for at, w in held.items() if not w[1]}), sorted(by_end)
        for seq, ms, k, flush in _columns(rows, "seq", "ms", "k", "flush"):
            if not flush:
                end = ms // self.size * self.size + self.size
                if wm is not None and wm >= end - 1 + self.lateness:
                    yield Row(tag="late", k=k, end_ms=end, cnt=0, seq=seq)
                else:
                    passed = wm is not None and wm >= end - 1
                    window = held.get((k, end))
                    if window is None:
                        window = held[k, end] = [0, False]
                        if end not in by_end:
                            by_end[end] = []
                            heapq.heappush(to_drop, end)
                            if not passed:
                                heapq.heappush(to_fire, end)
                        by_end[end].append((k, end))
                    window[0] += 1
                    if passed:
                        window[1] = True
                        yield Row(tag="main", k=k, end_ms=end, cnt=window[0], seq=seq)
                        window[0] = 0 if self.purge else window[0]
            new = MAX if flush else ms - self.bound - 1
            wm = new if wm is None else max(wm, new)
            while to_fire and wm >= to_fire[0] - 1:
                for at in sorted(by_end[heapq.heappop(to_fire)], key=lambda at: (at[0] is not None, at[0])):
                    held[at][1] = True
                    yield Row(tag="main", k=at[0], end_ms=at[1], cnt=held[at][0], seq=seq)
                    held[at][0] = 0 if self.purge else held[at][0]
            while to_drop and wm >= to_drop[0] - 1 + self.lateness:
                for at in by_end.pop(heapq.heappop(to_drop)):
                    del held[at]
        for at in before.keys() - held.keys():
            self.windows.removeKey(at)
        for at, w in held.items():
            if before.get(at) != tuple(w):
                self.windows.updateValue(at, tuple(w))
        if wm is not None:
            self.wm.update((wm,))


class Timers(StatefulProcessor):
    """Registers a timer ``delay`` ms after each row's time (or after now, in processing time) and reports when it fires.

    Timers of equal times are one. Input: key, seq, ms.
    """

    OUTPUT = "key string, kind string, at bigint"

    def __init__(self, delays: tuple[int, ...], processing: bool = False):
        self.delays, self.processing = delays, processing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in _sorted(rows):
            base = timerValues.getCurrentProcessingTimeInMs() if self.processing else r.ms
            for d in self.delays:
                self.handle.registerTimer(base + d)
            yield Row(key=key[0], kind="row", at=r.ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(key=key[0], kind="timer", at=expiredTimerInfo.getExpiryTimeInMs())


class Reconciler(StatefulProcessor):
    """Match one row of each side of a key within ``within`` ms of event time, else report the missing side.

    A match deletes the other side's timer; a second row of a side that waits replaces it. Input: key, seq, side, ms.
    """

    OUTPUT = "key string, left_ms bigint, right_ms bigint, status string"

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "side string, ms bigint")

    def _expire(self, key, side: str, ms: int) -> Row:
        self.waiting.clear()
        left = side == "left"
        return Row(key=key, left_ms=ms if left else None, right_ms=None if left else ms, status="right-missing" if left else "left-missing")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        wm = timerValues.getCurrentWatermarkInMs()
        for r in _sorted(rows):
            if self.waiting.exists():
                side, ms = self.waiting.get()
                if ms + self.within <= wm:  # its timer is due and comes first
                    self.handle.deleteTimer(ms + self.within)
                    yield self._expire(key[0], side, ms)
                elif side != r.side:
                    self.handle.deleteTimer(ms + self.within)
                    self.waiting.clear()
                    yield Row(key=key[0], left_ms=ms if side == "left" else r.ms, right_ms=r.ms if side == "left" else ms, status="matched")
                    continue
                else:
                    self.handle.deleteTimer(ms + self.within)
            self.waiting.update((r.side, r.ms))
            self.handle.registerTimer(r.ms + self.within)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            side, ms = self.waiting.get()
            if ms + self.within == expiredTimerInfo.getExpiryTimeInMs():
                yield self._expire(key[0], side, ms)


class LatestQueryFilter(StatefulProcessor):
    """Two streams in one, by ``is_query``: rows whose value equals the latest query pass. Queries are copied to every
    bucket. Before the first query nothing passes. Input: bucket, seq, is_query, value."""

    OUTPUT = "seq bigint, value string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.query = handle.getValueState("query", "q string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        q = self.query.get()[0] if self.query.exists() else ""
        for r in _sorted(rows):
            if r.is_query:
                q = r.value
            elif r.value == q:
                yield Row(seq=r.seq, value=r.value)
        self.query.update((q,))


class Machine(StatefulProcessor):
    """A transition table over value state; unknown events change nothing. Input: key, seq, event."""

    OUTPUT = "key string, seq bigint, output string"

    def __init__(self, transitions: dict, start: str, emits: dict):
        self.transitions, self.start, self.emits = transitions, start, emits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "s string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self.state.get()[0] if self.state.exists() else self.start
        for r in _sorted(rows):
            s = self.transitions.get((s, r.event), s)
            if s in self.emits:
                out, s = self.emits[s]
                yield Row(key=key[0], seq=r.seq, output=out)
        self.state.update((s,))


class RisingAlert(StatefulProcessor):
    """An alert ``for_ms`` after a rise unless a fall comes first. Event-time timers. Input: key, seq, ms, v."""

    OUTPUT = "key string, alert_ms bigint"

    def __init__(self, for_ms: int):
        self.for_ms = for_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "v double")
        self.timer = handle.getValueState("timer", "ms bigint")
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in _sorted(rows):
            armed = self.timer.get()[0] if self.timer.exists() else None
            if armed is not None and armed <= r.ms:  # due before this row
                self.handle.deleteTimer(armed)
                self.timer.clear()
                yield Row(key=key[0], alert_ms=armed)
                armed = None
            last = self.last.get()[0] if self.last.exists() else None
            if last is not None and r.v > last and armed is None:
                self.timer.update((r.ms + self.for_ms,))
                self.handle.registerTimer(r.ms + self.for_ms)
            elif last is not None and r.v < last and armed is not None:
                self.handle.deleteTimer(armed)
                self.timer.clear()
            self.last.update((r.v,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        yield Row(key=key[0], alert_ms=expiredTimerInfo.getExpiryTimeInMs())


class CountWindow(StatefulProcessor):
    """The sum of each ``size`` rows of a key. Input: key, seq, v."""

    OUTPUT = "key bigint, window_no bigint, total bigint"

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acc = handle.getValueState("acc", "no bigint, n bigint, total bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        no, n, total = self.acc.get() if self.acc.exists() else (0, 0, 0)
        for r in _sorted(rows):
            n, total = n + 1, total + r.v
            if n == self.size:
                yield Row(key=key[0], window_no=no, total=total)
                no, n, total = no + 1, 0, 0
        self.acc.update((no, n, total))


class CountSlide(StatefulProcessor):
    """After each ``slide`` rows of a key the sum of the last ``size`` (fewer at first). Input: key, seq, v."""

    OUTPUT = "key bigint, seq bigint, window_no bigint, total bigint"

    def __init__(self, size: int, slide: int):
        self.size, self.slide = size, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n bigint, v array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, last = self.last.get() if self.last.exists() else (0, [])
        last = list(last)
        for r in _sorted(rows):
            n, last = n + 1, [*last, r.v][-self.size :]
            if n % self.slide == 0:
                yield Row(key=key[0], seq=r.seq, window_no=n // self.slide, total=sum(last))
        self.last.update((n, last))


class ListBufferWindow(StatefulProcessor):
    """Tumbling windows that keep their rows' values in a list until an event-time timer at the window's end less 1 ms, and
    hand it to ``function`` then. Input: key, seq, ms, v."""

    OUTPUT = "key bigint, end_ms bigint, value bigint"

    def __init__(self, size: int, function: Callable[[list], int]):
        self.size, self.function = size, function

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffers = handle.getMapState("buffers", "end_ms bigint", "v array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict = {}
        for r in _sorted(rows):
            new.setdefault(r.ms // self.size * self.size + self.size, []).append(r.v)
        for end, values in new.items():
            held = list(self.buffers.getValue((end,))[0]) if self.buffers.containsKey((end,)) else []
            self.buffers.updateValue((end,), (held + values,))
            self.handle.registerTimer(end - 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() + 1
        if self.buffers.containsKey((end,)):
            values = list(self.buffers.getValue((end,))[0])
            self.buffers.removeKey((end,))
            yield Row(key=key[0], end_ms=end, value=self.function(values))


class EachElement(StatefulProcessor):
    """A tumbling window's count after each row: a trigger that fires on every element. ``purge`` empties the window as it
    fires. Input: key, seq, ms."""

    OUTPUT = "key bigint, seq bigint, end_ms bigint, cnt bigint"

    def __init__(self, size: int, purge: bool = False):
        self.size, self.purge = size, purge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "end_ms bigint", "cnt bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in _sorted(rows):
            end = r.ms // self.size * self.size + self.size
            n = 1 + (self.counts.getValue((end,))[0] if self.counts.containsKey((end,)) else 0)
            self.counts.updateValue((end,), (0 if self.purge else n,))
            yield Row(key=key[0], seq=r.seq, end_ms=end, cnt=n)


class Periodically(StatefulProcessor):
    """A tumbling window's count so far at each multiple of ``every`` ms from its first row's to its last row's: a trigger
    on event-time timers, with the next firing in state. Rows of a key come in the order of their times. Input: key, seq,
    ms."""

    OUTPUT = "key bigint, end_ms bigint, fire_ms bigint, cnt bigint"

    def __init__(self, size: int, every: int, purge: bool = False):
        self.size, self.every, self.purge = size, every, purge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "end_ms bigint, cnt bigint, next_ms bigint, due boolean")

    def _fire(self, key, end, cnt, at) -> Row:
        return Row(key=key[0], end_ms=end, fire_ms=at, cnt=cnt)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end, cnt, at, due = self.window.get() if self.window.exists() else (None, 0, None, False)
        before = at if due else None
        for r in _sorted(rows):
            own = r.ms // self.size * self.size + self.size
            if end is not None and due and (own != end or at <= r.ms):
                yield self._fire(key, end, cnt, at)
                cnt, at, due = 0 if self.purge else cnt, at + self.every, False
            if own != end:
                end, cnt, at = own, 0, r.ms // self.every * self.every + self.every
            while at <= r.ms:
                yield self._fire(key, end, cnt, at)
                at += self.every
            cnt, due = cnt + 1, True
        if before is not None and before != at:
            self.handle.deleteTimer(before)
        if due and before != at:
            self.handle.registerTimer(at)
        self.window.update((end, cnt, at, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end, cnt, at, due = self.window.get()
        if due and at == expiredTimerInfo.getExpiryTimeInMs():
            yield self._fire(key, end, cnt, at)
            self.window.update((end, 0 if self.purge else cnt, at + self.every, False))


class ProcessingSession(StatefulProcessor):
    """Session counts by arrival: a session ends when for ``gap`` ms of processing time nothing comes. Input: key, seq."""

    OUTPUT = "key string, cnt bigint"

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "cnt bigint, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, n = timerValues.getCurrentProcessingTimeInMs(), sum(1 for _ in rows)
        if self.open.exists():
            cnt, until = self.open.get()
            self.handle.deleteTimer(until)
            if until <= now:  # due before these rows
                yield Row(key=key[0], cnt=cnt)
            else:
                n += cnt
        self.open.update((n, now + self.gap))
        self.handle.registerTimer(now + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists() and self.open.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            yield Row(key=key[0], cnt=self.open.get()[0])
            self.open.clear()


class Contiguous(StatefulProcessor):
    """A pattern of strictly contiguous steps: the rows' times whenever the last ``n`` rows of a key fit it; overlapping
    matches all count. Input: key, seq, ms, hits (whether the row fits each step)."""

    OUTPUT = "key bigint, at array<bigint>"

    def __init__(self, n: int, within: int | None = None):
        self.n, self.within = n, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms array<bigint>, hits array<array<boolean>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, hits = map(list, self.last.get()) if self.last.exists() else ([], [])
        for r in _sorted(rows):
            at, hits = [*at, r.ms][-self.n :], [*hits, list(r.hits)][-self.n :]
            if len(at) == self.n and all(h[i] for i, h in enumerate(hits)) and (self.within is None or at[-1] - at[0] < self.within):
                yield Row(key=key[0], at=at)
        self.last.update((at, hits))


class NextWithin(StatefulProcessor):
    """A two-step pattern with a timeout: the row that begins it is matched if the very next row of the key completes it
    within ``within`` ms, times out if that is late or never comes, and is dropped if it is another. Event-time timers.
    Input: key, seq, ms, begins, completes."""

    OUTPUT = "key bigint, first_ms bigint, second_ms bigint, status string"

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.pending.get()[0] if self.pending.exists() else None
        first = stored
        for r in _sorted(rows):
            if first is not None:
                if r.ms - first >= self.within:
                    yield Row(key=key[0], first_ms=first, second_ms=None, status="timeout")
                elif r.completes:
                    yield Row(key=key[0], first_ms=first, second_ms=r.ms, status="matched")
            first = r.ms if r.begins else None
        if stored is not None and stored != first:
            self.handle.deleteTimer(stored + self.within)
        if first is None:
            self.pending.clear()
        elif first != stored:
            self.pending.update((first,))
            self.handle.registerTimer(first + self.within)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists() and self.pending.get()[0] + self.within == expiredTimerInfo.getExpiryTimeInMs():
            yield Row(key=key[0], first_ms=self.pending.get()[0], second_ms=None, status="timeout")
            self.pending.clear()


class TopN(StatefulProcessor):
    """The ``n`` items with the largest counts after each arrival; ties go to the smaller item. Input: key, seq, item, cnt."""

    OUTPUT = "key timestamp_ntz, seq bigint, row_num int, item bigint, cnt bigint"

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "items array<bigint>, counts array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = [(-c, i) for i, c in zip(*self.best.get(), strict=True)] if self.best.exists() else []
        for r in _sorted(rows):
            best = sorted([*best, (-r.cnt, r.item)])[: self.n]
            for k, (c, i) in enumerate(best, 1):
                yield Row(key=key[0], seq=r.seq, row_num=k, item=i, cnt=-c)
        self.best.update(([i for _, i in best], [-c for c, _ in best]))


def run(grouped, processor: StatefulProcessor, mode: str = "append", time: str = "none"):
    """``df.groupBy(key)`` through a processor."""
    return grouped.transformWithState(processor, type(processor).OUTPUT, mode, time)
