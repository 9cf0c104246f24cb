"""Stateful processors: the health of a source, and the cooldown of alerts.

Both keep a bounded state per key in the state store and give the same result
in whatever micro-batches the rows arrive, as long as none is later than the
lateness they are told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STREAK_OUTPUT = ("consecutive_failures long, last_status string, last_error string, last_items_found long, last_success_us long")
_STREAK = ("good_at long, good_id long, settled long, settled_until long, last_at long, last_id long, "
           "last_status string, last_error string, last_items long")
_NEVER = -(1 << 62)


def _after(at: np.ndarray, ids: np.ndarray, good: tuple[int, int]) -> np.ndarray:
    return (at > good[0]) | ((at == good[0]) & (ids > good[1]))


class Streak(StatefulProcessor):
    """Failures of a source since its last useful run, and its last run.

    Failures older than the newest run by more than the lateness are settled: only
    their number and the time of the newest of them are kept, so a source that
    always fails does not grow.  Younger ones are kept one by one, because a useful
    run that arrives late may still end the streak before them.  A useful run later
    than that still counts as a success, but settled failures after it stay counted.
    """

    def __init__(self, lateness_us: int, key_columns: list[str]):
        self.lateness, self.key_columns = lateness_us, key_columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.summary = handle.getValueState("summary", _STREAK)
        self.recent = handle.getListState("recent", "at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.summary.get() if self.summary.exists() else (_NEVER, _NEVER, 0, _NEVER, _NEVER, _NEVER, None, None, 0)
        good, settled, until, last, run = tuple(known[:2]), known[2], known[3], tuple(known[4:6]), known[6:]
        earlier = list(self.recent.get()) if self.recent.exists() else []
        at, ids = np.array([r[0] for r in earlier], np.int64), np.array([r[1] for r in earlier], np.int64)
        for part in rows:
            t, i, failed = part["run_at"].to_numpy(np.int64), part["run_id"].to_numpy(np.int64), part["is_failed"].to_numpy(bool)
            newest = np.lexsort((i, t))[-1]
            if (t[newest], i[newest]) > last:
                last = (int(t[newest]), int(i[newest]))
                row = part.iloc[newest]
                run = (row["status"], row["error_message"], int(row["items"]))
            if not failed.all():
                best = np.lexsort((i, t, ~failed))[-1]
                found = (int(t[best]), int(i[best]))
                if found > good:
                    good, settled = found, settled if found[0] <= until else 0
            at, ids = np.concatenate([at, t[failed]]), np.concatenate([ids, i[failed]])
            open_ = _after(at, ids, good)
            at, ids = at[open_], ids[open_]
        old = at < last[0] - self.lateness
        if old.any():
            settled, until = settled + int(old.sum()), max(until, int(at[old].max()))
            at, ids = at[~old], ids[~old]
        self.summary.update((*good, settled, until, *last, *run))
        self.recent.put(list(zip(at.tolist(), ids.tolist()))) if len(at) else self.recent.clear()
        yield pd.DataFrame({
            **{c: [v] for c, v in zip(self.key_columns, key)}, "consecutive_failures": [settled + len(at)], "last_status": [run[0]],
            "last_error": [run[1]], "last_items_found": [run[2]], "last_success_us": pd.array([None if good[0] == _NEVER else good[0]], "Int64")})

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Rounds that send an alert, each once, when the watermark has passed their end.

    A timer closes a round; closed rounds are judged in order of time against the
    clock, the last delivered alert.  Another timer forgets a clock that no round
    can meet any more, so a quiet group keeps no state.  Rows of closed rounds are dropped.
    """

    def __init__(self, cooldown: int, length: int, key_columns: list[str]):
        self.cooldown, self.length, self.key_columns = cooldown, length, key_columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rounds = handle.getMapState("rounds", "start long", "broken long, delivered boolean")
        self.clock = handle.getValueState("clock", "at long")

    def _end(self, start: int) -> int:
        return (start + self.length) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            sums = part.groupby("round_start").agg(broken=("broken", "sum"), delivered=("delivered", "max"))
            for start, broken, delivered in sums.itertuples():
                start, broken, delivered = int(start), int(broken), bool(delivered)
                if self._end(start) <= watermark:
                    continue
                if self.rounds.containsKey((start,)):
                    b, d = self.rounds.getValue((start,))
                    broken, delivered = broken + b, delivered or d
                else:
                    self.handle.registerTimer(self._end(start))
                self.rounds.updateValue((start,), (broken, delivered))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        clock = self.clock.get()[0] if self.clock.exists() else None
        sent = []
        # the first timer that fires closes every round that is over; the others find none
        for start, broken, delivered in sorted((int(k[0]), *v) for k, v in self.rounds.iterator() if self._end(int(k[0])) <= now):
            self.rounds.removeKey((start,))
            if broken > 0 and (clock is None or start - clock > self.cooldown):
                sent.append((start, bool(delivered)))
                if delivered:
                    clock = start
                    self.clock.update((clock,))
                    self.handle.registerTimer(self._end(clock + self.cooldown))
        if clock is not None and self._end(clock + self.cooldown) <= now:
            self.clock.clear()
        if sent:
            yield pd.DataFrame({**{c: [v] * len(sent) for c, v in zip(self.key_columns, key)},
                                "round_start": [s for s, _ in sent], "delivered": [d for _, d in sent]})

    def close(self) -> None:
        pass
