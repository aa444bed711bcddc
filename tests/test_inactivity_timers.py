"""Inactivity: one timer a key, however many rows it has; what is over comes out at once."""

import types

import pandas as pd

from tarnwick import streaming


class Handle:
    def __init__(self):
        self.timers, self.value, self.calls = set(), None, 0

    def getValueState(self, *_):  # noqa: N802
        return types.SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_one_timer_a_key(spark, monkeypatch):
    events = spark.createDataFrame([(1, pd.Timestamp("2024-01-01").to_pydatetime())], "user_id long, ts timestamp")
    caught, hour, start = [], 3_600_000, 1_704_067_200_000
    monkeypatch.setattr(type(events.groupBy("user_id")), "transformWithStateInPandas", lambda self, p, *_, **__: caught.append(p))
    streaming.inactivity(events, "user_id", "ts", 2 * hour)
    handle, idle = Handle(), caught[0]
    idle.init(handle)
    at = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms, getExpiryTimeInMs=lambda: ms)
    times = [start + 3 * hour * i for i in range(50)]
    list(idle.handleInputRows((1,), iter([pd.DataFrame({"ts": pd.to_datetime(times, unit="ms", utc=True)})]), at(0)))
    assert handle.timers == {start + 2 * hour} and handle.calls == 1
    handle.timers.clear()
    seen = lambda found: [t.value // 1_000_000 for f in found for t in f.get("last_seen", [])]
    assert seen(idle.handleExpiredTimer((1,), at(times[29] + hour), at(start + 2 * hour))) == times[:29]
    assert handle.timers == {times[29] + 2 * hour}
    list(idle.handleInputRows((1,), iter([pd.DataFrame({"ts": pd.to_datetime([times[29] + 2 * hour], unit="ms", utc=True)})]), at(times[29] + hour)))
    assert seen(idle.handleExpiredTimer((1,), at(times[49] + 9 * hour), at(times[29] + 2 * hour))) == times[30:]  # the new row is within the gap of times[29], and times[30] within its own
    assert handle.value is None
