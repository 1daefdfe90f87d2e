"""The order machine over a stream of actions, with its deadlines as timers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import after
from .events import timed

# Minutes within which an order has to be accepted, and started after that.
ACCEPT_MINUTES, START_MINUTES = 15, 30
STATE = "status string, funds string, applied int, first_ms long, accepted_ms long"
OUT = "order_id long, status string, funds string, applied int, by_deadline boolean"
#: Needed by the state: transformWithState keeps it in RocksDB.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Machine(StatefulProcessor):
    """A value for each order, and timers for what has to happen next; a deadline cancels in the name of the system."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("order", STATE)

    def _load(self):
        if not self.held.exists():
            return ["pending_accept", "held", 0, None, None]
        return list(self.held.get())

    def _out(self, key, state, late: bool) -> pd.DataFrame:
        self.held.update(tuple(state))
        return pd.DataFrame({"order_id": [key[0]], "status": [state[0]], "funds": [state[1]], "applied": [state[2]], "by_deadline": [late]})

    def _deadline(self, state) -> int | None:
        if state[0] == "pending_accept" and state[3] is not None:
            return state[3] + ACCEPT_MINUTES * 60_000
        if state[0] == "accepted" and state[4] is not None:
            return state[4] + START_MINUTES * 60_000
        return None

    def handleInputRows(self, key, rows, timerValues):
        state = self._load()
        for _, r in pd.concat(list(rows)).sort_values(["ms", "tie"]).iterrows():
            state[3] = int(r["ms"]) if state[3] is None else state[3]
            new = after(state[0], state[1], r["action"], r["actor"])
            if new is not None:
                if new[0] == "accepted":
                    state[4] = int(r["ms"])
                state[:2], state[2] = new, state[2] + 1
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (due := self._deadline(state)) is not None:
            self.handle.registerTimer(due)
        yield self._out(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self._load()
        due = self._deadline(state)
        if due is None or due > expiredTimerInfo.getExpiryTimeInMs():
            return
        new = after(state[0], state[1], "cancel", "system")
        state[:2], state[2] = new, state[2] + 1
        yield self._out(key, state, True)

    def close(self) -> None:
        pass


def order_states(actions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """order_id, status, funds, applied, by_deadline: what each order that changed has come to, in update mode.

    ``actions``: order_id, tie, action, actor, ts of a stream. Actions of a trigger are applied in order of their times, and
    ``tie``; those later than the watermark are dropped by it. An order waits ``ACCEPT_MINUTES`` from its first action to be
    accepted and ``START_MINUTES`` from then to be started; when the watermark passes that, it is cancelled and refunded.
    The session needs ``CONF``.
    """
    rows = timed(actions, late).withColumn("ms", F.unix_millis("ts"))
    return rows.select("order_id", "tie", "action", "actor", "ts", "ms").groupBy("order_id").transformWithStateInPandas(statefulProcessor=Machine(), outputStructType=OUT, outputMode="Update", timeMode="eventTime")
