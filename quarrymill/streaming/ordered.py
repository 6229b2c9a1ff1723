"""State over rows in the order of their times, whatever files and triggers they come in.

Rows of a key wait in state, in slots of time, until the watermark has passed the slot's end; a timer then releases the
slot's rows, sorted, and a rule takes them one after the other. A slot is the most that is in memory at once: a key
with many rows has many slots. Rows that come later than the watermark allows are dropped by the stream, as ever.

``OrderedRule`` subclasses: ``Changes`` (only changes of a state), ``Beats`` (a row for every silent interval of a running
job), ``Topics`` (one stream to three topics that end with a job's last state), ``Merged`` (append and last-write-wins).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quarrymill.shared import fresh_path

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: ``[state, payload]`` of a row beside its time and order.
Held = list


def micros(t: datetime) -> int:
    t = t.astimezone(timezone.utc) if t.tzinfo else t.astimezone().astimezone(timezone.utc)
    return (t - EPOCH) // timedelta(microseconds=1)


class OrderedRule:
    """What becomes of a key's rows in order. ``memory`` is plain JSON that lasts from slot to slot."""

    output = ""

    def start(self) -> dict:
        return {}

    def row(self, key: object, at: int, order: int, state: object, payload: object, memory: dict) -> Iterator[tuple]:
        raise NotImplementedError

    def passed(self, key: object, until: int, memory: dict) -> Iterator[tuple]:
        """Time has come to ``until`` and no earlier row can come any more."""
        return iter(())

    def goes_on(self, memory: dict) -> bool:
        """Whether time is to be told on even if no rows come."""
        return False


class Ordered(StatefulProcessor):
    """Runs a rule over ``(key, ts, order, state, payload)`` rows.

    A key's first ``most`` rows wait in one value beside its memory, so that a key with few rows costs a read and a write
    a trigger, however many slots they lie in. Further rows go to a map by slot, in parts that are only ever written and
    read once. A key has one timer, for the end of its first slot.
    """

    def __init__(self, rule: OrderedRule, slot_ms: int, most: int = 1000) -> None:
        self.rule, self.slot_ms, self.most = rule, slot_ms, most

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "timer long, parts long, rows string, memory string")
        self.slots = handle.getMapState("slots", "slot long, part long", "rows string")
        self.made = Row(*[c.split()[0] for c in self.rule.output.split(", ")])

    def _held(self) -> tuple[int | None, int, list, str | None]:
        """The timer that is set, how many parts have been written, the rows beside them and the rule's memory."""
        timer, parts, rows, memory = self.held.get() or (None, 0, "[]", None)
        return timer, parts, json.loads(rows), memory

    def _by_slot(self, rows: list[Held]) -> dict[int, list[Held]]:
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r[0] // (self.slot_ms * 1000), []).append(r)
        return by

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, parts, held, memory = self._held()
        first = None
        for r in rows:
            at = micros(r["ts"])
            first = at if first is None or at < first else first
            held.append([at, r["order"], r["state"], r["payload"]])
            if len(held) > self.most:
                for slot, own in self._by_slot(held).items():
                    self.slots.updateValue((slot, parts), (json.dumps(own),))
                parts, held = parts + 1, []
        end = (first // (self.slot_ms * 1000) + 1) * self.slot_ms
        if timer is None or end < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
            timer = end
        self.held.update((timer, parts, json.dumps(held), memory))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, parts, held, told = self._held()
        memory = json.loads(told) if told else self.rule.start()
        over = timerValues.getCurrentWatermarkInMs() // self.slot_ms
        near, far = self._by_slot(held), {}
        for slot, part in self.slots.keys() if parts else ():
            far.setdefault(slot, []).append(part)
        for slot in sorted(s for s in near.keys() | far.keys() if s < over):
            own = near.pop(slot, [])
            for part in far.pop(slot, ()):
                own += json.loads(self.slots.getValue((slot, part))[0])
                self.slots.removeKey((slot, part))
            for at, order, state, payload in sorted(own, key=lambda r: (r[0], r[1])):
                yield from self._rows(self.rule.row(key[0], at, order, state, payload, memory))
        ahead = min(near.keys() | far.keys(), default=None)
        timer = None if ahead is None else (ahead + 1) * self.slot_ms
        if self.rule.goes_on(memory):
            # What is held lies ahead of the slots that the watermark has passed, and nothing earlier can come any more.
            yield from self._rows(self.rule.passed(key[0], over * self.slot_ms * 1000, memory))
            timer = timer or (over + 1) * self.slot_ms
        if timer is not None:
            self.handle.registerTimer(timer)
        self.held.update((timer, parts if far else 0, json.dumps([r for own in near.values() for r in own]), json.dumps(memory)))

    def _rows(self, found: Iterator[tuple]) -> Iterator[Row]:
        return (self.made(*x) for x in found)

    def close(self) -> None:
        pass


class Changes(OrderedRule):
    """A row where a key's state is another than before."""

    def __init__(self, key_type: str) -> None:
        self.output = f"key {key_type}, order long, state string"

    def row(self, key, at, order, state, payload, memory):
        if "last" not in memory or memory["last"] != state:
            yield key, order, state
        memory["last"] = state


class Beats(OrderedRule):
    """A row for each ``every`` microseconds without a row while a job runs: from a state of ``running`` to one that isn't.

    The count is that of the job's rows and beats so far, as a beat is a row of its log.
    """

    def __init__(self, key_type: str, running: tuple[str, ...], every: timedelta) -> None:
        self.running, self.every = running, every // timedelta(microseconds=1)
        self.output = f"key {key_type}, at timestamp, seq long, state string"

    def start(self):
        return {"n": 0, "last": None, "state": None}

    def _until(self, key, until, memory):
        if memory["state"] in self.running:
            while memory["last"] + self.every < until:
                memory["last"] += self.every
                yield key, EPOCH + timedelta(microseconds=memory["last"]), memory["n"], memory["state"]
                memory["n"] += 1

    def row(self, key, at, order, state, payload, memory):
        yield from self._until(key, at, memory)
        memory.update(last=at, state=state, n=memory["n"] + 1)

    def passed(self, key, until, memory):
        return self._until(key, until, memory)

    def goes_on(self, memory):
        return memory["state"] in self.running


class Topics(OrderedRule):
    """``job`` gets every row, ``status`` the changes of state, ``syslog`` the rows of ``system``; after a state of ``ends`` a job says ``done`` and no more."""

    def __init__(self, key_type: str, system: tuple[str, ...], ends: tuple[str, ...]) -> None:
        self.system, self.ends = system, ends
        self.output = f"topic string, key {key_type}, order long, message string"

    def row(self, key, at, order, state, payload, memory):
        if memory.get("done"):
            return
        yield "job", key, order, payload
        if state in self.system:
            yield "syslog", key, order, payload
        if memory.get("last") != state:
            yield "status", key, order, state
        memory["last"] = state
        if state in self.ends:
            memory["done"] = True
            yield "job", key, order, "done"


class Merged(OrderedRule):
    """The merged state after every row: how many were appended, and each field's last value."""

    def __init__(self, key_type: str) -> None:
        self.output = f"key {key_type}, order long, appended long, fields map<string,string>"

    def row(self, key, at, order, state, payload, memory):
        memory["n"] = memory.get("n", 0) + 1
        memory.setdefault("fields", {})[state] = payload
        yield key, order, memory["n"], dict(memory["fields"])


def in_order(events: DataFrame, rule: OrderedRule, late: str = "1 hour", slot: timedelta = timedelta(hours=1)) -> DataFrame:
    """``events`` (key, ts, order, state, payload) through a rule; append mode."""
    slot_ms = slot // timedelta(milliseconds=1)
    return events.withWatermark("ts", late).groupBy("key").transformWithState(Ordered(rule, slot_ms), rule.output, "Append", "EventTime")


def with_end(events: DataFrame, ts: str = "ts") -> tuple[DataFrame, Callable[[datetime], None]]:
    """``events`` and a function that ends them: a row far enough ahead for the watermark to pass all that is held.

    The row has nothing but its time; it comes from a folder of its own beside the events'.
    """
    spark, path = events.sparkSession, fresh_path(events.sparkSession, "control")
    spark.createDataFrame([], events.schema).write.parquet(path)
    control = spark.readStream.schema(events.schema).parquet(path)

    def end(at: datetime) -> None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts else F.lit(at).cast(f.dataType).alias(ts) for f in events.schema]
        spark.range(1).select(*blank).coalesce(1).write.mode("append").parquet(path)

    return events.unionByName(control), end
