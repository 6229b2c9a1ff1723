"""State over rows in order: one answer for any split into files and any order of the files."""

import random
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest

from quarrymill.streaming import feeds
from quarrymill.streaming.ordered import Beats, Changes, Merged, Ordered, Topics, in_order, with_end

BEGIN = datetime(2024, 5, 1)
SCHEMA = "id long, ts timestamp, k long, s string, p string"


def _rows():
    rng = random.Random(4)
    return [(i, BEGIN + timedelta(minutes=7 * i), rng.choice([1, 1, 1, 2, None]), rng.choice("aabx"), f"p{i}") for i in range(60)]


def _through(spark, path, rows, files, rule, slot, late="10 days", per_trigger=1):
    """The rows of a rule, with the input dealt out over files at random and read a file a trigger."""
    rng = random.Random(files)
    parts = [rng.randrange(files) for _ in rows]
    for part in rng.sample(range(files), files):
        own = [r for r, p in zip(rows, parts) if p == part]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream, end = with_end(feeds.read_stream(spark, path, files_per_trigger=per_trigger))
    held = in_order(feeds.keyed(stream, "k", "id", "s", "p"), rule, late, slot)
    return feeds.drain(held, end=lambda: end(BEGIN + timedelta(days=12, seconds=1))).collect()


def _per_key(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    return by


@pytest.mark.parametrize("files, slot", [(1, timedelta(hours=1)), (3, timedelta(minutes=30)), (5, timedelta(days=1))])
def test_changes(spark, tmp_path, files, slot):
    rows = _rows()
    got = _through(spark, str(tmp_path / "in"), rows, files, Changes("bigint"), slot)
    want = {(k, r[0], r[3]) for k, own in _per_key(rows).items() for b, r in zip([None, *own], own) if b is None or b[3] != r[3]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_topics_end_with_the_last_state(spark, tmp_path):
    rows = _rows()
    got = _through(spark, str(tmp_path / "in"), rows, 3, Topics("bigint", ("b",), ("x",)), timedelta(hours=2))
    want = []
    for k, own in _per_key(rows).items():
        last = None
        for r in own:
            want += [("job", k, r[0], r[4])] + [("syslog", k, r[0], r[4])] * (r[3] == "b") + [("status", k, r[0], r[3])] * (r[3] != last)
            last = r[3]
            if r[3] == "x":
                want.append(("job", k, r[0], "done"))
                break
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_merged_state(spark, tmp_path):
    rows = _rows()
    got = {(r.key, r.order): (r.appended, r.fields) for r in _through(spark, str(tmp_path / "in"), rows, 4, Merged("bigint"), timedelta(hours=5))}
    for k, own in _per_key(rows).items():
        fields = {}
        for n, r in enumerate(own, 1):
            fields[r[3]] = r[4]
            assert got[k, r[0]] == (n, fields)
    assert len(got) == len(rows)


def test_beats_fill_silence_until_the_end(spark, tmp_path):
    hours = [(0, "run"), (5, "run"), (6, "stop"), (30, "run")]
    rows = [(i, BEGIN + timedelta(hours=h, minutes=1), 7, s, None) for i, (h, s) in enumerate(hours)]
    got = _through(spark, str(tmp_path / "in"), rows, 2, Beats("bigint", ("run",), timedelta(hours=2)), timedelta(hours=4))
    at = sorted((r.at, r.seq) for r in got)
    want, seq = [], 0
    for (h, s), until in zip(hours, [5 + 1 / 60, 6 + 1 / 60, 30 + 1 / 60, 48]):
        seq += 1
        t = h + 1 / 60 + 2
        while s == "run" and t < until - 1e-9:
            want.append((BEGIN + timedelta(hours=round(t - 1 / 60), minutes=1), seq))
            seq, t = seq + 1, t + 2
    assert at == want and {r.state for r in got} == {"run"}


def test_late_rows_are_dropped_and_the_rest_is_in_order(spark, tmp_path):
    path = str(tmp_path / "in")
    for own in ([(1, BEGIN, 1, "a", None)], [(2, BEGIN + timedelta(days=3), 1, "b", None)], [(3, BEGIN + timedelta(days=5), 1, "b", None)]):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream, end = with_end(feeds.read_stream(spark, path, files_per_trigger=1))
    got = feeds.drain(feeds.state_changes(stream, "k", "s", "id", late="1 day", slot=timedelta(hours=1)), end=lambda: end(BEGIN + timedelta(days=30)))
    assert sorted((r.id, r.s) for r in got.collect()) == [(1, "a"), (2, "b")]


def test_nothing_in_nothing_out(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    stream, end = with_end(feeds.read_stream(spark, path))
    assert feeds.drain(feeds.state_changes(stream, "k", "s", "id"), end=lambda: end(BEGIN)).collect() == []


class _Handle:
    """One key's state in memory; counts the calls, each of which goes to Spark and back."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def _did(self, x=None):
        self.calls += 1
        return x

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self._did(self.value), exists=lambda: self._did(self.value is not None), update=lambda v: self._did(setattr(self, "value", v)))

    def getMapState(self, *_):
        return SimpleNamespace(
            keys=lambda: self._did(list(self.map)), containsKey=lambda k: self._did(k in self.map), getValue=lambda k: self._did(self.map.get(k)),
            updateValue=lambda k, v: self._did(self.map.update({k: v})), removeKey=lambda k: self._did(self.map.pop(k)),
        )

    def registerTimer(self, t):
        self._did(self.timers.add(t))

    def deleteTimer(self, t):
        self._did(self.timers.remove(t))

    def fire(self, processor, until):
        out = []
        while due := sorted(t for t in self.timers if t < until):
            at = SimpleNamespace(getCurrentWatermarkInMs=lambda: until), SimpleNamespace(getExpiryTimeInMs=lambda: due[0])
            out += [tuple(r) for r in processor.handleExpiredTimer((7,), *at)]
            self.timers.remove(due[0])
        return out


def _fed(rule, rows, triggers, **held):
    handle, processor = _Handle(), Ordered(rule, 86_400_000, **held)
    processor.init(handle)
    for n in range(triggers):
        list(processor.handleInputRows((7,), iter(rows[n::triggers]), None))
    return handle, processor


def _scattered(n):
    rows = [{"ts": BEGIN.replace(tzinfo=timezone.utc) + timedelta(hours=11 * i), "order": i, "state": "ab"[i % 3 == 0], "payload": None} for i in range(n)]
    random.Random(5).shuffle(rows)
    return rows


def test_a_key_with_few_rows_costs_few_calls():
    handle, processor = _fed(Changes("bigint"), _scattered(60), 2)
    out = handle.fire(processor, 1_800_000_000_000)
    assert [r[1] for r in out] == [i for i in range(60) if i % 3 < 2]
    assert handle.calls <= 10  # the 60 rows lie in 28 slots


@pytest.mark.parametrize("most", [1, 3, 7, 1000])
def test_rows_beyond_the_first_wait_by_slot(most):
    handle, processor = _fed(Merged("bigint"), _scattered(50), 4, most=most)
    assert bool(handle.map) == (most < 50)
    begin = int(BEGIN.replace(tzinfo=timezone.utc).timestamp() * 1000)
    early = handle.fire(processor, begin + 10 * 86_400_000 + 1)
    assert [r[1] for r in early] == list(range(22))  # 240 hours
    assert len(handle.timers) == 1
    assert [r[1:3] for r in early + handle.fire(processor, 1_800_000_000_000)] == [(i, i + 1) for i in range(50)]
    assert handle.map == {} and handle.timers == set()
