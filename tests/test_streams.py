"""Keyed state, upserts and snapshots: restarts, replays, races and pinned readers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.snapshots import Conflict, KeyedTable, Manifests, SnapshotTable
from tessera.streaming import attempts as A
from tessera.streaming import feedback

OUTCOMES = "unit string, ts timestamp, seq long, outcome string, cost double"
START = datetime.datetime(2024, 1, 1)


def outcomes(n=400, units=12, seed=3):
    rng = random.Random(seed)
    kinds = [A.SUCCESS, A.INVALID, A.INVALID, A.TRANSIENT, A.TRANSIENT, A.PERMANENT]
    out, at = [], START
    for i in range(n):
        at += datetime.timedelta(seconds=rng.choice([1, 30, 200, 900]))
        out.append((f"u{rng.randrange(units)}/{at:%d%H}", at, i, rng.choice(kinds), float(rng.randrange(50))))
    return out


def plain_log(rows, policy, delay_ms):
    """The reference's loop over each unit's attempts in order of time."""
    until = max(ms(r[1]) for r in rows) - delay_ms
    log = []
    for unit in {r[0] for r in rows}:
        attempt = invalid = waited = 0
        spent, last, status, done = 0.0, None, "", False
        for r in sorted((r for r in rows if r[0] == unit and ms(r[1]) <= until), key=lambda r: (r[1], r[2])):
            if done:
                continue
            if attempt and ms(r[1]) - last[0] > policy.idle:
                log.append((unit, status, attempt, True, invalid, waited, spent, *last))
                attempt = invalid = waited = 0
            last = ms(r[1]), r[2]
            if spent + policy.ceiling > policy.budget:
                log.append((unit, A.STOPPED, attempt, True, invalid, waited, spent, *last))
                done, attempt = True, 0
                continue
            attempt += 1
            status = r[3]
            spent += 0 if status == A.TRANSIENT else r[4]
            waited += policy.wait * attempt if status == A.TRANSIENT else 0
            if status == A.INVALID:
                invalid += 1
                log.append((unit, status, attempt, False, invalid, waited, spent, *last))
            if status in (A.SUCCESS, A.PERMANENT, A.FATAL) or attempt > policy.retries:
                log.append((unit, status, attempt, True, invalid, waited, spent, *last))
                done = status in (A.SUCCESS, A.FATAL)
                attempt = invalid = waited = 0
        if attempt and last[0] + policy.idle <= until:
            log.append((unit, status, attempt, True, invalid, waited, spent, *last))
    return sorted(log)


def ms(at):
    return int(at.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


def test_attempts_over_restarts(spark, tmp_path):
    """Three runs on one checkpoint, with the state kept between them, give the log of one run and of a plain loop."""
    rows, policy = outcomes(), A.Policy(retries=2, wait=2, budget=60.0, ceiling=30.0, idle=1_200_000)
    schema = T.StructType.fromDDL(OUTCOMES)
    logs = []
    for name, cuts in (("one", [0, 400]), ("three", [0, 150, 151, 400])):
        for a, b in zip(cuts, cuts[1:]):
            shuffled = random.Random(a).sample(rows[a:b], b - a)
            spark.createDataFrame(shuffled, OUTCOMES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            log = A.run_attempts(spark, f"{tmp_path}/{name}/in", schema, f"{tmp_path}/{name}/log", f"{tmp_path}/{name}/checkpoint", policy)
        logs.append(sorted(map(tuple, log.collect())))
    want = plain_log(rows, policy, 600_000)
    assert logs[0] == want
    assert logs[1] == want
    assert {r[1] for r in want if r[3]} >= {A.SUCCESS, A.PERMANENT, A.STOPPED, A.INVALID, A.TRANSIENT}


def test_attempts_without_rows_and_with_nulls(spark, tmp_path):
    rows = [(None, START, 1, A.SUCCESS, 1.0), ("u", None, 2, A.SUCCESS, 1.0), ("u", START, 3, A.FATAL, None), ("u", START, 4, A.SUCCESS, 1.0), ("v", START + datetime.timedelta(days=1), 5, A.SUCCESS, 1.0)]
    spark.createDataFrame(rows, OUTCOMES).write.parquet(f"{tmp_path}/in")
    log = A.run_attempts(spark, f"{tmp_path}/in", T.StructType.fromDDL(OUTCOMES), f"{tmp_path}/log", f"{tmp_path}/checkpoint", A.Policy())
    assert [(r["unit"], r["status"], r["attempt"], r["spent"]) for r in log.collect()] == [("u", A.FATAL, 1, 0.0)]


def test_counters_rewrite_only_touched_buckets(spark, tmp_path):
    rng = random.Random(1)
    events = "query string, keyword string, liked int, chosen int"
    rows = [(" ".join(f"w{rng.randrange(40)}" for _ in range(3)), f"k{rng.randrange(4)}", rng.randrange(2), rng.randrange(2)) for _ in range(120)]
    batches = [rows[:100], [("only these", "k1", 1, 0)], rows[100:]]
    per_batch = []
    for batch in batches:
        spark.createDataFrame(batch, events).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found, touched = feedback.run_stream(spark, f"{tmp_path}/in", T.StructType.fromDDL(events), f"{tmp_path}/counts", f"{tmp_path}/checkpoint", buckets=16)
        per_batch += touched
    want = feedback.token_counts(spark.createDataFrame([r for b in batches for r in b], events))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert len(per_batch) == 3 and len(per_batch[0]) == 16 and 1 <= len(per_batch[1]) <= 2  # two counters changed
    again, touched = feedback.run_stream(spark, f"{tmp_path}/in", T.StructType.fromDDL(events), f"{tmp_path}/counts", f"{tmp_path}/checkpoint", buckets=16)
    assert touched == [] and again.count() == want.count()


def test_upserts_replays_and_removal(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", T.StructType.fromDDL("k string, v long"), ["k"], buckets=4)
    assert table.read().count() == 0
    make = lambda rows: spark.createDataFrame(rows, "k string, v long")
    table.upsert(make([(f"a{i}", i) for i in range(20)] + [(None, 7)]), 0)
    assert table.upsert(make([("a3", 300), ("new", 1), (None, 8)]), 1)
    assert table.upsert(make([("a3", -1)]), 1) == []  # a replay
    assert table.upsert(make([]), 2) == []
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert got == {**{f"a{i}": i for i in range(20)}, "a3": 300, "new": 1, None: 8}
    table.expire()
    assert {r["k"]: r["v"] for r in table.read().collect()} == got and table.manifests.versions() == [3]


def test_readers_stay_on_their_version(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/s")
    with pytest.raises(KeyError):
        table.open()
    assert table.write(spark.range(5)) == 1
    with table.open() as old:
        assert table.write(spark.range(9), expected=1, model="new") == 2
        with pytest.raises(Conflict):
            table.write(spark.range(3), expected=1)
        assert table.expire() == []  # version 1 is read
        with table.open() as new:
            assert (old.df.count(), new.df.count(), new.version) == (5, 9, 2)
    assert table.expire() == [1] and table.manifests.versions() == [2]
    with pytest.raises(KeyError):
        table.open(1)
    with table.open() as left:
        assert left.df.agg(F.max("id")).first()[0] == 8 and table.manifests.value(2)["notes"] == {"model": "new"}
    assert len(list((tmp_path / "s" / "data").iterdir())) == 1  # the beaten writer left nothing


def test_of_two_writers_one_is_beaten(spark, tmp_path):
    a, b = Manifests(spark, f"{tmp_path}/m"), Manifests(spark, f"{tmp_path}/m")
    assert a.commit(0, {"by": "a"}) == 1
    b.current = lambda: 0  # it looked before the other swapped
    with pytest.raises(Conflict):
        b.commit(0, {"by": "b"})
    assert a.value(1) == {"by": "a"} and a.versions() == [1]


def test_an_outcome_at_the_watermark_is_taken(spark, tmp_path):
    rows = [("u", START, 1, A.FATAL, 1.0), ("v", START + datetime.timedelta(minutes=10), 2, A.SUCCESS, 1.0)]
    spark.createDataFrame(rows, OUTCOMES).write.parquet(f"{tmp_path}/in")
    log = A.run_attempts(spark, f"{tmp_path}/in", T.StructType.fromDDL(OUTCOMES), f"{tmp_path}/log", f"{tmp_path}/checkpoint", A.Policy())
    assert [(r["unit"], r["status"]) for r in log.collect()] == [("u", A.FATAL)]


class Kept:
    """A value state, or a handle's timers, that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.n = None, [], 0

    def getValueState(self, *_):
        self.states = [*getattr(self, "states", []), Kept()]
        return self.states[-1]

    getListState = getValueState

    def get(self):
        self.n += 1
        return self.value

    def exists(self):
        self.n += 1
        return self.value is not None

    def update(self, value):
        self.n, self.value = self.n + 1, value

    def listTimers(self):
        self.n += 1
        return list(self.timers)

    def registerTimer(self, at):
        self.n += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_calls_of_a_bucket_do_not_grow_with_its_units():
    calls = []
    for units in (10, 1000):
        log, handle = A.AttemptLog(A.Policy()), Kept()
        log.init(handle)
        rows = [{"unit": f"u{i}", "ms": 5 + i % 7, "seq": i, "outcome": A.PERMANENT, "cost": 0.1} for i in range(units)]
        assert not list(log.handleInputRows((3,), iter(rows), At(0)))
        assert handle.timers == [5]
        found = list(log.handleExpiredTimer((3,), At(8), None))
        assert sorted(r["unit"] for r in found) == sorted(r["unit"] for r in rows if r["ms"] <= 8)
        calls.append(handle.n + sum(s.n for s in handle.states))
    assert calls[0] == calls[1]
