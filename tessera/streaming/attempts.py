"""Attempts at labelling as a stream with keyed state: retries, backoff, budgets and one final row for each call.

Outcomes of one unit arrive in any order within the watermark's delay; they wait in the state until the watermark passes
them and are then taken in the order of their time.  A timer closes a call whose next attempt never comes.  The state's keys are
buckets of units, so that one read, write and timer serves many units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

SUCCESS, INVALID, TRANSIENT, PERMANENT, FATAL, STOPPED = "success", "validation_failed", "transient_failed", "permanent_failed", "fatal", "stopped"

#: Row of the log: one for every attempt whose response was not valid, and a ``final`` one for every call.
LOG = "unit string, status string, attempt int, final boolean, invalid int, waited long, spent double, ms long, seq long"
#: Buckets of units; a bucket is one key of the state, which costs by its calls more than by its bytes.  A checkpoint holds units
#: by their bucket, so the number must stay.
BUCKETS = 8192
#: A bucket's units with a past, and its outcomes that the watermark has not passed, as columns.
_KINDS = {"unit": StringType(), "outcome": StringType(), "status": StringType(), "spent": DoubleType(), "cost": DoubleType(), "done": BooleanType()}
_CALLS, _WAITING = (
    StructType([StructField(n, ArrayType(_KINDS.get(n, LongType()))) for n in names])
    for names in (("unit", "attempt", "status", "invalid", "waited", "spent", "ms", "seq", "done"), ("unit", "ms", "seq", "outcome", "cost"))
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Policy:
    """Retries after the first attempt, seconds of backoff (times the attempt's number), cost that a unit may spend and that a
    call may take at most, and milliseconds after which a call without a further attempt is over."""

    retries: int = 2
    wait: int = 2
    budget: float = float("inf")
    ceiling: float = 0.0
    idle: int = 3_600_000


@dataclass(frozen=True)
class Call:
    """A unit's open call, if ``attempt`` is above 0; ``done`` units take no more attempts."""

    attempt: int = 0
    status: str = ""
    invalid: int = 0
    waited: int = 0
    spent: float = 0.0
    ms: int = 0
    seq: int = 0
    done: bool = False


_NEW = Call()
_ROW = Row("unit", "status", "attempt", "final", "invalid", "waited", "spent", "ms", "seq")


def final(call: Call) -> tuple[Call, tuple]:
    """The call's last row, and the unit without an open call."""
    row = (call.status, call.attempt, True, call.invalid, call.waited, call.spent, call.ms, call.seq)
    return Call(spent=call.spent, done=call.done), row


def take(call: Call, ms: int, seq: int, outcome: str, cost: float, policy: Policy) -> tuple[Call, list[tuple]]:
    """What an outcome makes of the call, and the rows that it adds to the log."""
    rows = []
    if call.done:
        return call, rows  # a success is used again, a stopped unit stays so
    if call.attempt and ms - call.ms > policy.idle:
        call, row = final(call)
        rows.append(row)
    if call.spent + policy.ceiling > policy.budget:
        call, row = final(replace(call, status=STOPPED, ms=ms, seq=seq, done=True))
        return call, [*rows, row]
    call = replace(call, attempt=call.attempt + 1, status=outcome, ms=ms, seq=seq, spent=call.spent + (0.0 if outcome == TRANSIENT else cost))
    if outcome == INVALID:
        call = replace(call, invalid=call.invalid + 1)
        rows.append((INVALID, call.attempt, False, call.invalid, call.waited, call.spent, ms, seq))
    elif outcome == TRANSIENT:
        call = replace(call, waited=call.waited + policy.wait * call.attempt)
    if outcome in (SUCCESS, FATAL, PERMANENT) or call.attempt > policy.retries:
        call, row = final(replace(call, done=outcome in (SUCCESS, FATAL)))
        rows.append(row)
    return call, rows


def _columns(rows: list[tuple], schema: StructType) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows))) if rows else tuple([] for _ in schema)


class AttemptLog(StatefulProcessor):
    """State of a bucket of units: the past of each, and the outcomes that the watermark has not passed."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getValueState("calls", _CALLS)
        self.waiting = handle.getValueState("waiting", _WAITING)

    def _past(self) -> dict[str, Call]:
        found = self.calls.get()
        return {unit: Call(*rest) for unit, *rest in zip(*found)} if found else {}

    def _proceed(self, new: list[tuple], until: int) -> Iterator[Row]:
        kept = self.waiting.get()
        held = (list(zip(*kept)) if kept else []) + new
        due = sorted((w for w in held if w[1] <= until), key=itemgetter(1, 2, 3, 4))
        rest = [w for w in held if w[1] > until]
        rows: list[tuple] = []
        calls = self._past()
        for unit, ms, seq, outcome, cost in due:
            calls[unit], more = take(calls.get(unit, _NEW), ms, seq, outcome, cost, self.policy)
            rows += ((unit, *r) for r in more)
        over = [u for u, c in calls.items() if c.attempt and c.ms + self.policy.idle <= until]
        for unit in over:
            calls[unit], row = final(calls[unit])
            rows.append((unit, *row))
        if due or over:
            self.calls.update(_columns([(u, *astuple(c)) for u, c in calls.items()], _CALLS))
        if new or due:
            self.waiting.update(_columns(rest, _WAITING))
        wake = min([w[1] for w in rest] + [c.ms + self.policy.idle for c in calls.values() if c.attempt], default=None)
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer != wake:
                self.handle.deleteTimer(timer)
        if wake is not None and wake not in timers:
            self.handle.registerTimer(wake)
        for r in rows:
            yield _ROW(*r)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["unit"], r["ms"], r["seq"], r["outcome"], r["cost"]) for r in rows]
        yield from self._proceed(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._proceed([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def run_attempts(spark: SparkSession, path: str, schema: StructType, table: str, checkpoint: str, policy: Policy, delay: str = "10 minutes", files_per_trigger: int = 100) -> DataFrame:
    """Take what is new in the folder of outcomes (unit, ts, seq, outcome, cost) and return the log (:data:`LOG`).

    Each micro-batch writes its rows to a folder of its own number, so a replay replaces them; the checkpoint resumes the state.
    Outcomes without a unit or time take no part; a null cost is 0.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    rows = rows.filter("unit IS NOT NULL AND ts IS NOT NULL").withColumns({"ms": F.expr("unix_millis(ts)"), "cost": F.coalesce(F.col("cost").cast("double"), F.lit(0.0))})
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(BUCKETS)).cast("int"))
    log = rows.withWatermark("ts", delay).groupBy("bucket").transformWithState(AttemptLog(policy), LOG, "Append", "EventTime")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the query copies the session's settings when it starts
        query = log.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(f"{LOG}, batch int").parquet(table).drop("batch")
