"""Life-cycle streams: state machines, idempotent payments, expiries, audit log.

Events may arrive in any order and in any number of files. Each micro-batch is held
back until no event within the stated delay can still precede it, and is then applied
in event order; see ``OrderedRun``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.operators.scale import fold_states
from rillwork.session import work_folder

Step = Callable[[DataFrame, "DataFrame | None", int], tuple[DataFrame, DataFrame]]
"""``(ready events, state or None, applied up to)`` to ``(output, changed state)``, both with ``key``."""


class OrderedRun:
    """foreachBatch writer that applies events in event order across micro-batches.

    Events (``key, ts, ..``) wait until the newest event time seen, less ``delay``, passes
    them. Later ones are put out with outcome ``late``, and those without key or time
    with outcome ``invalid``; no row is lost. All tables are kept by batch below ``base``
    and a batch only reads earlier ones, so a replayed batch replaces its own output.
    State is written for changed keys and gathered into one table every ``gather`` batches.
    """

    def __init__(self, spark: SparkSession, base: str, step: Step, delay: str, gather: int = 16):
        self.spark, self.base, self.step, self.delay, self.gather = spark, base, step, delay, gather
        self._last = -1

    def _table(self, name: str, version: int) -> str:
        return f"{self.base}/{name}/{version}"

    def _clock(self, version: int) -> tuple[int | None, int | None]:
        if version < 0:
            return None, None
        row = self.spark.read.parquet(self._table("clock", version)).first()
        return row["newest"], row["upto"]

    def _state(self, version: int) -> DataFrame | None:
        """State after ``version``: the last entry of each key since states were last gathered."""
        if version < 0:
            return None
        first = version - version % self.gather
        parts = [self.spark.read.parquet(self._table("state", v)).withColumn("_v", F.lit(v)) for v in range(first, version + 1)]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        rest = [c for c in every.columns if c not in ("key", "_v")]
        return every.groupBy("key").agg(F.max_by(F.struct(*rest), "_v").alias("s")).select("key", "s.*")

    def __call__(self, batch: DataFrame, version: int) -> None:
        batch = batch.persist()
        newest, upto = self._clock(version - 1)
        seen = batch.agg(F.unix_micros(F.max("ts")).alias("newest"), F.unix_micros(F.max("ts") - F.expr(f"INTERVAL {self.delay}")).alias("upto")).first()
        now = max((x for x in (newest, seen["newest"]) if x is not None), default=None)
        passed = max((x for x in (upto, seen["upto"]) if x is not None), default=None)
        at = F.unix_micros("ts")
        sound = F.col("key").isNotNull() & F.col("ts").isNotNull()
        behind = F.lit(False) if upto is None else at <= upto
        refused = batch.where(~sound).withColumn("outcome", F.lit("invalid")).unionByName(
            batch.where(sound & behind).withColumn("outcome", F.lit("late")))
        self._advance(batch.where(sound & ~behind), refused, version, now, passed)
        batch.unpersist()

    def close(self) -> None:
        """Apply what still waits, up to the newest event time seen."""
        version = self._last + 1
        if version:
            newest, _ = self._clock(version - 1)
            held = self.spark.read.parquet(self._table("waiting", version - 1))
            self._advance(held.limit(0), held.limit(0).withColumn("outcome", F.lit("late")), version, newest, newest)

    def _advance(self, fresh: DataFrame, refused: DataFrame, version: int, newest: int | None, upto: int | None) -> None:
        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(self._table(name, version))

        held = fresh if version == 0 else fresh.unionByName(self.spark.read.parquet(self._table("waiting", version - 1)))
        ready = F.lit(False) if upto is None else F.unix_micros("ts") <= upto
        put(held.where(ready), "ready")
        put(held.where(~ready), "waiting")
        state = self._state(version - 1)
        out, changed = self.step(self.spark.read.parquet(self._table("ready", version)), state, upto or 0)
        put(out.unionByName(refused, allowMissingColumns=True).select(*out.columns), "out")
        if state is not None and version % self.gather == 0:
            changed = changed.unionByName(state.join(changed.select("key"), "key", "left_anti"))
        put(changed, "state")
        clock = self.spark.range(1).select(F.lit(newest).cast("long").alias("newest"), F.lit(upto).cast("long").alias("upto"))
        put(clock, "clock")
        self._last = version

    def output(self) -> DataFrame | None:
        """Everything put out so far, or None before the first batch."""
        if self._last < 0:
            return None
        return self.spark.read.parquet(*[self._table("out", v) for v in range(self._last + 1)])


def drained_in_order(stream: DataFrame, step: Step, delay: str) -> DataFrame:
    """Run a stream over everything available, apply what waits, and return the output."""
    spark = stream.sparkSession
    run = OrderedRun(spark, f"{work_folder(spark)}/ordered-{uuid.uuid4().hex}", step, delay)
    (stream.writeStream.option("checkpointLocation", f"{run.base}/checkpoint")
     .trigger(availableNow=True).foreachBatch(run).start().awaitTermination())
    run.close()
    out = run.output()
    return out if out is not None else step(spark.createDataFrame([], stream.schema), None, 0)[0]


def machine_step(states: Sequence[str], allowed: dict[str, frozenset[str]], start: str) -> Step:
    """Events ``(key, event_id, ts, target)``: a move not listed for the current status is
    refused and leaves the status alone. Events of a key are taken by time, then id, and a
    repeated id of one step counts once. Busy keys are folded in bounded chunks."""
    def step(ready: DataFrame, state: DataFrame | None, upto: int) -> tuple[DataFrame, DataFrame]:
        once = ready.groupBy("key", "event_id").agg(F.min(F.struct("ts", "target")).alias("e")).select("key", "event_id", "e.*")
        entries = None if state is None else state.join(ready.select("key").distinct(), "key", "left_semi")
        out = fold_states(once, "key", ["ts", "event_id"], "target", states, allowed, start, entries=entries)
        last = out.groupBy("key").agg(F.max_by("state_after", F.struct("ts", "event_id")).alias("state"))
        return out.withColumn("outcome", F.when(F.col("accepted"), "applied").otherwise("refused")), last

    return step


def run_machine(events: DataFrame, states: Sequence[str], allowed: dict[str, frozenset[str]], start: str, delay: str) -> DataFrame:
    """One row per event with the state before and after it, ``accepted`` and ``outcome``."""
    out = drained_in_order(events, machine_step(states, allowed, start), delay)
    return out.withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def run_payments(notices: DataFrame, states: Sequence[str], allowed: dict[str, frozenset[str]], delay: str,
                 start: str = "payment_pending") -> DataFrame:
    """Payment notices: repeats are no-ops and only a pending request becomes paid.

    Spark drops a notice whose id it has seen within ``delay``, in this trigger or an earlier one.
    """
    return run_machine(once_each(notices, delay), states, allowed, start, delay)


def once_each(notices: DataFrame, delay: str) -> DataFrame:
    """A stream without the repeats of an ``event_id`` that come within ``delay`` of the first."""
    return notices.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def expiry_step(ready: DataFrame, state: DataFrame | None, upto: int) -> tuple[DataFrame, DataFrame]:
    """``(key, ts, kind, expires_at)`` with kind granted or revoked to ``(key, at, access, outcome)``.

    A revocation ends access at its own time, also when it falls on the end of the grant.
    A grant ends at its end unless another event of the key comes first; a new grant
    replaces the one before it.
    """
    rows = ready.select("key", "ts", "kind", "expires_at", F.lit(True).alias("fresh"))
    if state is not None:
        rows = rows.unionByName(state.where("expires_at IS NOT NULL").select(
            "key", "ts", F.lit("granted").alias("kind"), "expires_at", F.lit(False).alias("fresh")))
    following = F.lead("ts").over(Window.partitionBy("key").orderBy("ts", "fresh", "kind"))
    rows = rows.withColumn("next", following)
    end: Column = F.col("expires_at")
    ended = (F.col("kind") == "granted") & F.coalesce(F.when(F.col("next").isNotNull(), end < F.col("next")).otherwise(
        F.unix_micros(end) <= upto), F.lit(False))
    gone = F.when(F.col("kind") == "revoked", "revoked").when(ended, "expired")
    marked = rows.withColumn("access", gone)
    out = marked.where("access IS NOT NULL").select(
        "key", F.when(F.col("access") == "revoked", F.col("ts")).otherwise(end).alias("at"), "access", F.lit("applied").alias("outcome"), "ts", "kind")
    kept = F.when(F.col("access").isNull(), end)
    changed = marked.where(F.col("next").isNull() & (F.col("fresh") | F.col("access").isNotNull())).select("key", "ts", kept.alias("expires_at"))
    return out, changed


def run_expiry(changes: DataFrame, delay: str) -> DataFrame:
    """``key, at, access, outcome, ts, kind``: endings up to the newest event time, and late rows by outcome."""
    return drained_in_order(changes, expiry_step, delay)


def audit_sink(facts_path: str, events_path: str, entity: str, names: tuple[str, ...]):
    """foreachBatch writer: the facts of a batch and one audit event per fact.

    Rows with an event name outside the closed set stop the batch before anything is
    written. Both tables are partitioned by batch and a replayed batch overwrites its
    own partition, so a retry adds nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        bad = batch.where(~F.col("event_name").isin(*names)).limit(1).collect()
        if bad:
            raise ValueError(f"unknown event {bad[0]['event_name']!r}")
        audit = batch.select(F.lit(entity).alias("entity_type"), F.col("key").alias("entity_id"), F.col("ts").alias("occurred_at"), "event_name")
        batch.write.mode("overwrite").parquet(f"{facts_path}/batch={batch_id}")
        audit.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
        batch.unpersist()
    return write
