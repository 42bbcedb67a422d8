"""Deliveries of one outcome: which attempt may be stored, and why the others may not."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import as_frame, event_columns, in_order

HOUR_MS = 3_600_000
# Outcomes of one hour's deadlines are dealt over so many groups, and a group's state over so many entries; fixed, as a running stream keeps its state by them.
GROUPS = 256
SLOTS = 16
# Fixed value: an outcome is sent so many times at most.
MOST_ATTEMPTS = 3
JUDGED = "outcome_key STRING, event_id BIGINT, attempt INT, reason STRING"
JUDGED_COLUMNS = [c.split()[0] for c in JUDGED.split(", ")]


class OutcomeAttempts(StatefulProcessor):
    """State of a group of outcomes whose deadlines lie in one hour: per outcome the digest of the bytes first sent and the attempts so far, until that hour has passed.

    An attempt past the deadline needs no state to be refused, so the state may go then. A group has one timer and is cleared at once; an entry of its state
    holds the outcomes of one slot, and a batch reads and writes the slots it touches once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getMapState("sent", "slot BIGINT", "outcomes STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = in_order(rows, "outcome_key", "slot", "late", "digest", "refused")
        if not batch:
            return
        known = self.sent.exists()
        slots, out = {}, []
        for _, event_id, outcome_key, slot, late, digest, refused in batch:
            if late:
                out.append((outcome_key, event_id, None, "sent after the deadline"))
                continue
            if slot not in slots:
                stored = self.sent.getValue((slot,)) if known else None
                slots[slot] = json.loads(stored[0]) if stored else {}
            sent, attempts = slots[slot].get(outcome_key) or (digest, 0)
            attempts += 1
            slots[slot][outcome_key] = (sent, attempts)
            if attempts > MOST_ATTEMPTS:
                reason = f"attempt {attempts} of {MOST_ATTEMPTS}"
            else:
                reason = "other bytes than first sent" if digest != sent else refused
            out.append((outcome_key, event_id, attempts, reason))
        for slot, outcomes in slots.items():
            self.sent.updateValue((slot,), (json.dumps(outcomes),))
        if slots and not known:
            self.handle.registerTimer((int(key[0]) + 1) * HOUR_MS)
        yield as_frame(out, JUDGED_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sent.clear()
        return iter(())

    def close(self) -> None:
        pass


def judged_attempts(attempts: DataFrame, delay: str) -> DataFrame:
    """``outcome_key, event_id, attempt, reason`` for every delivery; a null reason means that it may be stored.

    attempts: outcome_key, ts, event_id, body, status, deadline. Refused are, in this order: what is sent at or after the deadline, a fourth attempt, bytes other than those
    first sent, an answer that is not a success. A null status is a lost answer, after which the same bytes may be sent again. All attempts of an outcome have
    one deadline; its state is kept until the hour of the deadline is over.
    """
    status = F.col("status")
    keyed = attempts.withWatermark("ts", delay).select(
        F.expr(f"unix_millis(deadline) div {HOUR_MS}").alias("deadline_hour"), F.expr(f"pmod(xxhash64(outcome_key), {GROUPS})").alias("share"),
        F.expr(f"pmod(xxhash64(outcome_key) div {GROUPS}, {SLOTS})").alias("slot"), "outcome_key", *event_columns(),
        F.sha1(F.coalesce(F.col("body"), F.lit(""))).alias("digest"), (F.col("ts") >= F.col("deadline")).alias("late"),
        F.when(~status.between(200, 299), F.concat(F.lit("answered "), status.cast("string"))).alias("refused"),
    )
    return keyed.groupBy("deadline_hour", "share").transformWithStateInPandas(
        statefulProcessor=OutcomeAttempts(), outputStructType=JUDGED, outputMode="Append", timeMode="EventTime"
    )
