"""Following model calls as their attempts arrive, and saying when to try again."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papersieve import fixed_values as fv
from papersieve.operators.inference import attempt_kind
from papersieve.streaming.changes import newest, read_changes, write_changes

OUTCOME = "doc_id bigint, outcome string, n_attempts int, status_code int, error_kind string, body string"
CHANGE = f"{OUTCOME}, retry_due boolean"
_NAMES = [column.split()[0] for column in CHANGE.split(", ")]
STATE = (
    "ids array<bigint>, attempts array<int>, kinds array<string>, status_codes array<int>, "
    "error_kinds array<string>, bodies array<string>, waiting array<bigint>, due array<bigint>"
)
GROUPS = 8192
"""Groups that documents are dealt into by a hash of their ids; each has one state and one call of Python a batch."""
Made = dict[int, tuple[int, str, int | None, str | None, str | None]]


def _standing(made: Made, max_retries: int) -> tuple[str, int, int | None, str | None, str | None]:
    """Outcome, number of attempts, status, error and body of one document, by its attempts."""
    ended = min((n for n, row in made.items() if row[1] != "retry"), default=None)
    n_attempts, kind, status, error, body = made[max(made) if ended is None else ended]
    outcome = kind if ended is not None else "exhausted" if n_attempts == max_retries else "incomplete"
    return outcome, n_attempts, status, error, body if outcome == "ok" else None


def _take_in(batches: Iterator[pd.DataFrame], documents: dict[int | None, Made]) -> dict[int | None, None]:
    """Add the attempts of ``batches`` to their documents, whose ids are returned."""
    touched: dict[int | None, None] = {}
    for batch in batches:
        for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
            key, attempt = int(row.doc_id) if row.has_id else None, int(row.attempt)
            made = documents.setdefault(key, {})
            touched[key] = None
            if attempt in made:
                continue  # logged twice
            status = None if row.status_code is None else int(row.status_code)
            made[attempt] = attempt, row.kind, status, row.error_kind, row.body
            # only the first success shows its body
            for later in sorted(n for n, other in made.items() if other[1] == "ok")[1:]:
                made[later] = (*made[later][:4], None)
    return touched


def follow_attempts(
    attempts: DataFrame, max_retries: int = fv.MAX_RETRIES, retry_backoff: float = fv.RETRY_BACKOFF
) -> DataFrame:
    """How the calls of each document stand, from a stream of attempt rows, whenever that changes.

    The state of a document holds its attempts, ``max_retries`` at most, and the
    body of the one that ended its calls. Attempts may come in any order, in any number of
    batches. While the last one is to be repeated the outcome is ``incomplete``, and a timer is set:
    ``retry_backoff ** n_attempts`` seconds later one row with ``retry_due`` says so, unless
    another attempt has come by then. All other rows have ``retry_due`` false.

    A call of Python costs some milliseconds whatever it does, so documents share states, in
    ``GROUPS`` groups; the timer of a group is the first one of its documents.
    """
    def follow(
        key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        documents: dict[int | None, Made] = {}
        timers: dict[int | None, int] = {}
        if state.exists:
            *held, waiting, due = state.get
            for doc_id, *row in zip(*held):
                documents.setdefault(doc_id, {})[row[0]] = tuple(row)
            timers = dict(zip(waiting, due))
        now = state.getCurrentProcessingTimeMs()
        touched = {} if state.hasTimedOut else _take_in(batches, documents)
        out = []
        for doc_id in touched:
            timers.pop(doc_id, None)
            standing = _standing(documents[doc_id], max_retries)
            if standing[0] == "incomplete":
                timers[doc_id] = now + max(1, int(1000 * retry_backoff ** standing[1]))
            out.append((doc_id, *standing, False))
        for doc_id in [d for d, at in timers.items() if at <= now]:
            del timers[doc_id]
            out.append((doc_id, *_standing(documents[doc_id], max_retries), True))
        rows = [(doc_id, *row) for doc_id, made in documents.items() for row in made.values()]
        state.update((*map(list, zip(*rows)), list(timers), list(timers.values())))
        if timers:
            state.setTimeoutDuration(max(1, min(timers.values()) - now))
        yield pd.DataFrame(out, columns=_NAMES, dtype=object).astype(
            {"doc_id": "Int64", "n_attempts": "Int32", "status_code": "Int32", "retry_due": "bool"}
        )

    kind = attempt_kind()
    made = attempts.where(F.col("attempt") <= max_retries).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).alias("_group"),
        # a column with nulls would come as floating point numbers
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"),
        "attempt", kind.alias("kind"), "status_code", "error_kind", F.when(kind == "ok", F.col("body")).alias("body"),
    )
    return made.groupBy("_group").applyInPandasWithState(
        follow, CHANGE, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def start_attempts(
    attempts: DataFrame,
    folder: str,
    checkpoint: str,
    max_retries: int = fv.MAX_RETRIES,
    retry_backoff: float = fv.RETRY_BACKOFF,
    every: str = "10 seconds",
) -> StreamingQuery:
    """Write how calls stand to ``folder`` until the query is stopped; timers are looked at ``every`` so often.

    Started again with the same ``checkpoint`` it goes on with what is new, its timers included.
    """
    return write_changes(
        follow_attempts(attempts, max_retries, retry_backoff), folder, checkpoint, "retry_due", every=every
    )


def read_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What ``resolve_attempts`` makes of all attempts that ``start_attempts`` has seen."""
    changes = read_changes(spark, folder, T.StructType.fromDDL(CHANGE))
    return newest(changes.where(~F.col("retry_due")), "doc_id").drop("retry_due")


def read_due_retries(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, n_attempts``: documents whose next attempt is due, and how many they have had."""
    changes = read_changes(spark, folder, T.StructType.fromDDL(CHANGE))
    return newest(changes, "doc_id").where("retry_due").select("doc_id", "n_attempts")


def wait_for_input(query: StreamingQuery, seconds: float = 600) -> None:
    """Wait until ``query`` has taken in all attempts that are there.

    Timers keep such a query busy, so that ``processAllAvailable`` would wait for
    ever. A batch that was planned after this call and found nothing new tells the same; the
    one that runs now, or is repeated after a restart, was planned before. It gives up
    when no batch has ended for ``seconds``.
    """
    before = query.lastProgress
    running = before["batchId"] + 1 if before else None
    last, end = before and before["batchId"], time.monotonic() + seconds
    while time.monotonic() < end:
        if (failed := query.exception()) is not None:
            raise failed
        now = query.lastProgress
        if now and now["batchId"] != last:
            last, end = now["batchId"], time.monotonic() + seconds
        if now and running is None:
            running = now["batchId"]
        elif now and now["batchId"] > running and now["numInputRows"] == 0:
            return
        time.sleep(0.2)
    raise TimeoutError(f"attempts are still coming in, and no batch has ended for {seconds} seconds")
