"""Model calls as data: attempt logs, their outcome, replies and conversations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.operators.requests import extract_reply

ATTEMPT_TYPE = "doc_id bigint, attempt int, status_code int, error_kind string, body string"
CALLS_A_GROUP = 16
CELLS = 4096
"""Cells that file names are sorted in, each by one task."""
Send = Callable[[str], tuple[int | None, str | None, str | None]]


def call_model(
    requests: DataFrame,
    send: Send,
    max_retries: int = fv.MAX_RETRIES,
    retry_backoff: float = fv.RETRY_BACKOFF,
    pause: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Attempt rows of live calls, one task per partition of ``requests``.

    ``send`` takes a payload and returns ``(status_code, error_kind, body)``; the
    caller brings the transport. What it raises is recorded as an error kind. Write
    the result before using it, as a lost executor otherwise repeats the calls of its
    partitions. Rows are handed on after every ``CALLS_A_GROUP`` requests.
    """
    def attempts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b[n : n + CALLS_A_GROUP] for b in batches for n in range(0, len(b), CALLS_A_GROUP)):
            rows = []
            for doc_id, payload in zip(batch["doc_id"], batch["payload"]):
                for attempt in range(1, max_retries + 1):
                    try:
                        status, error, body = send(payload)
                    except Exception as raised:  # noqa: BLE001 - recorded, not fatal to the job
                        status, error, body = None, _error_kind(raised), None
                    rows.append((doc_id, attempt, status, error, body))
                    if error not in fv.RETRYABLE_ERRORS and status not in fv.RETRYABLE_STATUSES:
                        break
                    if attempt < max_retries:
                        pause(retry_backoff ** attempt)
            out = pd.DataFrame(
                rows, columns=["doc_id", "attempt", "status_code", "error_kind", "body"]
            )
            yield out.astype({"status_code": "Int32"})

    return requests.select("doc_id", "payload").mapInPandas(attempts, ATTEMPT_TYPE)


def _error_kind(raised: Exception) -> str:
    if isinstance(raised, TimeoutError):
        return "timeout"
    return "connection" if isinstance(raised, ConnectionError) else "other"


def attempt_kind() -> Column:
    """``ok``, ``retry`` or ``fatal`` for one attempt row.

    A good status with a body that is no JSON is fatal, and so is status 429.
    """
    return (
        F.when(F.col("error_kind").isin(*fv.RETRYABLE_ERRORS), "retry")
        .when(F.col("error_kind").isNotNull(), "fatal")
        .when(F.col("status_code").isin(*fv.RETRYABLE_STATUSES), "retry")
        .when(
            (F.col("status_code") == 200) & F.try_parse_json(F.col("body")).isNotNull(), "ok"
        )
        .otherwise("fatal")
    )


def resolve_attempts(attempts: DataFrame, max_retries: int = fv.MAX_RETRIES) -> DataFrame:
    """One row per document: how its calls ended, after how many attempts.

    ``outcome`` is ``ok``, ``fatal``, ``exhausted``, or ``incomplete`` while the
    log still ends on an attempt that would be repeated. Attempts are reduced
    before the shuffle, so one document with a huge log is no hot spot.
    """
    made = attempts.where(F.col("attempt") <= max_retries).select(
        "doc_id", "attempt", "status_code", "error_kind", "body", attempt_kind().alias("kind")
    )
    ending = F.when(F.col("kind") != "retry", F.col("attempt"))
    kept = F.struct(
        "attempt", "kind", "status_code", "error_kind",
        F.when(F.col("kind") == "ok", F.col("body")).alias("body"),
    )
    last = F.coalesce("_end", "_last")
    return (
        made.groupBy("doc_id")
        .agg(F.min_by(kept, ending).alias("_end"), F.max_by(kept, "attempt").alias("_last"))
        .select(
            "doc_id",
            F.when(F.col("_end").isNotNull(), F.col("_end.kind"))
            .when(F.col("_last.attempt") == max_retries, "exhausted")
            .otherwise("incomplete").alias("outcome"),
            last["attempt"].alias("n_attempts"),
            last["status_code"].alias("status_code"),
            last["error_kind"].alias("error_kind"),
            F.col("_end.body").alias("body"),
        )
    )


def responses(resolved: DataFrame) -> DataFrame:
    """``doc_id, response`` of the calls that succeeded."""
    return resolved.where(F.col("outcome") == "ok").select(
        "doc_id", extract_reply(F.col("body")).alias("response")
    )


def backoff_cost(
    resolved: DataFrame, retry_backoff: float = fv.RETRY_BACKOFF
) -> DataFrame:
    """Seconds waited between the attempts of each document: base ** attempt each.

    There is no wait after the attempt that ended the calls.
    """
    waits = (
        F.when(F.col("outcome") == "incomplete", F.col("n_attempts"))
        .otherwise(F.col("n_attempts") - 1)
    )
    seconds = F.aggregate(
        F.sequence(F.lit(1), waits),
        F.lit(0.0),
        lambda total, n: total + F.pow(F.lit(float(retry_backoff)), n),
    )
    return resolved.select(
        "doc_id", "outcome", "n_attempts",
        F.when(waits > 0, seconds).otherwise(0.0).alias("backoff_seconds"),
    )


def without_text(documents: DataFrame) -> DataFrame:
    """``doc_id, file_name, has_text``: all that a join needs of a document.

    Texts are by far the largest column. They are never shuffled, and not even
    read where the documents come with a ``has_text`` column already.
    """
    if "has_text" in documents.columns:
        return documents.select("doc_id", "file_name", "has_text")
    readable = F.coalesce(F.col("text") != "", F.lit(False))
    return documents.select("doc_id", "file_name", readable.alias("has_text"))


def attach_responses(known: DataFrame, responses: DataFrame) -> DataFrame:
    """``doc_id, file_name, has_text`` with the ``response`` of each document.

    A document that ``responses`` holds more than once keeps the greatest of its
    replies, in the order of strings, so no document is ever repeated. One without
    text was never sent: a reply recorded for it does not count.

    The join merges. Spark's size estimate of a text column is too rough to
    broadcast replies by, and the parsing that follows runs in the partitions
    of the join, not in the few splits a list of documents may have.
    """
    single = responses.groupBy("doc_id").agg(F.max("response").alias("response"))
    replies = single.hint("merge")
    return known.join(replies, "doc_id", "left").withColumn(
        "response", F.when(F.col("has_text"), F.col("response"))
    )


def _cells(names: Column, ends: DataFrame) -> Column:
    """A number from 0 to ``CELLS`` + 1 that never falls from one name to the next in order, by ``ends``, their span.

    Names between the first and the last share what these two begin with. The
    seven bytes behind that are a number, and cells of equal width cut it.
    """
    def number(name: Column, shared: Column) -> Column:
        digits = F.rpad(F.left(F.hex(F.substr(name, shared + 1).cast("binary")), F.lit(14)), 14, "0")
        return F.conv(digits, 16, 10).cast("bigint")

    low, high = F.col("low"), F.col("high")
    shared = F.aggregate(
        F.sequence(F.lit(0), F.least(F.length(low), F.length(high))), F.lit(0),
        lambda most, n: F.when(F.left(low, n) == F.left(high, n), n).otherwise(most),
    )
    span = ends.withColumn("shared", shared).select(
        F.struct("shared", number(low, F.col("shared")).alias("low"), number(high, F.col("shared")).alias("high"))
    ).scalar()
    value = number(names, span["shared"])
    width = (span["high"] - span["low"]).cast("double") / CELLS
    cell = F.floor(F.try_divide(value - span["low"], width))
    return F.when(names.isNull(), -1).otherwise(F.coalesce(cell, F.lit(0)))


def conversation_batches(
    documents: DataFrame, size: int = fv.DOCUMENTS_PER_CONVERSATION, after: DataFrame | None = None
) -> DataFrame:
    """``doc_id, file_name, position, conversation``, ``size`` documents each.

    Positions follow the file names, and go on behind those of ``after``, the batches of former runs, if there are any. A
    window over the whole table would sort it in one task; instead
    names fall into cells whose bounds follow from the first and the last name, cells are
    counted, and a document's position is the sum of the cells before its own and its place there. Nothing is run
    when the table is made, and whenever it is read the same documents have the same positions.
    """
    rows = documents.select("doc_id", "file_name")
    ends = rows.agg(F.min("file_name").alias("low"), F.max("file_name").alias("high"))
    placed = rows.withColumn("_cell", _cells(F.col("file_name"), ends))
    # a row for each cell, so the window and the broadcast are bounded by CELLS
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_cell").count().select(
        F.col("_cell").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_cell").orderBy("file_name", "doc_id")
    numbered = placed.withColumn("_place", F.row_number().over(inside) - 1)
    position = F.col("_offset") + F.col("_place")
    if after is not None:
        position = position + after.agg(F.coalesce(F.max("position") + 1, F.lit(0))).scalar()
    return (
        numbered.join(F.broadcast(offsets), F.col("_cell") == F.col("_of"))
        .withColumn("position", position)
        .select(
            "doc_id", "file_name", "position",
            F.expr(f"position div {int(size)}").alias("conversation"),
        )
    )
