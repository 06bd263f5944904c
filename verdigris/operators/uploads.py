"""Queued payloads sent over HTTP by the tasks that hold them."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers that count as accepted, attempts of an upload, seconds until an answer must come.
ACCEPTED, MAX_ATTEMPTS, TIMEOUT = (201, 202), 5, 30
#: Rows in an outcome batch: what a task has sent is given on this often.
BATCH = 100


def post(url: str, payload: str, headers: dict[str, str], timeout: float = TIMEOUT) -> tuple[int, str]:
    """Status of an answer and what went wrong; status 0 without an answer."""
    request = urllib.request.Request(url, payload.encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, f"HTTP {answer.status}"
    except urllib.error.HTTPError as e:
        return e.code, f"HTTP {e.code}"
    except OSError as e:
        return 0, str(e) or type(e).__name__


def sent(uploads: DataFrame, url: str, token: str | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """``id, run_id, accepted, error`` of each of ``uploads (id, run_id, payload)``, posted to ``url``.

    Sending is an effect: write the outcomes once and read them from there. A task that is lost sends its rows
    again, and only one of its outcomes is written; the upload's id goes along as ``Idempotency-Key``.
    """
    bearer = {"Authorization": f"Bearer {token}"} if token else {}

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                got = [post(url, payload or "", {**bearer, "Idempotency-Key": f"{run}-{i}"}, timeout) for i, run, payload in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                ok = [code in ACCEPTED for code, _ in got]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(ok, pa.bool_()), pa.array([None if good else said for good, (_, said) in zip(ok, got, strict=True)], pa.string())], ["id", "run_id", "accepted", "error"])

    return uploads.select(F.col("id").cast("bigint"), F.col("run_id").cast("string"), F.col("payload").cast("string")).mapInArrow(send, "id bigint, run_id string, accepted boolean, error string")
