"""Calls to something outside, in batches: bounded concurrency, time-outs, repeats, a row for every outcome, resumed by what is done.

Defined results: a key is called once however often it stands in the input (null keys are left out); an outcome is ok, failed or
timed_out with the attempts it took; a call that outlives its time-out is given up, its thread runs out by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = "key string, status string, result string, error string, attempts int, seconds double"


def call_all(requests: DataFrame, call: Callable[[str, str], str], *, tasks: int = 4, threads: int = 4, timeout: float = 30.0, attempts: int = 3, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """OUTCOMES for ``requests`` (key, payload): ``call(key, payload)`` by ``threads`` in each of ``tasks`` tasks, so that no more than their product run at once."""

    def one(pool: ThreadPoolExecutor, key: str, payload: str) -> tuple:
        began, wait, error, status = time.monotonic(), pause, None, "failed"
        for n in range(1, attempts + 1):
            try:
                return key, "ok", pool.submit(call, key, payload).result(timeout=timeout), None, n, time.monotonic() - began
            except TimeoutError:
                status, error = "timed_out", f"no answer in {timeout} s"
            except Exception as e:  # whatever the outside throws is an outcome
                status, error = "failed", f"{type(e).__name__}: {e}"[:500]
            if n < attempts:
                sleep(wait)
                wait *= 2
        return key, status, None, error, attempts, time.monotonic() - began

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one thread waits for each call, another makes it; one that hangs takes its own with it and no one else's
        with ThreadPoolExecutor(threads) as waiting:
            calling = ThreadPoolExecutor(threads * (attempts + 1))
            for batch in batches:
                for lo in range(0, batch.num_rows, threads * 8):
                    part = batch.slice(lo, threads * 8)
                    done = list(waiting.map(lambda kp: one(calling, *kp), zip(part.column(0).to_pylist(), part.column(1).to_pylist())))
                    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=["key", "status", "result", "error", "attempts", "seconds"])
            calling.shutdown(wait=False, cancel_futures=True)

    each = requests.where("key is not null").groupBy("key").agg(F.min("payload").alias("payload"))
    return each.repartition(tasks, "key").mapInArrow(run, OUTCOMES)


def resume(requests: DataFrame, log: DataFrame) -> DataFrame:
    """The requests without an ok outcome in ``log`` (OUTCOMES of earlier runs)."""
    return requests.join(log.where("status = 'ok'").select(F.col("key").alias("done__")).distinct(), F.col("key") == F.col("done__"), "left_anti")


def latest(log: DataFrame, run: str = "run") -> DataFrame:
    """The outcome that counts for each key: an ok one if there is any, else that of the last ``run``."""
    rest = [c for c in log.columns if c != "key"]
    order = F.struct((F.col("status") == "ok").alias("ok"), F.col(run), F.struct(*rest).alias("row"))
    return log.groupBy("key").agg(F.max(order).alias("m")).select("key", *[F.col(f"m.row.{c}").alias(c) for c in rest])
