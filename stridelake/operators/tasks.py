"""Episodes as tasks: bounded retries with placeholders, requests answered in batches, and snapshots of progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "index long, attempts int, completed boolean, error string, ret double"


def run_tasks(tasks: DataFrame, work: Callable[[dict, int], float], index: str, retries: int = 2, failures_to_stop: int | None = None) -> DataFrame:
    """(index, attempts, completed, error, ret) for each task.

    ``work`` gets a task's row and the number of the attempt, from 0, and returns its figure or raises.  A task has
    ``retries`` further attempts; one that fails them all becomes a placeholder with a figure of 0, so results are
    whole and can be put in the order of ``index`` again.  After ``failures_to_stop`` failed tasks in a row a
    partition stops starting work and marks the rest as not started.  Lost executors are Spark's to retry.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        in_a_row = 0
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if failures_to_stop is not None and in_a_row >= failures_to_stop:
                    out.append((row[index], 0, False, "not started", 0.0))
                    continue
                error, value, done, attempt = None, 0.0, False, 0
                for attempt in range(retries + 1):
                    try:
                        value, done, error = float(work(row, attempt)), True, None
                        break
                    except Exception as e:  # whatever a task raises counts as its failure
                        error = f"{type(e).__name__}: {e}"
                in_a_row = 0 if done else in_a_row + 1
                out.append((row[index], attempt + 1, done, error, value if done else 0.0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return tasks.mapInPandas(run, RESULT)


def answer_in_batches(requests: DataFrame, respond: Callable[[Any], Sequence[float]], key: str, size: int = 64) -> DataFrame:
    """(key, response, batch_size): requests answered together, up to ``size`` at a time.

    A batch is full or ends with its partition: bounded input has no arrivals to wait for, so the deadline of a
    live queue has no counterpart.  Responses don't depend on how requests meet unless ``respond`` makes them.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held = None

        def answer(part):
            return pd.DataFrame({key: part[key].to_numpy(), "response": [float(x) for x in respond(part)], "batch_size": len(part)})

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) >= size:
                yield answer(held.iloc[:size])
                held = held.iloc[size:].reset_index(drop=True)
        if held is not None and len(held):
            yield answer(held)

    return requests.mapInPandas(run, f"{key} long, response double, batch_size int")


def snapshots(events: DataFrame, worker: str, order: Sequence[str], state: str, done: str) -> DataFrame:
    """The latest state of every worker, with its reports and how many of them are ``done``; one row a worker is kept."""
    return events.groupBy(worker).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("reports"), F.count_if(F.col(state) == done).alias("done"))
