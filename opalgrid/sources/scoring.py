"""Scoring by an outside model: bounded retry with backoff, and runs that go on where they stopped."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from opalgrid.session import ship
from opalgrid.sources.documents import not_done


class Retry(Exception):
    """Raised by a scorer when another try may help (a full queue, a lost connection)."""


def with_retry(call: Callable[[dict[str, Any]], str], row: dict[str, Any], tries: int, wait: float, most_wait: float, sleep: Callable[[float], None], seed: int) -> tuple[str, int]:
    """Answer and number of tries. Waits double, with jitter, up to ``most_wait``; what fails for good
    becomes an answer that later stages know as failed."""
    jitter = random.Random(seed)
    for k in range(1, tries + 1):
        try:
            return call(row), k
        except Retry as error:
            reason = str(error)
            if k < tries:
                sleep(min(most_wait, wait * 2 ** (k - 1)) * (0.5 + jitter.random()))
        except Exception as error:  # one bad row must not end the run
            return f"<answer>0</answer>\n[WARN] {error}", k
    return f"<answer>0</answer>\n[WARN] {reason}", tries


def scored(requests: DataFrame, make: Callable[[], Callable[[dict[str, Any]], str]], key: str = "row_idx", tries: int = 4, wait: float = 1.0, most_wait: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, response, tries of each request. ``make`` runs once in each task and gives the scorer, a
    function of a row as a dict: connections are made where they are used."""
    ship(requests.sparkSession)
    kind = dict(requests.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            got = [with_retry(call, row, tries, wait, most_wait, sleep, i) for i, row in enumerate(batch.to_pylist())]
            yield pa.RecordBatch.from_arrays([keys, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32())], names=[key, "response", "tries"])

    return requests.mapInArrow(run, f"{key} {kind}, response string, tries int")


def score_missing(requests: DataFrame, path: str, make: Callable[[], Callable[[dict[str, Any]], str]], key: str = "row_idx", **options: Any) -> DataFrame:
    """Append the answers that the table under ``path`` lacks and give the whole table back. Answers are
    committed with the write, so a run that dies is started again and asks only for the rest."""
    spark = requests.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    schema = f"{key} {dict(requests.dtypes)[key]}, response string, tries int"
    todo = not_done(requests, spark.read.schema(schema).parquet(path).select(key), key) if there else requests
    scored(todo, make, key, **options).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
