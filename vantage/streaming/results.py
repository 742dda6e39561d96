"""Stored results of analyses, as state that runs out: lite ones for three hours, full ones for thirty seconds.

A lite result is a link and its verdict. A full one has the zone's cells; it is made again from the
lite one when somebody asks and the last has run out. Requests are a stream: state by result says
what is still there, and a batch computes the full results of just the links that need them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

# Seconds that lite and full results are kept.
LITE_SECONDS, FULL_SECONDS = 3 * 60 * 60, 30
_LINK = "ae double, an double, az double, be double, bn double, bz double, hertz double, result string"
_FIELDS = ("ae", "an", "az", "be", "bn", "bz", "hertz", "result")
#: Requests: kind put (with the link and its verdict) or get (with an ask_id).
REQUESTS = f"result_id string, kind string, ask_id string, {_LINK}"
#: Answers: full (still stored), upgraded (made from the lite one in this batch) or missing (run out, or never there).
ANSWERS = f"result_id string, ask_id string, answer string, {_LINK}"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ResultStore(StatefulProcessor):
    """State of one result. Puts of a batch come before its gets; the first get that finds no full result upgrades the lite one."""

    def __init__(self, lite_seconds: int, full_seconds: int):
        self.lite_ms, self.full_ms = 1000 * lite_seconds, 1000 * full_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lite = handle.getValueState("lite", _LINK, self.lite_ms)
        self.full = handle.getValueState("full", "stored boolean", self.full_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        asks = []
        for row in rows:
            if row.kind == "put":
                self.lite.update(tuple(row[f] for f in _FIELDS))
                self.full.clear()  # cells of an older analysis
            elif row.kind == "get":
                asks.append(row.ask_id)
        for ask_id in sorted(asks, key=str):
            link, answer = (None,) * len(_FIELDS), "missing"
            if self.lite.exists():
                link, answer = tuple(self.lite.get()), "full" if self.full.exists() else "upgraded"
                if answer == "upgraded":
                    self.full.update((True,))
            yield Row(result_id=key[0], ask_id=ask_id, answer=answer, **dict(zip(_FIELDS, link)))

    def close(self) -> None:
        pass


def answers(requests: DataFrame, lite_seconds: int = LITE_SECONDS, full_seconds: int = FULL_SECONDS) -> DataFrame:
    """A stream of answers (ANSWERS) to the gets in a stream of REQUESTS. A null result_id is an id like any other."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return requests.groupBy("result_id").transformWithState(ResultStore(lite_seconds, full_seconds), ANSWERS, "Append", "ProcessingTime")


def serve(requests: DataFrame, full_of: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, lite_seconds: int = LITE_SECONDS, full_seconds: int = FULL_SECONDS) -> None:
    """Answers what is there now: writes ``out``/answers and, for upgraded results alone, ``out``/full, a folder for each batch.

    ``full_of`` takes links (link_id: the result's id) and gives their full results. A batch that is
    run again after a failure overwrites its own folders, and state goes on from the checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the state's step runs once for both tables
        try:
            batch.select("result_id", "ask_id", "answer", "result").write.mode("overwrite").parquet(f"{out}/answers/batch={number}")
            asked = batch.where("answer = 'upgraded'").select(F.col("result_id").alias("link_id"), *_FIELDS[:-1])
            full_of(asked).write.mode("overwrite").parquet(f"{out}/full/batch={number}")
        finally:
            batch.unpersist()

    stream = answers(requests, lite_seconds, full_seconds).writeStream.outputMode("append").foreachBatch(write)
    # state that runs out asks for batches for ever, so availableNow would not end; once is one batch of all there is
    stream.option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()
