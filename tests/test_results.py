"""Results with a lifetime: expiry, upgrade of asked links only, and a restart from the checkpoint."""

import json
import time

import pytest

from vantage.operators import zone
from vantage.streaming import results

LINK = {"ae": 1000010.0, "an": 235010.0, "az": 20.0, "be": 1000040.0, "bn": 235030.0, "bz": 25.0, "hertz": 60e9, "result": "Unobstructed"}


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "requests").mkdir()
    seen = []

    def full_of(links):
        seen.append(sorted(r.link_id for r in links.select("link_id").collect()))
        return zone.zone_cells(links).select("link_id", "n", "e", "bottom", "top")

    def run(*rows, **seconds):
        number = len(list((tmp_path / "requests").iterdir()))
        (tmp_path / "requests" / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = spark.readStream.schema(results.REQUESTS).json(str(tmp_path / "requests"))
        results.serve(stream, full_of, str(tmp_path / "out"), str(tmp_path / "check"), **seconds)
        rows = spark.read.parquet(str(tmp_path / "out" / "answers")).collect()
        last = max(r.batch for r in rows)
        return {r.ask_id: (r.result_id, r.answer, r.result) for r in rows if r.batch == last}

    run.seen, run.path = seen, tmp_path
    return run


def put(result_id, **over):
    return {"result_id": result_id, "kind": "put", **LINK, **over}


def get(result_id, ask_id):
    return {"result_id": result_id, "kind": "get", "ask_id": ask_id}


def test_upgrade_and_restart(spark, store):
    first = store(put("a"), put("b", result="Obstructed"), get("a", "1"), get("a", "2"), get("c", "3"), full_seconds=900)
    assert first == {"1": ("a", "upgraded", "Unobstructed"), "2": ("a", "full", "Unobstructed"), "3": ("c", "missing", None)}
    again = store(get("a", "4"), get("b", "5"), put("c"), full_seconds=900)  # a new query on the old checkpoint
    assert again == {"4": ("a", "full", "Unobstructed"), "5": ("b", "upgraded", "Obstructed")}
    assert [x for x in store.seen if x] == [["a"], ["b"]]
    full = spark.read.parquet(str(store.path / "out" / "full"))
    assert {r.link_id for r in full.select("link_id").distinct().collect()} == {"a", "b"}


def test_results_run_out(store):
    assert store(put("a"), get("a", "1"), lite_seconds=600, full_seconds=1)["1"][1] == "upgraded"
    time.sleep(1.5)
    assert store(get("a", "2"), lite_seconds=600, full_seconds=1)["2"][1] == "upgraded"  # the full one had gone


def test_lite_results_run_out(store):
    assert store(put("a"), get("a", "1"), lite_seconds=1, full_seconds=1)["1"][1] == "upgraded"
    time.sleep(1.5)
    assert store(get("a", "2"), lite_seconds=1, full_seconds=1)["2"] == ("a", "missing", None)
