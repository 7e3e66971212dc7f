"""The ledger as a stream's state, and the log of answers."""

import os

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlake.operators.enrichment import logged_answers, run_logged_inference
from offerlake.operators.sync import update_ledger
from offerlake.streaming.history import LogFeed, append_changes, history, planned_offset
from offerlake.streaming.retries import OUTCOMES, retry_ledger, run_retries, without_settled

ROWS = [
    ("a", "network", None), ("b", "schema", None), ("a", "server", 900_000), ("c", "rate-limit", 50_000), ("d", "network", None), ("c", None, None), ("a", "network", None), ("e", "refusal", None),
    ("d", "network", None), ("d", "server", None), ("d", "server", None), ("d", "server", None), ("a", None, None), ("a", "rate-limit", None), ("b", None, None), ("f", None, None), ("e", "network", None),
]


def outcomes(spark):
    return spark.createDataFrame([(n, m, 1_000_000 + n * 1000, e, r, 0.75 + n % 3 * 0.25) for n, (m, e, r) in enumerate(ROWS, 1)], OUTCOMES)


def run(spark, log, root, per_batch, watermark="1 hour"):
    """All that changed, over as many queries as there are batches, each with the checkpoint of the one before."""
    rows = []
    while True:
        resume = planned_offset(spark, f"{root}/state")
        stream = history(spark, LogFeed(log, OUTCOMES), per_batch=per_batch, **({} if resume is None else {"resume": resume}))
        query = run_retries(stream, lambda df, n: rows.extend((n, *r) for r in df.collect()), f"{root}/state", watermark)
        query.awaitTermination()
        if planned_offset(spark, f"{root}/state") == resume:
            return rows


def test_the_ledger_equals_that_of_single_batches(spark, tmp_path):
    append_changes(outcomes(spark), str(tmp_path / "log"), 2, OUTCOMES)
    want = spark.createDataFrame([], "message_id string, attempts int, next_at long, terminal boolean")
    for n in range(1, len(ROWS) + 1):
        row = outcomes(spark).filter(F.col("seq") == n)
        want = spark.createDataFrame(update_ledger(want, row.select("message_id", "error", "retry_after_ms", "jitter"), 1_000_000 + n * 1000).collect(), want.schema)
    rows = run(spark, str(tmp_path / "log"), str(tmp_path / "r"), 4)
    last = {}
    for _, message_id, seq, attempts, next_at, terminal, event in rows:
        if event != "due":
            last[message_id] = (attempts, next_at, terminal, event)
    got = {m: v[:3] for m, v in last.items() if v[3] != "cleared"}
    assert got == {r.message_id: (r.attempts, r.next_at, r.terminal) for r in want.collect()} and {"a", "d", "e"} <= got.keys()


def test_a_waiting_message_is_due_when_its_time_comes(spark, tmp_path):
    log = str(tmp_path / "log")
    # the last outcome moves the time of the stream beyond the first one's 30 s, but not beyond the second one's 90
    rows = [(1, "x", 1_000_000, "network", None, 1.0), (2, "y", 1_000_000, "server", 90_000, 1.0), (3, "z", 1_001_000, "schema", None, 1.0), (4, "w", 1_060_000, None, None, 1.0), (5, "w", 1_061_000, None, None, 1.0)]
    append_changes(spark.createDataFrame(rows, OUTCOMES), log, 1, OUTCOMES)
    found = run(spark, log, str(tmp_path / "r"), 2, "1 second")
    assert [r[1:6] for r in found if r[6] == "due"] == [("x", 1, 1, 1_030_000, False)]


def test_settled_outcomes_do_not_reach_the_state(spark, tmp_path, capsys):
    """What a later success settles is left out before the shuffle, but not what is of a later time than it, or lies in another window."""
    rows = [("a", 1, 10, "network"), ("b", 2, 20, "network"), ("a", 3, 30, None), ("a", 4, 40, "schema"), ("b", 5, 15, None), ("c", 6, 60, None), ("c", 7, 70, None), (None, 8, 80, "server"), (None, 9, None, None), (None, 10, 100, None), ("a", 11, 110, None)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("message_id", "seq", "at", "error"), r, strict=True))], pa.schema([("message_id", pa.string()), ("seq", pa.int64()), ("at", pa.int64()), ("error", pa.string())])) for r in rows]
    left = lambda window: [r["seq"] for b in without_settled(iter(batches), window) for r in b.to_pylist()]
    assert left(100) == [2, 5, 7, 9, 10, 11] and left(4) == [2, 3, 4, 5, 7, 8, 9, 10, 11] and left(1) == list(range(1, 12))
    append_changes(outcomes(spark), str(tmp_path / "log"), 1, OUTCOMES)
    retry_ledger(history(spark, LogFeed(str(tmp_path / "log"), OUTCOMES)), "1 hour").explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan.split("MapInArrow")[0] and "Exchange" not in plan.split("MapInArrow")[1]


def answer(folder, dies_at=None):
    """Notes each prompt that is asked; dies once at one of them."""

    def call(prompts):
        if dies_at is not None and (prompts == dies_at).any() and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            raise RuntimeError("lost")
        with open(f"{folder}/asked", "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return pd.DataFrame({"status": [429 if p.startswith("busy") else 200 for p in prompts], "body": ["said " + p for p in prompts], "retry_after_ms": pd.array([7000 if p.startswith("busy") else None for p in prompts], dtype="Int64")})

    return call


def test_a_job_that_dies_asks_no_prompt_twice(spark, tmp_path):
    folder, log = str(tmp_path), str(tmp_path / "log")
    prompts = spark.createDataFrame([(n, f"p{n % 40}") for n in range(60)] + [(90, "busy 1"), (91, None)], "message_id long, prompt string").filter("prompt is not null")
    with pytest.raises(Exception, match="lost"):
        run_logged_inference(prompts, answer(folder, "p17"), log, slots=2, batch=1, buckets=4).collect()
    before = logged_answers(spark, log).count()
    assert 0 < before < 40
    got = {r.message_id: (r.status, r.body, r.retry_after_ms) for r in run_logged_inference(prompts, answer(folder, "p17"), log, slots=2, batch=1, buckets=4).collect()}
    assert got == {n: (200, f"said p{n % 40}", None) for n in range(60)} | {90: (429, "said busy 1", 7000)}
    again = run_logged_inference(prompts, answer(folder), log, slots=3, batch=8, buckets=4)
    assert again.count() == 61
    asked = open(f"{folder}/asked").read().split("\n")[:-1]
    assert sorted(p for p in asked if p[0] == "p") == sorted({f"p{n}" for n in range(40)})
    # another model's answers are its own
    assert run_logged_inference(prompts.limit(1), answer(folder), log, model="other").count() == 1
    assert logged_answers(spark, log).count() == 41
    assert run_logged_inference(prompts.limit(0), answer(folder), str(tmp_path / "new")).count() == 0
