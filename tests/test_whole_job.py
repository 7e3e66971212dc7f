"""From messages to enriched offers: pictures, the model, failures of each kind, retries, purge, bounded slices."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerlake.jobs.backfill import Aborted, Model, compact_processed, processed_messages, purge, run_backfill, run_slice, waiting
from offerlake.jobs.tables import current

NOW = 1_700_000_000_000
SCHEMA = "message_id long, thread_id long, label string, sender string, subject string, text string, html string, internal_date long, failed boolean"
LINK = '<a href="https://s.example/?coupon=LINK7X">x</a>'


def mail(n, shop="plain", text="enter code SPOON64 now", html="", label="CATEGORY_PROMOTIONS", failed=False):
    return (n, n, label, f"Shop <a@mail.{shop}.com>", "News", text, html, NOW - n * 1000, failed)


MAILS = [
    mail(1), mail(2, html=LINK), mail(3, "busy", html=LINK), mail(4, "refuse", html=LINK), mail(5, "garbled", html=LINK), mail(6, text="hello", html="<p>hi</p>"), mail(7, html=LINK, failed=True),
    mail(8, html=LINK, label="OTHER"), mail(9, "pictures", text="look"), mail(10, "invents", html=LINK), mail(11, "old", html=LINK),
]


def model(folder, busy=True):
    def details(code, sender):
        return {"code": code, "discount": "10%", "currency": None, "min_spend": None, "max_discount": None, "expiry": "2020-01-31" if "old" in sender else "2030-01-31", "single_use": None, "new_users_only": False, "app_only": False, "categories": ["food"], "conditions": ""}

    def one(prompt):
        lines = dict(line.split(": ", 1) for line in prompt.split("\n")[:4])
        with open(f"{folder}/asked", "a") as f:
            f.write(lines["SENDER"] + "\n")
        if "busy" in lines["SENDER"] and busy:
            return 429, "slow down", 120_000
        if "locked" in lines["SENDER"]:
            return 401, "who are you", None
        codes = ["NOTTHERE1"] if "invents" in lines["SENDER"] else lines["CANDIDATE CODES"].split(", ")
        said = "{" if "garbled" in lines["SENDER"] else json.dumps({"offers": [details(c, lines["SENDER"]) for c in codes]})
        message = {"content": None, "refusal": "no"} if "refuse" in lines["SENDER"] else {"content": said}
        return 200, json.dumps({"choices": [{"message": message, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}}), None

    def call(prompts):
        found = [one(p) for p in prompts]
        return pd.DataFrame({"status": [f[0] for f in found], "body": [f[1] for f in found], "retry_after_ms": pd.array([f[2] for f in found], dtype="Int64")})

    return Model(call, f"{folder}/log", slots=2)


def ocr(bare):
    return bare.filter("sender like '%pictures%'").select("message_id", F.lit("use code PIC99 today").alias("ocr_text"))


def mails(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def states(spark, root):
    return {r.message_id: (r.status, r.llm_processed) for r in processed_messages(spark, root).collect()}


def offers(spark, root):
    return {(r.brand_key.split(".")[0], r.normalized_code): r for r in current(spark, root, "offers").collect()}


def test_from_messages_to_enriched_offers(spark, tmp_path):
    folder, root = str(tmp_path), str(tmp_path / "t")
    run_backfill(mails(spark, MAILS), root, 0, NOW, model=model(folder), ocr=ocr)
    got = states(spark, root)
    done, lost = ("candidates", True), ("failed", True)
    assert got == {1: done, 2: done, 4: lost, 5: lost, 6: ("no-code", True), 7: lost, 9: done, 10: done, 11: done}
    found = offers(spark, root)
    assert sorted(found) == [("garbled", "LINK7X"), ("pictures", "PIC99"), ("plain", "LINK7X"), ("plain", "SPOON64"), ("refuse", "LINK7X")]
    assert all(r.llm_processed for r in found.values())
    assert found["plain", "SPOON64"].discount == "10%" and found["refuse", "LINK7X"].discount is None
    assert found["pictures", "PIC99"].source == "ocr" and found["pictures", "PIC99"].needs_review
    sources = {(r.normalized_code, r.message_id) for r in current(spark, root, "sources").filter("brand_key like 'plain%'").collect()}
    assert sources == {("SPOON64", 1), ("SPOON64", 2), ("LINK7X", 2)}
    # the busy one waits, and is neither asked nor done before its time
    (late,) = waiting(spark, root, NOW).collect()
    assert late.message_id == 3 and late.next_at >= NOW + 120_000
    asked = open(f"{folder}/asked").read()
    run_backfill(mails(spark, MAILS), root, 1, NOW + 1000, model=model(folder), ocr=ocr)
    assert open(f"{folder}/asked").read() == asked and 3 not in states(spark, root)
    run_backfill(mails(spark, MAILS), root, 2, NOW + 400_000, model=model(folder, busy=False), ocr=ocr)
    assert states(spark, root)[3] == done and ("busy", "LINK7X") in offers(spark, root)
    assert current(spark, root, "ledger").filter("message_id = 3").isEmpty() and open(f"{folder}/asked").read().count("busy") == 2


def test_a_failure_of_all_ends_the_batch_before_the_commit(spark, tmp_path):
    folder, root = str(tmp_path), str(tmp_path / "t")
    run_backfill(mails(spark, MAILS[:2]), root, 0, NOW, model=model(folder))
    before = offers(spark, root), states(spark, root)
    with pytest.raises(Aborted, match="auth"):
        run_backfill(mails(spark, [*MAILS, mail(20, "locked", html=LINK)]), root, 1, NOW, model=model(folder), ocr=ocr)
    assert (offers(spark, root), states(spark, root)) == before
    # what was answered before is kept: the next run asks for the rest only
    asked = open(f"{folder}/asked").read().split("\n")
    run_backfill(mails(spark, MAILS), root, 1, NOW, model=model(folder), ocr=ocr)
    again = open(f"{folder}/asked").read().split("\n")[len(asked) - 1 :]
    assert not [s for s in again if "busy" not in s and s in asked and s]
    assert states(spark, root)[4] == ("failed", True)


def test_slices_take_new_mail_first_and_purge_drops_what_expired(spark, tmp_path):
    folder, root = str(tmp_path), str(tmp_path / "t")
    rows = mails(spark, [mail(n, html=LINK) for n in range(1, 9)])
    new = spark.createDataFrame([(6,), (7,), (7,), (99,)], "message_id long")
    for number, want in enumerate([{6, 7, 1}, {6, 7, 1, 2, 3, 4}, set(range(1, 9)), set(range(1, 9))]):
        run_slice(rows, new, root, number, NOW, 3)
        assert states(spark, root).keys() == want
    before, paths = states(spark, root), current(spark, root, "processed").inputFiles()
    compact_processed(spark, root, 4)
    assert states(spark, root) == before and len({os.path.dirname(p) for p in current(spark, root, "processed").inputFiles()}) == 1 < len({os.path.dirname(p) for p in paths})
    run_slice(mails(spark, [mail(50)]), new, root, 5, NOW, 3)
    assert states(spark, root).keys() == {*before, 50}
    other = str(tmp_path / "o")
    run_backfill(mails(spark, [mail(2, html=LINK), mail(11, "old", html=LINK)]), other, 0, 1_580_000_000_000, days=365, model=model(folder))
    assert ("old", "LINK7X") in offers(spark, other)
    purge(spark, other, 1, NOW)
    assert sorted({k[0] for k in offers(spark, other)}) == ["plain"] and current(spark, other, "sources").filter("brand_key like 'old%'").isEmpty()
