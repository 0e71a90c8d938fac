"""Reservations and merged positions against plain loops; the stream against the batch; replays of broken batches."""

import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import folds as D
from chronofold.plans import queries_folds as Q
from chronofold.streaming import position as S

LOG = "book_id long, n long, op string, hold_id long, input_tokens long, output_tokens long, micro long, max_input long, max_output long, max_micro long"


def log_rows():
    r = random.Random(4)
    out = []
    for n in range(400):
        book = r.choice([1, 1, 1, 2, None])
        op = r.choice(["reserve", "reserve", "spend", "actual", "settle", "discard"])
        amounts = [r.choice([0, 1, 5, 20]) for _ in range(3)]
        if r.random() < 0.05:
            amounts[r.randrange(3)] = r.choice([-1, None])
        out.append((book, n, op, r.randint(1, 60) if r.random() > 0.03 else None, *amounts, *((60, 50, None) if book == 1 else (None, None, 90))))
    return out


def by_hand(rows):
    ledgers, out = {}, {}
    for book, n, op, hold, *rest in rows:
        amounts, tops = rest[:3], rest[3:]
        spent, open_, used = ledgers.setdefault(book, ([0, 0, 0], {}, set()))
        if op in ("reserve", "spend", "actual") and (hold is None or None in amounts or min(amounts) < 0):
            res = "invalid"
        elif op in ("reserve", "spend"):
            over = [name for name, top, i in zip(("input", "output", "usd"), tops, range(3)) if top is not None and spent[i] + sum(h[i] for h in open_.values()) + amounts[i] > top]
            if hold in used:
                res = "repeated"
            elif over:
                res = f"refused {over[0]}"
            else:
                used.add(hold)
                open_[hold] = amounts
                res = "reserved"
                if op == "spend":
                    open_.pop(hold)
                    for i in range(3):
                        spent[i] += amounts[i]
                    res = "spent"
        elif hold not in open_:
            res = "unknown"
        elif op == "actual":
            open_[hold] = amounts
            res = "noted"
        else:
            a = open_.pop(hold)
            if op == "settle":
                for i in range(3):
                    spent[i] += a[i]
            res = "settled" if op == "settle" else "discarded"
        out[n] = (res, spent[2], sum(h[2] for h in open_.values()), len(open_))
    return out


def test_reservations_equal_a_plain_loop(spark):
    rows = log_rows()
    got = D.reservations(spark.createDataFrame(rows, LOG).repartition(7), ["n"]).collect()
    assert {r.n: (r.outcome, r.spent_micro, r.held_micro, r.holds) for r in got} == by_hand(rows)
    assert {r.outcome for r in got} >= {"invalid", "repeated", "refused input", "refused output", "refused usd", "reserved", "spent", "noted", "settled", "discarded", "unknown"}


def test_a_refused_request_adds_nothing(spark):
    rows = [(1, n, "spend", n, 0, 0, m, None, None, 100) for n, m in enumerate([60, 50, 40, 1])]
    got = D.reservations(spark.createDataFrame(rows, LOG), ["n"]).orderBy("n").collect()
    assert [r.outcome for r in got] == ["spent", "refused usd", "spent", "refused usd"]
    assert D.reservations(spark.createDataFrame([], LOG), ["n"]).count() == 0


REPORTS = "book_id long, n long, event_id long, chapter long, offset long, epoch long, base long, client string, sequence long, last_chapter long"


def test_late_and_tied_reports(spark):
    rows = [
        (1, 0, 0, 2, 20, 0, 0, "b", 1, 9),  # current: applied, version 1
        (1, 1, 1, 2, 20, 0, 0, "c", 1, 9),  # late, as far, greater client
        (1, 2, 2, 2, 20, 0, 0, "a", 9, 9),  # late, as far, lesser client
        (1, 3, 3, 1, 90, 0, 1, "a", 9, 9),  # late, further in one measure
        (1, 4, 4, 2, 20, 0, 0, "z", 9, 9),  # late, behind
        (1, 5, 5, 3, 99, 1, 0, "z", 9, 9),  # another epoch
        (1, 6, 6, 3, 99, 0, 9, "z", 9, 9),  # ahead of all versions
        (1, 7, 7, 10, 99, 0, 3, "z", 9, 9),  # beyond the book
        (1, 8, 8, 1, 5, 0, 3, "a", 10, 9),  # current: the place moves back, the high water does not
    ]
    got = D.merged_positions(spark.createDataFrame(rows, REPORTS).repartition(3), ["n"]).orderBy("n").collect()
    assert [r.outcome for r in got] == ["applied", "tie_won", "tie_lost", "merged_advance", "stale_behind", "stale_epoch", "future_version", "beyond_end", "applied"]
    last = got[-1]
    assert (last.p_version, last.p_bookmark, last.p_offset, last.p_high_water, last.p_client, last.p_sequence) == (4, 2, 5, 90, "a", 10)


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_of_devices_equals_batch(spark, sf, tmp_path, parts):
    """Also when the reports come in several files, one batch each."""
    rows = Q.devices(spark, sf)
    cut = rows.approxQuantile("event_id", [i / parts for i in range(1, parts)], 0) if parts > 1 else []
    low = -1
    for i, high in enumerate([*cut, 1e12]):
        rows.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        low = high
    schema = rows.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    got = S.run_once(S.device_merge(stream, Q.ORDER), str(tmp_path / "run"), "append").select("event_id", "outcome").collect()
    want = D.merged_positions(rows, Q.ORDER).select("event_id", "outcome").collect()
    assert sorted(got) == sorted(want)


def test_a_batch_that_broke_off_before_its_receipt_is_written_once(spark, tmp_path, monkeypatch):
    source, facts, receipts = (str(tmp_path / n) for n in ("in", "facts", "receipts"))
    spark.createDataFrame([(1,), (2,), (3,)], "id long").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    S.ingest(stream(), facts, receipts, str(tmp_path / "c1")).awaitTermination()
    assert S.ingested(spark, facts, receipts).count() == 3
    # The receipt is lost, as after a crash between both writes; another checkpoint runs the batch again.
    empty = str(tmp_path / "receipts2")
    S.ingest(stream(), facts, empty, str(tmp_path / "c2")).awaitTermination()
    assert S.ingested(spark, facts, empty).count() == 3
    assert sorted(r.id for r in S.ingested(spark, facts, empty).collect()) == [1, 2, 3]
