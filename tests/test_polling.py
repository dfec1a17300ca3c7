"""Polled sources: restarts, heartbeats, failures."""

import sqlite3
import threading
import time

import pytest

from ledgerlight.sources.commits import CommitLog
from ledgerlight.sources.sqlite import poll_sqlite
from ledgerlight.streaming.alerts import Heartbeats, keep_polling, last_beats, poll


@pytest.fixture
def shop(tmp_path):
    path = f"{tmp_path}/shop.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE orders (id INTEGER PRIMARY KEY, customer TEXT)")
    con.commit()
    yield path, lambda *ids: (con.executemany("INSERT INTO orders VALUES (?, 'c')", [(i,) for i in ids]), con.commit())
    con.close()


def test_a_restart_takes_only_new_rows(spark, tmp_path, shop):
    path, put = shop
    seen = []
    handle = lambda batch, number: seen.append((number, sorted(r.id for r in batch.collect())))

    def once():
        query = poll(poll_sqlite(spark, path, "orders", "id long, customer string", partitions=3), "orders", handle, f"file://{tmp_path}/progress", once=True)
        query.awaitTermination(60)

    put(1, 2, 3, 4, 5)
    once()
    put(6, 9)
    once()
    once()
    assert [rows for _, rows in seen if rows] == [[1, 2, 3, 4, 5], [6, 9]]
    assert len({n for n, _ in seen}) == len(seen)


def test_heartbeats_and_a_failure_that_does_not_end_the_loop(spark, tmp_path, shop):
    path, put = shop
    log = CommitLog(spark, f"file://{tmp_path}/beats")
    listener = Heartbeats(log)
    spark.streams.addListener(listener)
    seen, failed, stop = [], [], threading.Event()

    def handle(batch, number):
        rows = [r.id for r in batch.collect()]
        if not failed:
            failed.append(number)
            raise RuntimeError("the mail server is away")
        seen.extend(rows)

    put(1, 2)
    start = lambda: poll(poll_sqlite(spark, path, "orders"), "watched", handle, f"file://{tmp_path}/progress", once=True)
    try:
        assert keep_polling(start, stop, wait=0.1, cycles=2) == 2
        deadline = time.time() + 20
        while time.time() < deadline and last_beats(log).get("watched", {}).get("rows") != 2:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert failed == [0] and seen == [1, 2]  # the batch that failed came again
    beats = [log.read(n) for n in log.numbers()]
    states = [b["state"] for b in beats if b["source"] == "watched"]
    assert states.count("started") == 2 and any(b.get("error") and "mail server" in b["error"] for b in beats)
    assert last_beats(log)["watched"]["checked_at"] is not None
    stop.set()
    assert keep_polling(start, stop) == 0
