"""Stream state by key, entry by entry."""

from __future__ import annotations

import datetime as dt
import os
import time

import pytest

from logspark.streaming import keyed, streams


@pytest.fixture
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_last_keys_are_remembered_by_entries(spark, rocksdb, tmp_path):
    source, sizes, seen = tmp_path / "in", [], []

    def run(ids, number, last=6):
        spark.createDataFrame([(i, number) for i in ids], "id string, n long").coalesce(1).write.mode("append").json(str(source))
        got = []
        stream = keyed.deduplicated_last(streams.stream_ndjson(spark, str(source), "id string, n long"), last=last, parts=1)
        query = streams.start(stream, lambda b, n: got.extend(r.id for r in b.collect()), str(tmp_path / "ck"))
        assert query.awaitTermination(120) and query.exception() is None
        seen.append(sorted(got))
        changes = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "ck" / "state") for f in names if f.endswith((".changelog", ".delta"))]
        sizes.append(sum(os.path.getsize(f) for f in changes))

    run(["a", "b", "a", "c"], 0)
    run(["a", "d", "e"], 1)
    run(["f", "g", "b"], 2)  # seven keys: a, the first one, is forgotten
    run(["a", "c"], 3)
    run(["a", "c"], 4)
    assert seen == [["a", "b", "c"], ["d", "e"], ["f", "g"], ["a"], []]


def test_session_users_by_entries(spark, rocksdb, tmp_path):
    source, got = tmp_path / "in", {}

    def run(rows):
        data = [(str(k), "b", s, dt.datetime(2026, 1, 1, 0, 0, k), e, u, u and "u") for k, s, e, u in rows]
        spark.createDataFrame(data, "id string, base string, Session string, DateTime timestamp, Event string, User string, UserUuid string").coalesce(1).write.mode("append").json(str(source))
        schema = "id string, base string, Session string, DateTime timestamp, Event string, User string, UserUuid string"
        query = streams.start(keyed.with_session_user(streams.stream_ndjson(spark, str(source), schema), None), lambda b, n: got.update((r.id, r.User) for r in b.collect()), str(tmp_path / "ck"))
        assert query.awaitTermination(120) and query.exception() is None

    run([(1, "s", "e", "Иванов"), (2, "s", "e", ""), (3, "t", "e", None)])
    run([(4, "s", "e", "User #7"), (5, "s", "Сеанс. Завершение", ""), (6, "s", "e", ""), (7, "t", "e", "Петров")])
    run([(8, "s", "e", None), (9, "t", "e", "")])
    assert got == {"1": "Иванов", "2": "Иванов", "3": None, "4": "Иванов", "5": "Иванов", "6": "", "7": "Петров", "8": None, "9": "Петров"}


def test_keys_expire(spark, rocksdb, tmp_path):
    source, got = tmp_path / "in", []
    write = lambda: spark.createDataFrame([("a", 1)], "id string, n long").coalesce(1).write.mode("append").json(str(source))
    write()
    stream = keyed.deduplicated_last(streams.stream_ndjson(spark, str(source), "id string, n long"), last=6, parts=1, ttl_ms=1)
    query = streams.start(stream, lambda b, n: got.extend(r.id for r in b.collect()), str(tmp_path / "ck"), "1 second")
    try:
        end = time.time() + 90
        while len(got) < 1 and time.time() < end:
            time.sleep(0.5)
        write()  # the key is known no more
        while len(got) < 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert got == ["a", "a"]
