"""A journal from bytes to a sink, with a dictionary that changes and batches that run again."""

from __future__ import annotations

import pytest
from pyspark.sql.functions import lit

from logspark.operators import eventlog
from logspark.streaming import journal


def record(second, user, event, session, code=1):
    return f'{{202608311200{second:02d},N,{{0,0}},{user},0,0,1,{event},I,"n{second}",{code},{{"U"}},"",0,0,0,{session},0}},\n'


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "base1" / "1Cv8Log"
    folder.mkdir(parents=True)
    return folder / "20260831000000.lgp"


def test_journal_from_bytes_to_sink(spark, logs, tmp_path):
    names, calls, out = {"m": "Old"}, [], str(tmp_path / "out")

    def load():
        calls.append(1)
        rows = [("base1", "user", "1", "Anna", "u1"), ("base1", "metadata", "1", names["m"], ""), ("base1", "event", "1", "Work", ""), ("base1", "event", "2", "Сеанс. Завершение", "")]
        return spark.createDataFrame(rows, "base string, kind string, code string, name string, uuid string")

    fail = []

    def deliver(rows, number):
        rows.select("Comment", "User", "Metadata").write.mode("overwrite").json(f"{out}/batch={number}")
        if fail:
            raise RuntimeError(fail.pop())

    def run():
        plan = journal.JournalPlan(str(tmp_path / "state"), load, lambda: names["m"], deliver)
        query = journal.stream_journal(spark, str(tmp_path / "base1"), plan)
        query.awaitTermination()
        return plan

    def rows():
        return {r.Comment: (r.User, r.Metadata) for r in spark.read.schema("Comment string, User string, Metadata string").json(out).collect()}

    logs.write_text("1CV8LOG(ver 2.0)\n" + record(1, 1, 1, 7) + record(2, 0, 1, 7) + '{5,0,"Renamed",1},\n' + record(3, 0, 1, 8), encoding="utf-8")
    run()
    assert rows() == {"n1": ("Anna", "Old"), "n2": ("Anna", "Old"), "n3": ("", "Renamed")} and len(calls) == 1
    with open(logs, "a", encoding="utf-8") as f:  # the same dictionary: the session's user is known from the batch before, the renamed code stays so
        f.write(record(4, 0, 1, 7) + record(5, 0, 2, 7) + record(6, 0, 1, 7) + '{20260831120007,N,{0,0},0,0,0,1,1,I,"unfin')
    fail.append("sink is down")
    with pytest.raises(Exception, match="sink is down"):
        run()
    names["m"] = "New"  # changes after the batch has begun: it runs again with the version that it had
    run()
    assert len(calls) == 1
    expected = {"n1": ("Anna", "Old"), "n2": ("Anna", "Old"), "n3": ("", "Renamed"), "n4": ("Anna", "Renamed"), "n5": ("Anna", "Renamed"), "n6": ("", "Renamed")}
    assert rows() == expected
    with open(logs, "a", encoding="utf-8") as f:
        f.write('ished",2,{"U"},"",0,0,0,7,0},\n' + record(8, 1, 1, 9) + '{5,0,"Second",2},\n' + record(9, 0, 1, 9, code=2))
    plan = run()
    assert len(calls) == 2
    assert rows() == expected | {"n8": ("Anna", "Renamed"), "n9": ("Anna", "Second"), "unfinished": ("", "Meta #2")}
    plan.compact(spark, 2)
    with open(logs, "a", encoding="utf-8") as f:
        f.write(record(10, 0, 1, 9))
    run()
    assert rows()["n10"] == ("Anna", "Renamed")


def test_places_of_records(spark):
    rows = spark.createDataFrame([("/b/1Cv8Log/20260831.lgp", 9), ("/b/1Cv8Log/20260831000000.lgp", 10), ("/b/1Cv8Log/20260831010000.lgp", 0), ("/b/1Cv8Log/20260901.lgp", 0), ("/b/1Cv8Log/x.lgp", 5)], "file string, at long")
    got = [r[0] for r in rows.select(journal.place(rows["file"], rows["at"])).collect()]
    assert got[:4] == sorted(got[:4]) and got[4] == 5 and got[1] - got[0] == 1
    assert {r[0] for r in rows.select(journal.base_of(rows["file"])).collect()} == {"b"}


def test_versions_of_a_dictionary(spark):
    """A record before a rename keeps the old name; a row without a name changes nothing; a code that comes later is unknown before."""
    dims = spark.createDataFrame([("b", "metadata", "1", "First", "")], "base string, kind string, code string, name string, uuid string")
    entries = spark.createDataFrame([("b", 5, '{5,0,"Second",1},'), ("b", 7, '{5,0,"",1},'), ("b", 8, '{5,0,"Late",2},'), ("other", 1, '{5,0,"No",1},')], "base string, at long, raw string")
    records = spark.createDataFrame([("b", k, record(k, 0, 1, 1, code="{1,2}").strip()) for k in (1, 5, 6, 8, 9)], "base string, seq long, raw string")
    got = eventlog.decode_eventlog(records, eventlog.with_versions(dims, entries)).select("seq", "Metadata").collect()
    assert dict(map(tuple, got)) == {1: "First, Meta #2", 5: "Second, Meta #2", 6: "Second, Meta #2", 8: "Second, Late", 9: "Second, Late"}
    plan = eventlog.decode_eventlog(records, dims)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "hashpartitioning(base" in line and "seq#" in line for line in plan.split("\n")) == 1  # all codes of the facts in one


def test_large_dictionary_is_salted(spark, monkeypatch):
    monkeypatch.setattr(eventlog, "BROADCAST_ENTRIES", 0)
    dims = spark.createDataFrame([("b", "user", "1", "Anna", "u"), ("b", "metadata", "1", "M", "")], "base string, kind string, code string, name string, uuid string")
    records = spark.createDataFrame([("b", k, record(k, 1, 1, 1).strip()) for k in range(50)], "base string, seq long, raw string")
    rows = eventlog.decode_eventlog(records, dims)
    assert "salt" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.User, r.UserUuid, r.Metadata) for r in rows.collect()} == {("Anna", "u", "M")} and rows.count() == 50


def test_large_dictionaries_are_never_broadcast(spark, monkeypatch, tmp_path):
    """What Spark estimates of a compressed file does not decide: kinds are counted, and each is met where it fits, with the same results."""
    entries = [("b", "user", str(k), f"U{k}", f"u{k}") for k in range(9)] + [("b", "metadata", str(k), f"M{k}" if k else "", "") for k in range(12)] + [("b", "app", "1", "BackgroundJob", ""), ("b", "event", "1", "_$Data$_.Post", ""), ("b", "port", "1", "1560", "")]
    spark.createDataFrame(entries, "base string, kind string, code string, name string, uuid string").write.parquet(str(tmp_path / "dims"))
    dims = spark.read.parquet(str(tmp_path / "dims"))
    codes = ["0", "3", "{1,2}", "{2,0,11,99}", ""]
    records = spark.createDataFrame([("b", k, record(k, k % 11, k % 3, 1, code=codes[k % 5]).strip()) for k in range(60)], "base string, seq long, raw string")
    got = {}
    for most in (0, 1, 3, 12, 100):
        monkeypatch.setattr(eventlog, "BROADCAST_ENTRIES", most)
        rows = eventlog.decode_eventlog(records, dims)
        got[most] = sorted(map(str, rows.collect()))
        if not most:
            assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert len(set(map(tuple, got.values()))) == 1 and len(got[0]) == 60 and any("M2, M11, Meta #99" in r for r in got[0])


def test_only_codes_that_are_shown_are_looked_up(spark):
    dims = spark.createDataFrame([("b", "user", "1", "Anna", "u"), ("b", "metadata", "1", "M", ""), ("b", "app", "1", "BackgroundJob", "")], "base string, kind string, code string, name string, uuid string")
    records = spark.createDataFrame([("b", k, record(k, k % 2, 1, 1).strip()) for k in range(9)], "base string, seq long, raw string")
    whole = eventlog.decode_eventlog(records, dims)
    for columns in (["DateTime", "Session"], ["Metadata"], ["User", "Data"], ["Application"], ["UserUuid", "DataPresentation"]):
        rows = eventlog.decode_eventlog(records, dims, columns=columns)
        assert set(rows.columns) == {"base", "seq", *columns}
        assert sorted(map(str, rows.select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect())), columns
    assert "Join" not in eventlog.decode_eventlog(records, dims, columns=["DateTime", "Session"])._jdf.queryExecution().optimizedPlan().toString()


def test_tree_listing_is_bounded(spark, tmp_path):
    from logspark.plans import catalog

    for k in range(3):
        deep = tmp_path / f"srv{k}" / "base" / "1Cv8Log"
        deep.mkdir(parents=True)
        (deep / "20260831000000.lgp").write_text("old")
        (deep / "20260901000000.lgp").write_text("new")
        (deep / "1Cv8FTxt").mkdir()
        (deep / "1Cv8FTxt" / "20260901000000.lgp").write_text("index")
    (tmp_path / "srv0" / "base" / "again").symlink_to(tmp_path / "srv0")  # a loop
    (tmp_path / "srv1" / "aside").symlink_to(tmp_path / "srv2" / "base")  # a link aside is followed
    (tmp_path / "top.log").write_text("x" * 7)
    got = {r.path.removeprefix(str(tmp_path)): r.size for r in catalog.list_tree(spark, str(tmp_path)).collect()}
    assert len(got) == 2 * 4 + 1 and got["/top.log"] == 7 and "/srv1/aside/1Cv8Log/20260831000000.lgp" in got
    assert {r.path.count("/") for r in catalog.list_tree(spark, str(tmp_path), depth=0).collect()} == {str(tmp_path).count("/") + 1}
    assert catalog.list_tree(spark, str(tmp_path / "none")).count() == 0
    files = catalog.list_tree(spark, f"{tmp_path}/srv2").withColumn("size", lit(1).cast("long")).cache()
    assert sorted((r.path[-18:], r.size) for r in catalog.refreshed(files).collect()) == [("20260831000000.lgp", 1), ("20260901000000.lgp", 3)]
