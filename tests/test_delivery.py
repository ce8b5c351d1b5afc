"""Sinks against a local server, and streams against their batch twins."""

from __future__ import annotations

import datetime as dt
import json
import os
import sqlite3
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from logspark.operators import lgd
from logspark.sinks import delivery
from logspark.sources import sqlite_journal
from logspark.streaming import streams

COLUMNS = "id string, DateTime timestamp, Event string, User string, UserUuid string, MetadataUuid string, Session string, base string, RepeatCount int"


@pytest.fixture
def rows(spark):
    data = [(f"i{k}", dt.datetime(2026, 9, 11, 10, 0, k), "e" if k else " ", None, "u", "m", "s", "b", 1) for k in range(6)]
    return spark.createDataFrame(data, COLUMNS)


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


@pytest.mark.parametrize(("given", "url"), [("10.20.30.40", "http://10.20.30.40:8123"), ("10.20.30.40:9000", "http://10.20.30.40:9000"), ("http://h/", "http://h:8123"), ("", "http://localhost:8123"), ("https://h", "https://h:8443")])
def test_server_urls(given, url):
    assert delivery.server_url(given) == url


def test_clickhouse(rows, server):
    url, seen = server
    assert delivery.write_clickhouse(rows.coalesce(1), url, "logs", "eventlog") == 6
    assert "CREATE DATABASE" in seen[0][1] and "CREATE TABLE" in seen[1][1]
    path, body = seen[-1]
    first = json.loads(body.split("\n")[0])
    assert "insert_deduplication_token=" + delivery.chunk_token([f"i{k}" for k in range(6)]) in path
    assert first["DateTime"] == first["Date"] == "2026-09-11 10:00:00.000" and first["User"] is None


def test_elastic(rows, server):
    url, seen = server
    assert delivery.write_elastic(rows.coalesce(1), url, "events", "Day", "prod") == (6, 0)
    assert json.loads(seen[0][1].split("\n")[0]) == {"index": {"_index": "events_prod_20260911", "_id": "i0"}}


def test_files(spark, rows, tmp_path):
    delivery.write_ndjson(rows, str(tmp_path / "out"), 2)
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    assert delivery.write_xlsx(rows, str(tmp_path / "x.xlsx"), ["id", "User"], {"User": ["User", "UserUuid"]}) == 6
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        assert z.read("xl/worksheets/sheet1.xml").decode().count("<row>") == 7


def test_stream_with_dead_letters(spark, rows, tmp_path):
    (rows.write.json(str(tmp_path / "in")))
    good, bad = [], []

    def fail(batch, number):
        bad.append(number)
        raise RuntimeError("down")

    stream = streams.deduplicated(streams.stream_ndjson(spark, str(tmp_path / "in"), rows.schema))
    q = streams.start(stream, streams.fan_out({"ok": lambda b, n: good.extend(r.id for r in b.collect()), "down": fail}, str(tmp_path / "dead")), str(tmp_path / "ck"))
    assert q.awaitTermination(120) and q.exception() is None
    assert sorted(good) == [f"i{k}" for k in range(6)] and len(bad) % 3 == 0
    assert spark.read.json(str(tmp_path / "dead" / "down" / "batch=0")).count() == 6


def test_stream_keeps_session_users(spark, tmp_path):
    data = [("1", dt.datetime(2026, 1, 1, 0, 0, 1), "e", "Иванов", "u"), ("2", dt.datetime(2026, 1, 1, 0, 0, 2), "e", "", ""), ("3", dt.datetime(2026, 1, 1, 0, 0, 3), "Сеанс. Завершение", "", ""), ("4", dt.datetime(2026, 1, 1, 0, 0, 4), "e", "", "")]
    frame = spark.createDataFrame([(*r, "s", "b") for r in data], "id string, DateTime timestamp, Event string, User string, UserUuid string, Session string, base string")
    frame.write.json(str(tmp_path / "in"))
    got = []
    stream = streams.with_session_user(streams.stream_ndjson(spark, str(tmp_path / "in"), frame.schema))
    q = streams.start(stream, lambda b, n: got.extend((r.id, r.User) for r in b.collect()), str(tmp_path / "ck"))
    assert q.awaitTermination(120) and q.exception() is None
    assert sorted(got) == [("1", "Иванов"), ("2", "Иванов"), ("3", "Иванов"), ("4", "")]


# ------------------------------------------------------------ SQLite journals


@pytest.fixture
def journal(tmp_path):
    folder = tmp_path / "Base1" / "1Cv8Log"
    folder.mkdir(parents=True)
    path = str(folder / "1Cv8.lgd")
    db = sqlite3.connect(path)
    db.executescript("""
        CREATE TABLE UserCodes (code INTEGER PRIMARY KEY, name TEXT, uuid BLOB);
        INSERT INTO UserCodes VALUES (1, 'Кладовщик', x'0a1b2c3d4e5f60718293a4b5c6d7e8f9'), (2, NULL, 'own-uuid');
        CREATE TABLE AppCodes (code INTEGER PRIMARY KEY, name TEXT);
        INSERT INTO AppCodes VALUES (1, '1CV8C');
        CREATE TABLE EventCodes (code INTEGER PRIMARY KEY, name TEXT);
        INSERT INTO EventCodes VALUES (1, '_$Session$_.Start'), (2, '_$Transaction$_.Begin');
        CREATE TABLE MetadataCodes (code INTEGER PRIMARY KEY, name TEXT);
        INSERT INTO MetadataCodes VALUES (1, 'Справочник.Склады'), (2, 'Документ.Заказ');
        CREATE TABLE EventLog (rowID INTEGER PRIMARY KEY, severity INTEGER, date INTEGER, connectID INTEGER, session INTEGER, transactionStatus INTEGER, transactionID INTEGER, userCode INTEGER, appCode INTEGER, eventCode INTEGER, comment TEXT, dataPresentation TEXT, metadataCodes TEXT);
        INSERT INTO EventLog VALUES (1, 0, 639398532100000, 301, 77, 1, 555, 1, 1, 1, 'начало', 'p', '1'), (2, 2, 639398532100000, 302, 77, 2, 556, 2, 7, 9, 'сбой', 'q', '[1, 2, 5]'),
            (3, 0, 639399396100000, NULL, NULL, 0, NULL, NULL, NULL, 2, NULL, NULL, NULL), (4, 9, NULL, 1, 1, 3, 5, 5, 1, 1, 'a', '', 'word');
    """)
    db.commit()
    yield path, db
    db.close()


def test_sqlite_journal(spark, journal):
    path, _ = journal
    dims = sqlite_journal.read_journal(spark, [path], part="codes")
    rows = sqlite_journal.read_journal(spark, [path], rows_per_partition=1)
    assert rows.rdd.getNumPartitions() == 4
    one, two, three, four = lgd.decode_journal(rows, dims).orderBy("seq").collect()
    assert (one.Event, one.User, one.Application, one.Tran, one.Severity, one.Metadata) == ("Сеанс. Начало", "Кладовщик", "1CV8C", "X(555)", "Информация", "Справочник.Склады")
    assert one.UserUuid == "3d2c1b0a-5f4e-7160-8293-a4b5c6d7e8f9" and one.DateFormatted == "2027-03-05 14:20:10" and one.base == "Base1" and one.TransactionStatus == "Отменена"
    assert (two.User, two.UserUuid, two.Application, two.Event, two.Metadata, two.Tran, two.Severity) == ("User #2", "own-uuid", "App #7", "Event #9", "Справочник.Склады, Документ.Заказ, Meta #5", "R(556)", "Ошибка")
    assert (three.User, three.Session, three.Tran, three.TransactionDate, three.Comment) == ("", "", "-", None, "")
    assert (four.User, four.Metadata, four.Severity, four.DateTime, four.Tran) == ("User #5", "word", "Уровень 9", None, "InProc(5)")
    assert one.id.startswith("lgd_1_639398532100000_") and len({r.id for r in (one, two, three, four)}) == 4
    assert [r.seq for r in lgd.decode_journal(rows, dims, empty=False).orderBy("seq").collect()] == [1, 2, 4]
    ids = lambda **o: sorted(r.rowID for r in sqlite_journal.read_journal(spark, [path], **o).collect())
    assert ids(from_row=1) == [2, 3, 4] and ids(from_row=4) == [] and ids(newest=2) == [3, 4] and ids(date_from="2027-03-06") == [3] and ids(date_to="2027-03-05", date_from="2027-03-05") == [1, 2]
    assert sqlite_journal.read_journal(spark, [path], part="last").first()["last"] == 4
    assert sqlite_journal.read_journal(spark, [path + ".none"]).count() == 0


def test_sqlite_journal_stream(spark, journal, tmp_path):
    path, db = journal

    def run(name, **options):
        query = streams.start(sqlite_journal.stream_journal(spark, [path], **options).select("rowID"), lambda b, n: b.write.mode("append").json(f"{tmp_path}/{name}"), f"{tmp_path}/{name}-state")
        query.awaitTermination()
        return sorted(r.rowID for r in spark.read.schema("rowID long").json(f"{tmp_path}/{name}").collect()) if (tmp_path / name).exists() else []

    assert run("all") == [1, 2, 3, 4] and run("new", starting="latest") == []
    db.execute("INSERT INTO EventLog (rowID, date) VALUES (5, 639398532100000)")
    db.commit()
    assert run("all") == [1, 2, 3, 4, 5] and run("new", starting="latest") == [5]


def test_journal_filters_are_pushed_into_sqlite(spark, tmp_path):
    path = tmp_path / "1Cv8.lgd"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE EventLog (rowID INTEGER PRIMARY KEY, severity INT, date INT, connectID INT, session INT, transactionStatus INT, transactionID INT, userCode INT, appCode INT, eventCode INT, comment TEXT, dataPresentation TEXT, metadataCodes TEXT)")
        db.executemany("INSERT INTO EventLog (rowID, severity, date, session, comment) VALUES (?, ?, ?, ?, ?)", [(k, k % 4, 639230000000000 + k * 36_000_000, k % 3 or None, f"c{k}") for k in range(1, 101)])
    rows = sqlite_journal.read_journal(spark, [str(path)], rows_per_partition=30)
    assert lgd.date_units(dt.datetime(1, 1, 2)) == sqlite_journal.DAY_UNITS
    since = lgd.date_units(dt.datetime.fromordinal(639230000000000 // sqlite_journal.DAY_UNITS + 3))
    assert rows.count() == 100
    expected = sorted(r.rowID for r in rows.collect() if r.date >= since and r.severity in (1, 2) and r.session == 1 and r.rowID != 50 and r.comment != "c30")
    found = rows.filter((F.col("date") >= since) & F.col("severity").isin(1, 2) & (F.col("session") != 2) & (F.col("rowID") != 50) & (F.col("comment") != "c30"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter", 1)[1].split("\n")[0]
    assert "comment" in left and "date" not in left and "severity" not in left
    assert expected and sorted(r.rowID for r in found.collect()) == expected
    assert rows.filter("session IS NULL").count() == 33 and rows.filter("session IS NOT NULL AND session <=> 1").count() == 34


# ------------------------------------------------------------ growing files


def _append(path, text):
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.mark.parametrize("step", [1, 7, 40, 10_000])
def test_ranges_give_each_record_once(spark, tmp_path, monkeypatch, step):
    from logspark.sources import growing

    records = [f"{k:02d}:00.000001-5,CALL,1,Context='строка {k}\n  вторая'" for k in range(20)]
    _append(tmp_path / "a.log", "﻿" + "\r\n".join(records).replace("\n  ", "\r\n  ") + "\r\n")
    options = growing._Options({"path": str(tmp_path), "kind": "techlog", "range_bytes": str(step)})
    monkeypatch.setattr(growing, "STEP", 64)
    parts = growing._Reader(options).partitions()
    got = [x for p in parts for b in options.read(p) for x in b.column("raw").to_pylist()]
    assert sorted(got) == records


def test_growing_logs(spark, tmp_path):
    from logspark.sources import growing

    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    path, journal = logs / "x.log", logs / "y.lgp"

    def run(kind, name=None, **options):
        name = name or kind
        query = streams.start(growing.stream_log(spark, str(logs), kind, **options), lambda b, n: b.write.mode("append").json(f"{out}/{name}"), f"{out}/{name}-state")
        query.awaitTermination()
        return sorted(r.raw for r in spark.read.schema("raw string").json(f"{out}/{name}").collect()) if (out / name).exists() else []

    _append(path, "00:01.000000-5,CALL,1,Context='a\r\nb'\r\n00:02.000000-7,EXCP,0,descr=unfin")
    _append(journal, '{20260831000441,C,{0,0},"a}"},\n{20260831000442,C,{0,0},"open ')
    assert run("techlog") == ["00:01.000000-5,CALL,1,Context='a\nb'"]
    assert run("eventlog") == ['{20260831000441,C,{0,0},"a}"},'] and run("techlog", "late", starting="latest") == []
    _append(path, "ished\r\n")
    _append(journal, '}"},\n{5,0,"Inline",9},\n')
    assert run("techlog")[1:] == ["00:02.000000-7,EXCP,0,descr=unfinished"] and run("techlog", "late", starting="latest") == ["00:02.000000-7,EXCP,0,descr=unfinished"]
    assert run("eventlog")[1:] == ['{20260831000442,C,{0,0},"open }"},', '{5,0,"Inline",9},']
    path.write_text("00:03.000000-5,CALL,1,a=b\n", encoding="utf-8")  # rotated: shorter than before
    assert run("techlog")[2:] == ["00:03.000000-5,CALL,1,a=b"]
    assert run("techlog")[2:] == ["00:03.000000-5,CALL,1,a=b"]
    tail = growing.read_log(spark, str(journal), "eventlog", tail_bytes=30).collect()
    assert [r.raw for r in tail] == ['{5,0,"Inline",9},'] and growing.tail_bytes(1) == 10 << 20 and growing.tail_bytes(None) == 50 << 20


def test_dates_are_pushed_into_the_log_reader(spark, tmp_path, monkeypatch):
    from logspark.operators.eventlog import decode_eventlog
    from logspark.sources import growing

    record = lambda day, hour, k: f'{{202608{day:02d}{hour:02d}0000,N,{{0,0}},0,0,0,{k},0,I,"n{k}",0,{{"U"}},"",0,0,0,{k},0}},\n'
    rows = [(day, hour) for day in range(1, 29) for hour in range(24)]
    _append(tmp_path / "a.lgp", "".join(record(day, hour, k) for k, (day, hour) in enumerate(rows)))
    log = growing.read_log(spark, str(tmp_path), "eventlog", range_bytes=2000)
    wanted = log.filter("DateTime >= timestamp'2026-08-10 05:00:00' AND DateTime < timestamp'2026-08-11 00:00:00' AND at > 10")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "at#" in plan.split("Filter", 1)[1].split("\n")[0] and "DateTime" not in plan.split("Filter", 1)[1].split("\n")[0]  # what is left for Spark
    got = wanted.collect()
    assert sorted((r.DateTime.day, r.DateTime.hour) for r in got) == [(10, h) for h in range(5, 24)]
    assert [r.raw for r in log.filter("DateTime = timestamp'2026-08-28 23:00:00'").collect()] == [record(28, 23, len(rows) - 1).strip()]
    dims = spark.createDataFrame([], "base string, kind string, code string, name string, uuid string")
    decoded = decode_eventlog(log.selectExpr("'' base", "at seq", "file", "size", "DateTime", "raw"), dims, where=F.col("DateTime") < "2026-08-01 03:00:00")
    assert sorted(r.Comment for r in decoded.collect()) == ["n0", "n1", "n2"]

    opened = []
    options = growing._Options({"path": str(tmp_path), "kind": "eventlog", "range_bytes": "2000"})
    real = options.files.open
    monkeypatch.setattr(options.files, "open", lambda path: opened.append(path) or real(path))
    options.span = growing.Span(first=growing.record_date("eventlog", "", "{20260810000000,"), last=growing.record_date("eventlog", "", "{20260810230000,"), known=True)
    read = {}
    for part in growing._Reader(options).partitions():
        opened.clear()
        read[part.start] = (sum(b.num_rows for b in options.read(part)), len(opened))
    assert sum(n for n, _ in read.values()) == 24
    far = [opens for n, opens in read.values() if not n]
    assert len(far) > 15 and max(far) <= 4  # a look at what stands at its ends, no reading


def test_span():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThan, LessThanOrEqual

    from logspark.sources.growing import LATE, Span

    day = [dt.datetime(2026, 8, d, tzinfo=dt.UTC) for d in range(1, 9)]
    span = Span()
    assert span.has(None) and not span.add(EqualTo(("at",), 5)) and not span.add(EqualTo(("DateTime",), None))
    assert span.add(IsNotNull(("DateTime",))) and not span.has(None)
    assert all(span.add(f) for f in (GreaterThan(("DateTime",), day[1]), LessThanOrEqual(("DateTime",), day[6]), LessThan(("DateTime",), day[5]), LessThanOrEqual(("DateTime",), day[5])))
    assert [span.has(d) for d in day] == [False, False, True, True, True, False, False, False]
    assert span.passed(day[5] + LATE + dt.timedelta(seconds=1)) and not span.passed(day[5] + LATE) and span.ahead(day[0]) and not span.ahead(day[1])


def subtree(path):
    """A file system of its own scheme: shop://folder is the folder below the one that the variable names."""
    from pyarrow import fs

    return fs.SubTreeFileSystem(os.environ["LOGSPARK_TEST_SHOP"], fs.LocalFileSystem()), path.removeprefix("shop://")


def test_logs_on_another_file_system(spark, tmp_path, monkeypatch):
    from logspark.sources import growing
    from logspark.sources.files import Files

    (tmp_path / "logs").mkdir()
    _append(tmp_path / "logs" / "26083114.log", "00:01.000000-5,CALL,1,a=b\n00:02.000000-5,CALL,1,a=c\n")
    monkeypatch.setenv("LOGSPARK_TEST_SHOP", str(tmp_path))
    options = growing._Options({"path": "shop://logs", "kind": "techlog", "resolver": f"{__name__}:subtree", "range_bytes": "10"})
    assert [f.path for f in options.files.list(options.roots, "*.log")] == ["shop://logs/26083114.log"]
    got = [(r["file"], r["DateTime"].second, r["raw"]) for p in growing._Reader(options).partitions() for b in options.read(p) for r in b.to_pylist()]
    assert got == [("shop://logs/26083114.log", 1, "00:01.000000-5,CALL,1,a=b"), ("shop://logs/26083114.log", 2, "00:02.000000-5,CALL,1,a=c")]
    assert growing.read_log(spark, f"file://{tmp_path}/logs", "techlog").count() == 2
    assert Files().info(str(tmp_path / "none")) is None and not list(Files().list([f"{tmp_path}/none"], "*"))


def test_rotation_by_identity_and_unchanged_files(spark, tmp_path, monkeypatch):
    """A file replaced by a longer one is read anew; files that did not change are not opened."""
    from logspark.sources import growing

    for k in range(5):
        _append(tmp_path / f"f{k}.log", f"00:0{k}.000000-5,CALL,1,a=b\n")
    reader = growing._StreamReader(growing._Options({"path": str(tmp_path), "kind": "techlog"}))
    first = reader.latestOffset()
    opened = []
    real = reader.options.files.open
    monkeypatch.setattr(reader.options.files, "open", lambda path: opened.append(os.path.basename(path)) or real(path))
    assert reader.latestOffset() == first and not opened
    _append(tmp_path / "f1.log", "00:09.000000-5,CALL,1,a=c\n")
    (tmp_path / "f2.log").write_text("".join(f"10:0{k}.000000-5,EXCP,1,a=new\n" for k in range(6)), encoding="utf-8")
    second = reader.latestOffset()
    assert set(opened) == {"f1.log", "f2.log"}
    again = growing._StreamReader(growing._Options({"path": str(tmp_path), "kind": "techlog"}))  # as after a restart
    parts = {os.path.basename(p.path): p for p in again.partitions(first, second)}
    assert set(parts) == {"f1.log", "f2.log"} and parts["f1.log"].start == first[f"{tmp_path}/f1.log"]["end"] and parts["f2.log"].start == 0
    assert sum(b.num_rows for b in again.read(parts["f2.log"])) == 6
    _append(tmp_path / "noise.log", "no record starts here\n" * 3)
    assert reader.latestOffset()[f"{tmp_path}/noise.log"]["end"] == 0


# ------------------------------------------------------------ dumps, state


def test_ring_of_dumps(spark, rows, tmp_path):
    ring = delivery.Ring(str(tmp_path / "ring"), slots=2, max_records=8)
    counts = lambda: [(p["slot"], p["rows"], p["batch"]) for p in ring.manifest(spark)]
    folders = lambda: sorted(p.name for p in (tmp_path / "ring").iterdir())
    ring(rows, 0)  # one of six rows has no event
    ring(rows, 1)
    assert counts() == [(0, 5, 0), (0, 3, 1), (1, 2, 1)]  # full at its limit
    ring(rows, 1)  # delivered again
    assert counts() == [(0, 5, 0), (0, 3, 1), (1, 2, 1)] and ring.read(spark, COLUMNS).count() == 10
    ring(rows, 2)
    ring(rows, 3)  # both slots are full: the oldest goes
    assert counts() == [(1, 2, 1), (1, 5, 2), (1, 1, 3), (0, 4, 3)]
    assert folders() == sorted(p["folder"] for p in ring.manifest(spark))
    assert ring.read(spark, COLUMNS).count() == spark.read.json(str(tmp_path / "ring" / "*")).count() == 12
    before = folders()
    (tmp_path / "ring" / "slot-1-9-batch4").mkdir()  # what a batch that died has left isn't seen
    assert ring.read(spark, COLUMNS).count() == 12
    ring(rows.filter("id = 'none'"), 5)
    assert folders() == before


def test_one_batch_fills_several_slots(spark, tmp_path):
    many = spark.range(1000).selectExpr("cast(id as string) id", "timestamp'2026-09-11 10:00:00' DateTime", "'e' Event", "repeat('x', cast(id % 7 as int)) User")
    by_rows = delivery.Ring(str(tmp_path / "rows"), slots=9, max_records=333)
    by_rows(many, 0)
    assert [(p["slot"], p["rows"]) for p in by_rows.manifest(spark)] == [(0, 333), (1, 333), (2, 333), (3, 1)]
    by_size = delivery.Ring(str(tmp_path / "size"), slots=9, max_bytes=20_000, policy="Size")
    by_size(many, 0)
    parts = by_size.manifest(spark)
    assert sum(p["rows"] for p in parts) == 1000 and all(20_000 - 200 < p["bytes"] < 20_000 + 200 for p in parts[:-1]) and len(parts) > 3
    files = {p["folder"]: sum(len(line) + 1 for f in (tmp_path / "size" / p["folder"]).glob("*.txt") for line in f.read_text().splitlines()) for p in parts}
    assert files == {p["folder"]: p["bytes"] for p in parts}
    small = delivery.Ring(str(tmp_path / "small"), slots=3, max_records=100)
    small(many, 0)  # ten slots' worth: the last three stay
    assert [(p["slot"], p["rows"]) for p in small.manifest(spark)] == [(1, 100), (2, 100), (0, 100)]


@pytest.fixture
def store():
    """A server that keeps rows by token or id, and loses the answer to some requests after it has kept their rows."""
    kept, told, lose = {}, [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            told.append(self.path)
            if self.path.endswith("_bulk"):
                lines = body.splitlines()
                ids = [json.loads(x)["index"]["_id"] for x in lines[::2]]
                kept.update({i: row for i, row in zip(ids, lines[1::2], strict=True) if "bad" not in row})
                answer = {"items": [{"index": {"_id": i, "status": 400 if "bad" in row else 201, "error": "no"}} for i, row in zip(ids, lines[1::2], strict=True)]}
            else:
                kept.setdefault(self.path.split("token=")[1], body.splitlines())
                answer = {}
            fails = bool(lose) and lose.pop()
            self.send_response(503 if fails else 200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", kept, told, lose
    http.shutdown()


def test_sink_doubles_nothing_when_answers_are_lost(spark, store, tmp_path):
    from logspark.sinks import log_sink

    url, kept, told, lose = store
    lose += [True, False, True, False]
    log_sink.register(spark)
    many = spark.range(95).repartition(3).selectExpr("cast(id as string) id", "timestamp'2026-09-11 10:00:00' DateTime", "'e' Event")
    delivery.shaped(many).write.format("log_sink").options(url=url, database="d", table="t", chunk_rows=10, pause=0.01, report=f"{tmp_path}/said").mode("append").save()
    rows = [json.loads(x)["id"] for lines in kept.values() for x in lines]
    assert sorted(rows, key=int) == [str(i) for i in range(95)]
    said = json.loads((tmp_path / "said" / "write.json").read_text())
    assert said["rows"] == 95 and said["repeated"] == 2 and said["refused"] == 0 and len(told) == said["chunks"] + 2


def test_sink_tells_refused_rows(spark, store, tmp_path):
    from logspark.sinks import log_sink

    url, kept, told, lose = store
    log_sink.register(spark)
    many = spark.range(40).selectExpr("cast(id as string) id", "timestamp'2026-09-11 10:00:00' DateTime", "if(id in (7, 8), 'bad', 'e') Event")
    write = lambda **more: delivery.shaped(many, "events").write.format("log_sink").options(target="elastic", url=url, chunk_rows=7, report=f"{tmp_path}/said", **more).mode("append").save()
    with pytest.raises(Exception, match="2 of 40 rows were refused"):
        write()
    write(refused=2)
    said = json.loads((tmp_path / "said" / "write.json").read_text())
    assert (said["rows"], said["refused"]) == (38, 2) and sorted(x[0] for x in said["named"]) == ["7", "8"] and len(kept) == 38
    with pytest.raises(Exception, match="400|Bad|HTTP|target"):
        delivery.shaped(many).write.format("log_sink").options(target="other").mode("append").save()


def test_stream_into_the_sink(spark, store, tmp_path):
    from logspark.sinks import log_sink

    url, kept, told, lose = store
    log_sink.register(spark)
    source = tmp_path / "in"
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).selectExpr("cast(id as string) id", "timestamp'2026-09-11 10:00:00' DateTime", "'e' Event").coalesce(1).write.mode("append").json(str(source))
        lose[:] = [False, True]
        stream = streams.stream_ndjson(spark, str(source), "id string, DateTime timestamp, Event string")
        query = delivery.shaped(stream).writeStream.format("log_sink").options(url=url, pause=0.01, report=f"{tmp_path}/said", checkpointLocation=f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((json.loads(x)["id"] for lines in kept.values() for x in lines), key=int) == [str(i) for i in range(20)]
    assert [json.loads((tmp_path / "said" / f"batch-{k}.json").read_text())["rows"] for k in range(2)] == [10, 10]


def test_ring_limits():
    by_size = delivery.Ring("y", policy="Size", total_bytes=600 << 20, slots=30)
    assert by_size.bytes == 20 << 20 and by_size.full(20 << 20, 0) and not by_size.full(1, 10**9) and delivery.Ring("x").bytes == 16 << 20
    assert delivery.Ring("x", policy="RecordCount", max_records=3).full(0, 3)


def test_retention(spark, tmp_path):
    for k, name in enumerate(["a.json", "b.jsonl", "c.json", "d.txt", "old.tmp", "new.tmp"]):
        (tmp_path / name).write_text("x" * 100)
        os.utime(tmp_path / name, (time.time() - 500 + k, time.time() - 500 + k) if name != "new.tmp" else None)
    assert delivery.retain(spark, str(tmp_path), limit=2) == ["old.tmp", "a.json"]
    assert delivery.retain(spark, str(tmp_path), limit=9, total_bytes=150) == ["b.jsonl"] and (tmp_path / "d.txt").exists() and (tmp_path / "new.tmp").exists()


def test_pretty_and_ping(spark, rows, tmp_path, server):
    delivery.write_pretty(rows.limit(1), str(tmp_path / "p"))
    text = "".join(p.read_text() for p in (tmp_path / "p").glob("part*"))
    assert json.loads(text)["id"] == "i0" and "\n  " in text
    url, seen = server
    assert delivery.ping(url) == "{}" and seen[-1][1] == "SELECT version()"


def test_dedup_of_the_last_rows(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        stream = streams.deduplicated_last(streams.stream_ndjson(spark, str(source), "id string, n long"), last=6, parts=1)
        streams.start(stream, lambda b, k: b.write.mode("append").json(str(out)), str(tmp_path / "state")).awaitTermination()
        return sorted(r.n for r in spark.read.schema("id string, n long").json(str(out)).collect())

    write = lambda name, ids, first: (source / name).write_text("".join(json.dumps({"id": i, "n": first + k}) + "\n" for k, i in enumerate(ids)))
    write("1.json", "abca", 0)
    assert len(run()) == 3
    write("2.json", "adef", 10)
    assert [n for n in run() if n >= 10] == [11, 12, 13]  # a is among the last six
    write("3.json", "ghia", 20)
    assert [n for n in run() if n >= 20] == [20, 21, 22]
    write("4.json", "ab", 30)
    assert [n for n in run() if n >= 30] == [30, 31]  # forgotten: six others came since


def test_reloaded_dictionary():
    loads, stamp = [], ["1"]
    get = streams.reloaded(lambda: loads.append(1) or len(loads), lambda: stamp[0])
    assert (get(), get()) == (1, 1)
    stamp[0] = "2"
    assert (get(), len(loads)) == (2, 2)
