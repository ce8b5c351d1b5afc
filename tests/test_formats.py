"""Log formats: known inputs and outputs."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logspark.functions import dates, ids, scan, text
from logspark.operators import eventlog, lgd, query, repeats, techlog
from logspark.plans import catalog
from logspark.sources import framing, jsondump


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def techlog_rows(spark, *raw, **options):
    rows = [(r, dt.datetime(2026, 7, 30, 8), "rphost", "9000") for r in raw]
    return techlog.decode_techlog(spark.createDataFrame(rows, "raw string, hour timestamp, process string, pid string"), **options).collect()


def test_techlog_record(spark):
    (r,) = techlog_rows(spark, "23:48.384002-31985,DBMSSQL,5,p:processName=DemoDb,t:clientID=27,t:applicationName=WebServerExtension,t:connectID=48187,Usr=Администратор,Context='HTTPСервис.API.Модуль : 125'")
    assert (r.DateFormatted, r.Duration, r.DurationMs, r.DurationSec, r.DurationFormatted) == ("2026-07-30 08:23:48.384", 31985, 31.985, 0.031985, "31.98 ms")
    assert (r.Level, r.User, r.ClientId, r.ConnectId, r.Application, r.Context, r.ProcessName) == (5, "Администратор", "27", "48187", "WebServerExtension", "HTTPСервис.API.Модуль : 125", "rphost")
    assert r.SessionId == "27" and r.Properties == {"p_processName": "DemoDb"}


def test_techlog_quotes_and_noise(spark):
    rows = techlog_rows(
        spark, "00:00.000000-0,VCLIENT,0,process=1cv8", "00:00.000000-15000,DBMSSQL,0,process=1cv8,Sql='SELECT ''1''", "00:00.000000-0,excp,1,descr='a\n\tb',Usr=,user=second,USR2=x", "no record"
    )
    assert [r.Event for r in rows] == ["DBMSSQL", "EXCP"]
    assert rows[0].Sql == "SELECT '1'" and rows[1].Descr == "a\n  b" and rows[1].User == "second" and set(rows[1].Properties) == {"USR2"}
    assert len(techlog_rows(spark, "00:00.000000-0,VCLIENT,0,process=1cv8", empty=True)) == 1


@pytest.fixture(scope="module")
def dims(spark):
    entries = ['{1,0,"Администратор",1}', '{1,aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee,"Иванов И.И.",2}', '{2,"WS-TEST-01",10}', '{3,"HTTPServiceConnection",1}', '{3,"BackgroundJob",2}', '{4,"_$Session$_.Start",1}', '{4,"_$Data$_.Post",3}', '{4,"_$Session$_.Authentication",4}', '{5,0,"Справочник.Номенклатура",1}', '{5,ab7a0050-56bb-e0b4-11f1-61f9d05bdec1,"Документ.X",45}', '{6,"SRV-1C-01",1}', '{7,1560,3}', '{4,"",3}']
    return eventlog.decode_dictionary(spark.createDataFrame(list(enumerate(entries)), "at long, raw string"), F.lit("b"))


def eventlog_rows(spark, dims, *raw):
    records = spark.createDataFrame([("b", i, r) for i, r in enumerate(raw)], "base string, seq long, raw string")
    return sorted(eventlog.decode_eventlog(records, dims).collect(), key=lambda r: r.seq)


def test_dictionary(dims):
    names = {(r.kind, r.code): r.name for r in dims.collect()}
    assert names[("event", "3")] == "_$Data$_.Post" and names[("port", "3")] == "1560" and names[("user", "2")] == "Иванов И.И."


def test_eventlog_layouts(spark, dims):
    new, listed, old = eventlog_rows(
        spark, dims, '{20260831000441,C,\n{2456209139090,9568c},1,10,1,40499,3,I,"Выполнено, Получение данных",45,\n{"U"},"Реализация №123",1,1,1,19571,0}',
        '{20260831000442,U,{0,0},2,10,1,7,1,E,"a ""q"" b",{1,45},{"R",45:ab7a005056bbe0b411f161f9d05bdec1},"<?>; Товар №12345; Код-001; ",1,3,0,5,0}',
        '{20260817123045,N,{0,0},9,10,1,3,I,"Успешный вход ""x""",0,{"S","x,y"},"",1,1,0,12345}',
    )
    assert (new.Tran, new.TransactionStatus, new.Event, new.Connection, new.Session, new.TransactionNumber) == ("C(2456209139090,9568c)", "Зафиксирована", "Данные. Проведение", "40499", "19571", 611980)
    assert new.TransactionDate == dt.datetime(2026, 8, 31, 0, 4, 41) and new.Data == "(без объектной ссылки)" and new.Comment == "Выполнено, Получение данных"
    assert (listed.Metadata, listed.Data, listed.DataPresentation, listed.MainPort) == ("Справочник.Номенклатура, Документ.X", "Ссылка: Документ.X ab7a0050-56bb-e0b4-11f1-61f9d05bdec1", "Товар №12345; Код-001", "1560")
    assert (old.User, old.Session, old.DateFormatted, old.Comment, old.Data) == ("User #9", "12345", "2026-08-17 12:30:45", 'Успешный вход "x"', "x,y")


def test_authentication_and_background(spark, dims):
    auth, job = eventlog_rows(
        spark, dims, '{20260817123045,N,{0,0},0,10,1,3,4,I,"",0,{"P",{1,{"S","TESTDOMAIN\\test-account$"}}},"",1,1,0,7,0}', '{20260817123045,N,{0,0},0,10,2,3,3,I,"",0,{"U"},"",1,1,0,7,0}'
    )
    assert auth.User == auth.Data == "TESTDOMAIN\\test-account$" and auth.DataPresentation == "Пользователь ОС: TESTDOMAIN\\test-account$"
    assert job.User == "Фоновое задание" and job.Data == ""


@pytest.mark.parametrize(("value", "shown"), [('{"B",1}', "Истина"), ('{"B",0}', "Ложь"), ('{"N",42.5}', "42.5"), ('{"S","x"}', "x"), ('{"D",20260817143000}', "2026-08-17 14:30:00")])
def test_data_values(spark, value, shown):
    assert one(spark, eventlog.decode_data(F.lit(value), F.lit(None).cast("string"))) == shown


@pytest.mark.parametrize(("size", "shown"), [(0, "0 B"), (500, "500 B"), (2048, "2.0 KB"), (10485760, "10.00 MB"), (10737418240, "10.00 GB")])
def test_sizes(spark, size, shown):
    assert one(spark, text.format_size(F.lit(size))) == shown


def test_texts(spark):
    assert one(spark, text.single_line(F.lit("первая\r\nвторая\n\n\tтретья\rчетвёртая"))) == "первая вторая третья четвёртая"
    assert one(spark, text.sanitize_text(F.lit("A" * 1500), 1000)).endswith("[TRUNCATED: 1500 -> 1000 chars]")
    cut = one(spark, text.truncate_base64(F.lit("x " + "A" * 500 + " y")))
    assert "Двоичные данные Base64: 500 симв." in cut and len(cut) < 200 and cut.endswith(" y")


@pytest.mark.parametrize(
    ("given", "wanted"), [("00:14", (0, 14, 0)), ("04.05", (4, 5, 0)), ("4.5", (4, 5, 0)), ("4", (4, 0, 0)), ("405", (4, 5, 0)), ("1613", (16, 13, 0)), ("161350", (16, 13, 50)), ("16:", (16, 0, 0)), ("23:59:59", (23, 59, 59))]
)
def test_time_inputs(given, wanted):
    assert dates.parse_time(given) == dt.time(*wanted)


@pytest.mark.parametrize("given", ["24:00", "12:60", "1234567", "12:345", "16:13:50.x", "-1:00"])
def test_bad_times(given):
    assert dates.parse_time(given) is None


def test_full_dates():
    assert dates.parse_time("2026-08-17 16:13") == dates.parse_time("17.08.2026 16:13") == dt.datetime(2026, 8, 17, 16, 13)
    assert dates.date_range(dt.date(2026, 9, 4), dt.date(2026, 9, 3)) == (dt.date(2026, 9, 3), dt.date(2026, 9, 4))


def test_record_ids(spark):
    same = [one(spark, ids.record_id(F.lit(t), F.lit("s"))) for t in ("a\nb", "a\r\nb", " a\nb ")]
    assert len(set(same)) == 1 and len(same[0]) == 32 and one(spark, ids.record_id(F.lit("a\nb"))) != same[0]


def test_framing_over_splits_equals_whole(spark):
    raw = ["{20260831000441,C,", '{0,0},1,"a {20260831 "" b",', "x}", "{20260831000442,C,{0,0}}", "", "{20260831000443,C,", "tail}"]
    for size in (1, 2, 3, 10):
        lines = spark.createDataFrame([("f", 1, i // size, i, x) for i, x in enumerate(raw)], "file string, size long, split long, at long, line string")
        got = [r.raw for r in framing.frame(lines, framing.EVENTLOG_START).orderBy("split", "at").collect()]
        assert got == ["\n".join(raw[:3]), raw[3], "\n".join(raw[5:])], size


def test_files_of_records(spark, tmp_path):
    (tmp_path / "rphost_1234").mkdir()
    (tmp_path / "rphost_1234" / "26083114.log").write_text("﻿00:01.000000-5,CALL,1,Context='a\r\nb'\r\n00:02.000000-7,EXCP,0,descr=x\n", encoding="utf-8")
    rows = techlog.decode_techlog(techlog.file_place(framing.read_techlog_records(spark, str(tmp_path)))).orderBy("DateTime").collect()
    assert [(r.DateFormatted, r.Event, r.ProcessName, r.ProcessId) for r in rows] == [("2026-08-31 14:00:01.000", "CALL", "rphost", "1234"), ("2026-08-31 14:00:02.000", "EXCP", "rphost", "1234")]
    assert rows[0].Context == "a\nb"


def test_techlog_columns(spark):
    """Columns of the header need no body; which rows are empty does not depend on the columns."""
    raw = ["00:01.000000-5,CALL,1,Context='a',SessionID=7", "00:02.000000-0,CALL,0,x=1", "00:03.000000-0,EXCP,0,Descr=d,Usr=u", "00:04.000000-0,CALL,2,x=1", "00:05.000000-9,SDBL,0,p=q"]
    records = spark.createDataFrame([(r,) for r in raw], "raw string").selectExpr("raw", "timestamp'2026-08-31 14:00:00' hour", "'rphost' process", "'1' pid")
    for empty in (False, True):
        whole = sorted(tuple(r) for r in techlog.decode_techlog(records, empty).select("Event", "DurationMs", "DateFormatted").collect())
        assert sorted(map(tuple, techlog.decode_techlog(records, empty, columns=["Event", "DurationMs", "DateFormatted"]).collect())) == whole and len(whole) == (5 if empty else 4)
        for columns in (["SessionId", "User"], ["Properties"], ["Context", "ProcessId"], ["id"]):
            assert sorted(map(str, techlog.decode_techlog(records, empty, columns=columns).collect())) == sorted(map(str, techlog.decode_techlog(records, empty).select(*columns).collect())), columns
    assert "MapInArrow" not in techlog.decode_techlog(records, True, columns=["Event"])._jdf.queryExecution().executedPlan().toString()


def test_json_shapes(spark, tmp_path):
    records = [{"id": c, "DateFormatted": "2026-01-01 00:00:00", "Date": "2026-01-01 00:00:00.250", "Event": f"e {{{c}", "Id": c} for c in "abcd"]
    shapes = {
        "lines": ("lines", "\n".join(["{broken", *map(json.dumps, records), ""])), "array": ("lines", "[" + ",\n".join(map(json.dumps, records)) + "]"), "pretty": ("pretty", json.dumps(records, indent=2)),
        "hits": ("whole", json.dumps({"hits": {"hits": [{"_source": r} for r in records]}})), "wrapped": ("whole", json.dumps({"meta": [], "data": records})),
    }
    for name, (shape, body) in shapes.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(body, encoding="utf-8")
        rows = jsondump.read_dump(spark, str(tmp_path / name), "eventlog", shape).collect()
        assert sorted(r.id for r in rows) == list("abcd"), name
        assert rows[0].DateTime == dt.datetime(2026, 1, 1, 0, 0, 0, 250000)
    (tmp_path / "u16").mkdir()
    (tmp_path / "u16" / "x.json").write_bytes("﻿".encode("utf-16-le") + json.dumps(records).encode("utf-16-le"))
    assert jsondump.read_dump(spark, str(tmp_path / "u16"), "eventlog", "whole").count() == 4


def test_json_of_any_shape_loses_nothing(spark, tmp_path):
    """Records on one line, in arrays, wrapped, pretty, with braces and quotes in texts: found alike however small the splits are."""
    record = lambda c, **more: {"id": c, "DateFormatted": "2026-01-01 00:00:00", "Event": 'a "{" \\ }' + c, **more}
    one, two, three, four, five, six = (record(c) for c in "123456")
    bodies = {
        "line": f"{json.dumps(one)}{json.dumps(two)}\n[{json.dumps(three)},{json.dumps(four)}]\n{json.dumps(five)}\n", "pretty": json.dumps([one, {"w": [two, {"x": three}]}, four], indent=4) + json.dumps(five),
        "late": json.dumps({"kids": [six, six], **five}) + "\n" + "\n".join(map(json.dumps, (one, two, three, four))), "nulls": json.dumps({"id": None, "DateFormatted": "x", "in": [one, two]}) + json.dumps([[three], [[four]], five]),
        "broken": '{"id": "0", "DateFormatted": "cut \n' + "\n".join(map(json.dumps, (one, two, three, four, five))), "empty": "",
    }
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("3b", "40b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            for name, body in bodies.items():
                (tmp_path / name).mkdir(exist_ok=True)
                (tmp_path / name / "x.json").write_text(body, encoding="utf-8")
                if size == "3b" and name != "line":
                    continue
                rows = jsondump.read_dump(spark, str(tmp_path / name), "eventlog").select("id", "Event").collect()
                assert sorted(map(tuple, rows)) == ([(r["id"], r["Event"]) for r in (one, two, three, four, five)] if name != "empty" else []), (name, size)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    both = jsondump.read_dump(spark, [str(tmp_path / n) for n in ("line", "pretty")], "eventlog")
    assert both.count() == 10
    (tmp_path / "line" / "wide.json").write_bytes(json.dumps([six, [six]]).encode("utf-16"))
    assert jsondump.read_dump(spark, str(tmp_path / "line"), "eventlog").count() == 7


def test_json_lines_with_several_objects(spark):
    record = lambda c: json.dumps({"id": c, "DateFormatted": "d", "Event": "} {"})
    lines = [record("1") + record("2"), f"[{record('3')},{record('4')}]", record("5"), "{broken", "", None, f"[{record('6')}], [{record('7')}]"]
    got = jsondump.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "eventlog")
    assert sorted(r.id for r in got.collect()) == list("1234567")


def test_collapse(spark):
    def row(i, s, meta="m", event="e", user="u"):
        return (i, f"{i}", dt.datetime(2026, 1, 1, 0, 0, s % 60) + dt.timedelta(minutes=s // 60), meta, event, user, user, 1)

    rows = spark.createDataFrame([row(1, 1), row(2, 5), row(3, 59), row(4, 61), row(5, 2, event="x"), row(6, 2, user="v"), row(7, 2, meta=""), row(8, 2, meta="")], "seq long, id string, DateTime timestamp, MetadataUuid string, Event string, UserUuid string, User string, RepeatCount int")
    got = {r.id: r.RepeatCount for r in repeats.collapse_repeats(rows).collect()}
    assert got == {"1": 3, "4": 1, "5": 1, "6": 1, "7": 1, "8": 1}


def test_session_user(spark):
    rows = [("b", 1, "s", "Сеанс. Начало", "Иванов", "u"), ("b", 2, "s", "e", "User #1", ""), ("b", 3, "s", "Сеанс. Завершение", "", ""), ("b", 4, "s", "e", "", ""), ("b", 5, "", "e", "", "")]
    got = eventlog.carry_session_user(spark.createDataFrame(rows, "base string, seq long, Session string, Event string, User string, UserUuid string")).collect()
    assert {r.seq: r.User for r in got} == {1: "Иванов", 2: "Иванов", 3: "Иванов", 4: "", 5: ""}


def test_search_and_profiles(spark):
    assert query.parse_search('a, !b "c:d" -e НЕ:слово') == [(False, None, "a"), (True, None, "b"), (False, "c", "d"), (True, None, "e"), (True, None, "слово")]
    spec = query.FilterSpec(search="x", date_from=dt.date(2026, 1, 1), time_from=dt.time(8), time_to=dt.datetime(2026, 1, 2, 3), include={"User": ["a"]})
    assert query.FilterSpec.from_json(spec.to_json()) == spec


def test_file_pruning(spark):
    days = [dt.date(2026, 8, d) for d in (10, 17, 24, 31)]
    files = spark.createDataFrame([("d", f"d/{d:%Y%m%d}000000.lgp", d) for d in days] + [("d", "d/1Cv8.lgd", None)], "directory string, path string, day date")
    kept = lambda a, b: sorted(r.path for r in catalog.prune_by_date(files, a, b, by=["directory"]).collect())
    assert kept(dt.date(2026, 9, 3), dt.date(2026, 9, 4)) == ["d/1Cv8.lgd", "d/20260831000000.lgp"]
    assert kept(dt.date(2026, 8, 20), dt.date(2026, 8, 25)) == ["d/1Cv8.lgd", "d/20260817000000.lgp", "d/20260824000000.lgp"]


def test_discovery(spark):
    when = dt.datetime(2026, 8, 31, 14, 30)
    files = spark.createDataFrame([("/b/1Cv8Log/20260831000000.lgp", 1, when), ("/b/1Cv8Log/1Cv8.lgd", 1, when), ("/b/1Cv8FTxt/x.lgp", 1, when), ("/b/special.txt", 1, when)], "path string, size long, modified timestamp")
    assert {(r.path, r.base) for r in catalog.find_eventlog(files).collect()} == {("/b/1Cv8Log/20260831000000.lgp", "b"), ("/b/1Cv8Log/1Cv8.lgd", "b")}
    assert [r.path for r in catalog.find_eventlog(files, "SPECIAL.txt").collect()] == ["/b/special.txt"]
    assert catalog.find_eventlog(files, "none.lgp").count() == 2
    assert catalog.given_journal("/b/x.lgx") == ("/b/x.lgp", False) and catalog.given_journal("/b/1Cv8.lgf") == ("/b", True) and catalog.given_journal("/b/x.json") == ("/b/x.json", False)
    dated = files.select("path", catalog.eventlog_name_date(F.col("path"), F.col("modified")).alias("day"), catalog.techlog_name_date(F.lit("/l/x.log"), F.col("modified")).alias("hour"))
    assert {r.day for r in dated.collect()} == {dt.date(2026, 8, 31)} and dated.first().hour == dt.datetime(2026, 8, 31, 14)
    assert [r.path for r in catalog.newest_first(dated.select("path", "day")).collect()][0] == "/b/1Cv8FTxt/x.lgp"
    recent = spark.createDataFrame([("a", dt.date(2026, 8, 29)), ("b", dt.date(2026, 8, 30)), ("c", None)], "path string, day date")
    names = lambda **o: sorted(r.path for r in catalog.recent_files(recent, dt.date(2026, 8, 31), **o).collect())
    assert names() == ["b", "c"] and names(archive=True) == ["a", "b", "c"] and names(end=dt.date(2026, 8, 29)) == ["a", "c"]
    assert catalog.recent_files(recent.filter("path = 'a'"), dt.date(2026, 8, 31)).count() == 1  # else nothing would be left


def test_long_records_keep_their_own_ids(spark):
    long = "00:01.000000-5,CALL,1,Usr=u,x=" + "x" * techlog.MAX_RECORD
    one, two = techlog_rows(spark, long + "1", long + "2")
    assert one.id != two.id and one.User == "u" and one.Descr == two.Descr == "... [TRUNCATED MASSIVE BLOCK TO 256KB]"


def test_fields_of_any_depth():
    deep = "{" * 30 + "a,b" + "}" * 30
    assert scan.fields('{1,{a,"}"},' + deep + ',"x "" , y",}') == ["1", '{a,"}"}', deep, '"x "" , y"', ""]
    assert scan.pairs("a=1,B:c='x ''y'' z',a=2,d=\"\",e='open") == {"a": ("a", "2"), "b_c": ("B_c", "x 'y' z"), "d": ("d", ""), "e": ("e", "open")}
    assert scan.depth('{"a}",{') == 2 and scan.depth('{"open') == 2 and scan.depth("{}") == 0


def test_header_conditions_come_before_the_pairs(spark):
    records = spark.createDataFrame([("00:01.000000-5000,CALL,1,Usr=a", dt.datetime(2026, 1, 1), "p", ""), ("00:02.000000-9,CALL,1,Usr=b", dt.datetime(2026, 1, 1), "p", "")], "raw string, hour timestamp, process string, pid string")
    rows = techlog.decode_techlog(records, where=F.col("DurationMs") >= 1)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r.User for r in rows.collect()] == ["a"] and plan.index("MapInArrow") < plan.rindex("Filter")


def test_no_listing_is_broadcast(spark):
    """Listings are of any size: directories are looked up once, and joins are by sorting whatever sizes are estimated."""
    files = spark.createDataFrame([("/r/a/1Cv8Log/1.lgp", "/r/a/1Cv8Log"), ("/r/a/1Cv8Log/2.lgp", "/r/a/1Cv8Log"), ("/r/b/c/3.lgp", "/r/b/c"), ("/q/4.lgp", "/q"), ("5.lgp", None)], "path string, directory string")
    dictionaries = spark.createDataFrame([("/r/a/1Cv8Log/1Cv8.lgf",), ("/r/a/1Cv8Log/old/1Cv8.lgf",), ("/r/1Cv8Log/1Cv8.lgf",), ("/q/x/y/1Cv8.lgf",)], "path string")
    found = catalog.nearest_dictionary(files, dictionaries)
    own = "/r/a/1Cv8Log/1Cv8.lgf"
    assert {r.path: r.dictionary for r in found.collect()} == {"/r/a/1Cv8Log/1.lgp": own, "/r/a/1Cv8Log/2.lgp": own, "/r/b/c/3.lgp": "/r/1Cv8Log/1Cv8.lgf", "/q/4.lgp": "/q/x/y/1Cv8.lgf", "5.lgp": None}
    assert found.columns == ["path", "directory", "dictionary"] and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def journal(spark, tmp_path, n=40):
    """Rows and codes as Parquet files, which Spark takes for small."""
    from logspark.sources.sqlite_journal import ROW_COLUMNS

    lists = ["1", "[1, 2]", "word", "", None]
    rows = [{"path": f"/l/B{k % 2}/1Cv8Log/1Cv8.lgd", "size": 9, **{c: k % 4 if kind == "long" else lists[k % 5] for c, kind in ROW_COLUMNS.items()}, "rowID": k, "date": 639_398_532_100_000, "userCode": k % 4 if k % 3 else None} for k in range(n)]
    codes = [(f"/l/B{b}/1Cv8Log/1Cv8.lgd", kind, k, f"{kind}{k}", "") for b in range(2) for kind in ("user", "app", "event", "metadata") for k in range(1, 4)]
    spark.createDataFrame(rows, "path string, size long, " + ", ".join(f"{c} {k}" for c, k in ROW_COLUMNS.items())).write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame(codes, "path string, kind string, code long, name string, uuid string").write.parquet(str(tmp_path / "codes"))
    return spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "codes"))


def test_large_code_tables_are_never_broadcast(spark, monkeypatch, tmp_path):
    rows, codes = journal(spark, tmp_path)
    got = []
    for most in (0, 6, 100):
        monkeypatch.setattr(eventlog, "BROADCAST_ENTRIES", most)
        decoded = lgd.decode_journal(rows, codes)
        got.append(sorted(map(str, decoded.collect())))
        assert most or "Broadcast" not in decoded._jdf.queryExecution().executedPlan().toString()
    assert got[0] == got[1] == got[2] and len(got[0]) == 40 and any("metadata1, metadata2" in r for r in got[0])


def test_newest_rows_are_chosen_before_codes_are_met(spark, tmp_path):
    rows, codes = journal(spark, tmp_path)
    few = lgd.decode_newest(rows, codes, 7)
    assert list(map(str, few.collect())) == list(map(str, lgd.newest(lgd.decode_journal(rows, codes), 7).collect()))
    plan = few._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda word: [len(line) - len(line.lstrip(" :+-")) for line in plan if word in line]
    assert any("GlobalLimit 7" in line for line in plan) and max(depth("GlobalLimit")) > max(depth("Join LeftOuter"))


def test_code_tables_are_read_in_batches(tmp_path):
    """However many codes a journal has, a batch holds few of them."""
    import sqlite3

    from logspark.sources import sqlite_journal

    path = str(tmp_path / "x.lgd")
    with sqlite3.connect(path) as db:
        for table in ("UserCodes", "AppCodes"):
            db.execute(f"CREATE TABLE {table} (code INTEGER PRIMARY KEY, name TEXT)")
            db.executemany(f"INSERT INTO {table} VALUES (?, ?)", [(k, f"n{k}") for k in range(12_001)])
    db.close()
    reader = sqlite_journal.SqliteJournal({"path": path, "part": "codes"}).reader(None)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert sum(b.num_rows for b in batches) == 24_002 and max(b.num_rows for b in batches) <= 5_000


def test_wrapped_records_are_scanned_once(monkeypatch):
    """Wrappers are neither scanned nor parsed again at every level."""
    inner = '{"id": "1", "note": "} {", "DateFormatted": "d"}'
    texts = {
        '{"w":' * 12 + inner + "}" * 12: [inner], f'{{"id": null, "DateFormatted": "x", "in": [{inner}, {inner}]}}': [inner, inner], f'{{"\\u0069d": "2", "DateFormatted": "d", "k": {inner}}}': None,
        f'{{"id": "3", "DateFormatted": broken, "k": {inner}}} {inner}': [inner, inner], '{"open": ' + inner: [], f'}} {inner} {{"a": {{"b": 1}}}}': [inner], f'{{"a": "\\"id\\": {{", "k": [{inner}]}}': [inner], "": [],
    }
    for text, wanted in texts.items():
        assert scan.records(text, ["id", "DateFormatted"]) == ([text] if wanted is None else wanted), text
    parsed = []
    monkeypatch.setattr(scan.json, "loads", lambda t, real=json.loads: parsed.append(t) or real(t))
    scan.records('{"w":' * 12 + inner + "}" * 12, ["id", "DateFormatted"])
    assert parsed == [inner]


def test_lines_are_made_once(spark):
    """The text of a line is not made again for each test of it."""
    lines = spark.range(3).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit("d").alias("DateFormatted"))).alias("value"))
    rows = jsondump.parse_lines(lines, "eventlog")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("DateFormatted, d)") == 1 and rows.count() == 3
