"""Readers, writers and streams."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import records
from pyspark.sql import functions as F

from tidemark import MetricSpec, cumulative
from tidemark.operators import rules
from tidemark.sources import readers, shared, writers
from tidemark.streaming import intraday


def lines(tmp_path, *given: bytes):
    path = tmp_path / "landing.txt"
    path.write_bytes(b"\n".join(given))
    return str(path)


@pytest.mark.parametrize("separator", [b"\x01", b"\x00", b"\t", b","])
def test_delimited_file(spark, tmp_path, separator):
    path = lines(
        tmp_path,
        separator.join([b"a", b"b", b"c", b""]),
        separator.join([b"a", b"", b""]),
        separator.join([b"1", b"2", b"3", b"4"]),
        b"x",
        separator.join([b"\xff", b"y"]),
    )
    rows = [tuple(r) for r in readers.read_delimited(spark, path, ["p", "q", "r"]).collect()]
    assert rows == [("a", "b", "c"), ("a", "", ""), ("1", "2", "3"), ("x", "", ""), ("�", "y", "")]


def test_delimited_file_without_separator_or_lines(spark, tmp_path):
    one = readers.read_delimited(spark, lines(tmp_path, b"a b", b"c"), ["p", "q"])
    assert one.columns == ["p"] and [r.p for r in one.collect()] == ["a b", "c"]
    none = readers.read_delimited(spark, lines(tmp_path), ["p", "q"])
    assert none.columns == ["p", "q"] and none.count() == 0


def test_rule_file(spark, tmp_path):
    first = {"level1": "相机", "event_id": "shot", "scm": "params['s']"}
    text = [
        "\x01".join({**{c: "" for c in rules.RULE_COLUMNS}, **r}[c] for c in rules.RULE_COLUMNS).encode()
        for r in (first, {"level1": "", "event_id": "shot"})
    ]
    read = readers.read_rules(spark, lines(tmp_path, *text))
    accepted, rejected = rules.clean_rules(read)
    assert (accepted.count(), rejected.count()) == (1, 1)
    assert accepted.first()["scm"] == "params['s']"
    assert [r.rule_no for r in read.orderBy("rule_no").collect()] == [0, 1]


def test_detail_file_with_loose_headers(spark, tmp_path):
    (tmp_path / "d.csv").write_text(" uid , cost\nu1,2\n")
    read = readers.read_detail(spark, str(tmp_path / "d.csv"), "csv", schema="`a` string, `b` double")
    assert read.columns == ["a", "b"]
    read = readers.read_detail(spark, str(tmp_path / "d.csv"), "csv")
    assert read.columns == ["uid", "cost"] and read.first()["cost"] == "2"


def test_report_params(spark):
    values = readers.report_params(20251226, 202512260003, "202512260059", user=["app = x", "k=a=b"])
    assert values == {
        "date_p": 20251226,
        "start_ts": 202512260003,
        "end_ts": 202512260059,
        "start_ts_10": 202512260000,
        "end_ts_10": 202512260050,
        "date_minute10": 202512260050,
        "app": "x",
        "k": "a=b",
    }
    for bad in (["novalue"], ["=x"]):
        with pytest.raises(ValueError):
            readers.report_params(20251226, 202512260000, 202512260059, user=bad)
    got = readers.read_query(spark, "SELECT :app AS app, :end_ts_10 AS t", {k: values[k] for k in ("app", "end_ts_10")})
    assert tuple(got.first()) == ("x", 202512260050)
    injected = readers.read_query(spark, "SELECT :v AS v", {"v": "1' OR '1'='1"})
    assert injected.first()["v"] == "1' OR '1'='1"
    with pytest.raises(Exception, match="(?i)unbound|missing"):
        readers.read_query(spark, "SELECT :other AS x", {"app": "x"}).collect()


SPEC = MetricSpec(distincts={"uid": "users"}, sums={"cost": "cost"})


def report(spark, *rows):
    given = spark.createDataFrame(list(rows), "uid string, cost double, time_minute string")
    return cumulative(given, SPEC, start="00:00", end="01:00")


def test_overwrite_replaces_one_day_only(spark, tmp_path):
    path = str(tmp_path / "out")
    one = report(spark, ("u1", 1.0, "202512260001"))
    other = report(spark, ("u1", 1.0, "202512270001"))
    writers.write_day(one, path, 20251226, "append")
    writers.write_day(other, path, 20251227, "append")
    writers.write_day(one.withColumn("users", F.lit(9).cast("bigint")), path, 20251226, "overwrite")
    rows = spark.read.orc(path).collect()
    assert sorted((r.date_p, r.users) for r in rows) == [(20251226, 9)] * 7 + [(20251227, 1)] * 7
    writers.write_day(one, path, 20251226, "append")
    assert spark.read.orc(path).filter("date_p = 20251226").count() == 14


def test_empty_result_overwrites_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    one = report(spark, ("u1", 1.0, "202512260001"))
    writers.write_day(one, path, 20251226)
    writers.write_day(one, path, 20251228)
    writers.write_day(one.filter("false"), path, 20251226)
    assert spark.read.orc(path).count() == 7


def test_files_slices_and_codec(spark, tmp_path):
    one = report(spark, ("u1", 1.0, "202512260001"))
    path = tmp_path / "out"
    writers.write_day(one, str(path), 20251226, files=3, codec="zlib", slice_minutes=20)
    files = sorted(p.name for p in (path / "date_p=20251226").glob("*.orc"))
    assert 1 < len(files) <= 3 and all(name.endswith(".zlib.orc") for name in files)
    assert spark.read.orc(str(path)).count() == 7
    with pytest.raises(ValueError, match="multiple of 10"):
        writers.write_day(one, str(path), 20251226, slice_minutes=15)
    with pytest.raises(ValueError, match="mode"):
        writers.write_day(one, str(path), 20251226, "replace")


def test_alignment(spark):
    one = report(spark, ("u1", 1.25, "202512260001"))
    target = writers.column_types("cost decimal(10,2), users int, date_minute bigint, date_p bigint")
    aligned = writers.align_to_table(one, target, ["date_p"])
    assert aligned.dtypes == [("cost", "decimal(10,2)"), ("users", "int"), ("date_minute", "bigint"), ("date_p", "bigint")]
    assert float(aligned.agg(F.max("cost")).first()[0]) == 1.25
    with pytest.raises(ValueError, match=r"\['missing'\]"):
        writers.align_to_table(one, writers.column_types("missing int"))
    with pytest.raises(ValueError, match="not a partition column"):
        writers.align_to_table(one, target, ["model_p"])


def test_tables_with_named_and_dynamic_partitions(spark, tmp_path):
    columns = writers.column_types("users bigint, cost double, date_minute string, date_p int")
    writers.create_day_table(spark, "tidemark_day", columns, path=str(tmp_path / "t"))
    one = report(spark, ("u1", 1.0, "202512260001"))
    other = report(spark, ("u1", 1.0, "202512270001"))
    writers.write_dynamic(one.unionByName(other), "tidemark_day")
    writers.insert_overwrite_day(one.withColumn("users", F.lit(5)), "tidemark_day", 20251226)
    table = spark.table("tidemark_day")
    assert sorted((r.date_p, r.users) for r in table.collect()) == [(20251226, 5)] * 7 + [(20251227, 1)] * 7
    writers.register_partition(spark, "tidemark_day", 20251226)
    writers.register_partition(spark, "tidemark_day", 20251230)
    shown = {r[0] for r in spark.sql("SHOW PARTITIONS tidemark_day").collect()}
    assert shown == {"date_p=20251226", "date_p=20251227", "date_p=20251230"}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    spark.sql("DROP TABLE tidemark_day")


def test_two_writers_at_once(spark, tmp_path):
    """Each replaces its own days of one table, by an option of the write; the session's setting stays."""
    columns = writers.column_types("cnt bigint, date_p int, kind string")
    writers.create_day_table(spark, "tidemark_both", columns, ("date_p", "kind"), path=str(tmp_path / "t"))
    rows = lambda days, n: spark.createDataFrame([(n, d, k) for d in days for k in ("a'b", "c/d", None)], columns)
    days = [(20251201, 20251202, 20251203), (20251204, 20251205, 20251206)]
    assert writers.write_dynamic(rows(sum(days, ()), 1), "tidemark_both") == 18
    with ThreadPoolExecutor(2) as pool:
        for _ in range(3):
            done = [pool.submit(writers.write_dynamic, rows(d[:2], 2 + i), "tidemark_both") for i, d in enumerate(days)]
            assert [d.result() for d in done] == [6, 6]
            assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    found = {(r.date_p, r.cnt): r["count"] for r in spark.table("tidemark_both").groupBy("date_p", "cnt").count().collect()}
    wanted = {**{(d, 2): 3 for d in days[0][:2]}, **{(d, 3): 3 for d in days[1][:2]}, (20251203, 1): 3, (20251206, 1): 3}
    assert found == wanted and not [p for p in (tmp_path / "t").iterdir() if "staging" in p.name]
    assert writers.write_dynamic(rows([20251201], 9), "tidemark_both", "append") == 3
    assert spark.table("tidemark_both").count() == 21
    spark.sql("DROP TABLE tidemark_both")


def test_an_empty_result_is_reported(spark, tmp_path, caplog):
    columns = writers.column_types("cnt bigint, date_p int")
    writers.create_day_table(spark, "tidemark_none", columns, path=str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, 20251201)], columns)
    assert writers.write_dynamic(rows, "tidemark_none") == 1 and not caplog.records
    assert writers.write_dynamic(rows.filter("cnt > 1"), "tidemark_none") == 0
    assert writers.write_dynamic(rows.limit(0), "tidemark_none") == 0
    assert writers.write_days(rows.limit(0), str(tmp_path / "d")) == 0 and writers.write_days(rows, str(tmp_path / "d")) == 1
    assert writers.write_day(rows, str(tmp_path / "d"), 20251202) == 0 and "2025-12-02" in caplog.records[-1].getMessage()
    assert len(caplog.records) == 4 and spark.table("tidemark_none").count() == 1
    spark.sql("DROP TABLE tidemark_none")


class Connection:
    """Keeps what is asked of it; ``fail`` names a statement that breaks."""

    def __init__(self, fail=None):
        self.log, self.fail = [], fail

    def setAutoCommit(self, value):
        self.log.append(f"autocommit {value}")

    def createStatement(self):
        return self

    def executeUpdate(self, sql):
        if self.fail and sql.startswith(self.fail):
            raise RuntimeError("broken")
        self.log.append(sql)

    def commit(self):
        self.log.append("commit")

    def rollback(self):
        self.log.append("rollback")

    def close(self):
        self.log.append("close")


@pytest.mark.parametrize("fail", [None, "INSERT"])
def test_database_day_is_swapped_in_one_transaction(spark, monkeypatch, fail):
    one = report(spark, ("u1", 1.0, "202512260001"))
    staged = []
    monkeypatch.setattr(
        type(one.write), "jdbc", lambda self, url, table, mode, properties: staged.append((url, table, mode))
    )
    connection = Connection(fail)
    call = lambda: writers.write_jdbc_day(one, "jdbc:x", "t", 20251226, connect=lambda: connection)
    if fail:
        with pytest.raises(RuntimeError):
            call()
        assert "commit" not in connection.log and "rollback" in connection.log
    else:
        call()
        assert connection.log[1] == "DELETE FROM t WHERE date_p = 20251226"
        assert connection.log[2].startswith("INSERT INTO t (users, cost") or connection.log[2].startswith("INSERT INTO t (level")
        assert connection.log[3:5] == ["commit", "DROP TABLE t_stage_20251226"]
    assert staged == [("jdbc:x", "t_stage_20251226", "overwrite")]


class Context:
    """A context that names a shared folder, or none."""

    def __init__(self, master, named=None):
        self.master, self.named, self.folder = master, named, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, *given):
        self.sparkContext = Context(*given)
        self.conf = {"spark.checkpoint.dir": self.sparkContext.named}


def test_shared_folder_is_the_named_one():
    named = Session("spark://cluster", "hdfs:///shared/")
    assert shared.scratch_path(named, "x").startswith("hdfs:///shared/x-")
    shared.ensure_checkpoint_dir(named)
    assert named.sparkContext.folder == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session("spark://cluster"))
    alone = Session("local[2]")
    assert shared.shared_dir(alone) == shared.shared_dir(alone) == alone.sparkContext.folder


def test_stream_finds_the_earliest_stamp_not_the_first_arrival(spark, tmp_path):
    spec = MetricSpec(dims=["d"], distincts={"k": "keys"}, sums={"v": "v"}, time_col="ts")
    schema = "d string, k string, v double, ts timestamp_ntz"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", "x", 1.0, dt.datetime(2024, 1, 1, 0, 35))], [("a", "x", 2.0, dt.datetime(2024, 1, 1, 0, 12)), ("a", None, 4.0, dt.datetime(2024, 1, 1, 0, 31))]]
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        updates = intraday.stream_first_seen(spark.readStream.schema(schema).parquet(source), spec, "k")
        running = intraday.keep_latest(updates, sink, str(tmp_path / "state"), ["period", "d", "k", "bucket"])
        running.awaitTermination()
        sums = intraday.stream_bucket_sums(spark.readStream.schema(schema).parquet(source), spec)
        running = intraday.keep_latest(sums, sink + "-s", str(tmp_path / "state-s"), ["bucket", "d", "v"])
        running.awaitTermination()
    latest = intraday.latest_updates(spark.read.parquet(sink), ["period", "d", "k"], ["bucket"]).collect()
    assert [(r.k, r.bucket) for r in latest] == [("x", dt.datetime(2024, 1, 1, 0, 10))]
    totals = records(intraday.latest_updates(spark.read.parquet(sink + "-s"), ["bucket", "d"], ["v"]), "bucket")
    assert [(r["bucket"].minute, r["v"]) for r in totals] == [(10, 2), (30, 5)]
