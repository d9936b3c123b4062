import io
import json
import subprocess
import sys
import threading
import time
from pathlib import Path
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest
from pyspark.sql import functions as F

from tidegrid.api import Service, serve
from tidegrid.cli import main, when
from tidegrid.operators.rollup import downsample
from tidegrid.operators.select import dedup_last
from tidegrid.sources.line_protocol import parse_lines
from tidegrid.sources.store import Store
from tidegrid.streaming.ingest import ingest_lines, read_rejected, read_rollups, rollup_aggregate, rollup_stream
from tidegrid.streaming.intervals import stream_periods


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    server = serve(spark, str(tmp_path_factory.mktemp("db")), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def ask(url, path, body=None, method=None):
    with urlopen(Request(url + path, data=body.encode() if body is not None else None, method=method)) as r:
        text = r.read().decode()
        return r.status, json.loads(text) if text[:1] in "[{" and text else text


def test_routes(url, capsys, monkeypatch):
    assert ask(url, "/health") == (200, "OK")
    assert ask(url, "/api/v1/write", "# c\ncpu,host=a value=1 1000\ncpu,host=a value=3 61000\n\ncpu,host=a 5 61000\n")[0] == 204
    with pytest.raises(HTTPError) as e:
        ask(url, "/api/v1/write", "mem 7 1000\nbad\nmem 8 2000")
    assert e.value.code == 400
    assert ask(url, "/api/v1/query_range?query=mem&start=0&end=100&step=60")[1]["Matrix"][0]["Samples"] == [{"Timestamp": 1000, "Value": 7.0}]
    assert ask(url, "/api/v1/query?query=sum(cpu)&time=61")[1]["Scalar"] == {"Value": 6.0}
    assert ask(url, "/api/v1/query?time=61", "query=count(cpu)")[1]["Scalar"] == {"Value": 2.0}
    assert ask(url, "/api/v1/series?match[]=cpu&start=0&end=100")[1] == [{"__name__": "cpu", "host": "a"}]
    assert ask(url, "/api/v1/labels")[1] == ["host"] and ask(url, "/api/v1/label/host/values")[1] == ["a"]
    assert ask(url, "/api/v1/admin/compact", "")[0] == ask(url, "/api/v1/admin/flush", "")[0] == ask(url, "/api/v1/admin/downsample", "")[0] == 200
    status = ask(url, "/api/v1/status")[1]
    assert (status["numSeries"], status["totalSamples"], status["minTime"], status["maxTime"]) == (2, 3, 1000, 61000)
    for path, code in (("/api/v1/query", 400), ("/api/v1/query?query=nope(x)", 400), ("/none", 404), ("/api/v1/write", 405), ("/api/v1/query_range?query=x&start=0&end=1&step=zz", 400)):
        with pytest.raises(HTTPError) as e:
            ask(url, path)
        assert e.value.code == code, path
    monkeypatch.setattr("sys.stdin", io.StringIO("# no\ndisk 4 1000\n"))
    assert main(["--server", url, "import"]) == 0 and "1 lines" in capsys.readouterr().out
    assert main(["--server", url, "status"]) == 0 and "totalSamples: 4" in capsys.readouterr().out
    assert main(["--server", url, "query", "sum(cpu)"]) == 0
    assert main(["--server", url, "query", "nope(x)"]) == 1
    assert main(["--server", url, "export", "cpu", "--start", "0"]) == 0
    assert when(None) == "N/A" and when(61_000) == "1970-01-01T00:01:01Z"


def test_stream_of_lines_and_rollups(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("m,h=1 1 1000\nm,h=1 2 2000\nbroken\n")
    run = lambda: ingest_lines(spark, str(tmp_path / "in"), str(tmp_path / "db"), str(tmp_path / "ck"), 0).awaitTermination()
    roll = lambda: rollup_stream(spark, f"{tmp_path}/db", str(tmp_path / "r"), str(tmp_path / "ck2")).awaitTermination()
    run(), run()
    s = Store(spark, str(tmp_path / "db"))
    assert s.scan().count() == 2
    roll()
    (tmp_path / "in" / "b.txt").write_text("m,h=1 9 2000\nm,h=1 4 7200000\n")
    run(), roll()
    kept = dedup_last(s.scan())
    assert {(r.ts, r.value) for r in kept.collect()} == {(1000, 1), (2000, 9), (7_200_000, 4)}
    key = ["resolution", "series_key", "ts", "min", "max", "sum", "count", "first", "last"]
    assert sorted(map(str, read_rollups(spark, str(tmp_path / "r")).select(*key).collect())) == sorted(map(str, downsample(kept).select(*key).collect()))
    (tmp_path / "empty").mkdir()
    stream = spark.readStream.schema(kept.schema).parquet(str(tmp_path / "empty"))
    assert rollup_aggregate(stream, "5m", "1 hour").isStreaming


def test_appends_and_compactions_lose_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "db"))
    part = lambda i: parse_lines(spark.createDataFrame([(f"m,h={i % 2} {i} {1000 * (i // 2)}", i)], "value string, seq long"), 0, seq="seq")
    rows = lambda: sorted((r.ts, r.value) for r in dedup_last(s.scan()).collect())
    for i in range(7):
        assert s.append(part(i), f"b{i}")
    assert not s.append(part(99), "b3") and len(s.log()) == 7  # the batch is there already
    want = rows()
    assert s.cycle() == 1 and [e["level"] for e in s.live().values()] == [0, 0, 0, 0, 1]
    assert s.cycle() == 1 and s.cycle() == 0 and [e["level"] for e in s.live().values()] == [0, 1, 1] and rows() == want
    write = Store._write

    def meanwhile(self, samples, name):
        write(self, samples, name)
        monkeypatch.undo()
        assert self.append(part(40), "late")  # between the data of a compaction and its commit

    monkeypatch.setattr(Store, "_write", meanwhile)
    assert s.compact()
    assert rows() == sorted([*want, (20_000, 40.0)]) and [e["level"] for e in s.live().values()] == [0, 2]
    # A merge of what is gone is not committed.
    assert not s._merge(["b0"], 1) or "b0" in s.live()
    assert s.vacuum() > 0 and rows() == sorted([*want, (20_000, 40.0)])
    (bad,) = (tmp_path / "db" / "data" / "commit=late").rglob("*.parquet")
    bad.write_bytes(b"broken")
    bad.with_name("." + bad.name + ".crc").unlink(missing_ok=True)
    assert rows() == want


def test_maintenance_runs_by_itself(spark, tmp_path):
    service = Service(spark, str(tmp_path))
    for i in range(3):
        service.write(f"m {i} {i}")
    stop = threading.Event()
    threads = service.maintain(stop, 0.1, 3600)
    deadline = time.time() + 90
    while time.time() < deadline and ([e["level"] for e in service.store.live().values()] != [1] or not list(tmp_path.glob("rollups/resolution=1m/*.parquet"))):
        time.sleep(0.2)
    stop.set()
    for t in threads[:1]:
        t.join(60)
    assert [e["level"] for e in service.store.live().values()] == [1]
    assert spark.read.parquet(f"{service.rollups}/resolution=1m").count() == 1


def test_manifest_counts_series_exactly(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    lines = spark.range(8000).select(F.concat(F.lit("m,h="), (F.col("id") % 5000).cast("string"), F.lit(" 1 "), F.col("id").cast("string")).alias("value"), F.col("id").alias("seq"))
    s.append(parse_lines(lines, 0, seq="seq"))
    assert [(r.num_series, r.num_samples, r.min_time, r.max_time) for r in s.manifest().collect()] == [(5000, 8000, 0, 7999)]


def test_lines_keep_their_order_in_a_split_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"m,h={i % 7} {i} 1000" if i % 50 else f"broken{i}" for i in range(2000)]
    (tmp_path / "in" / "a.txt").write_text("\n" * 300 + "\n".join(lines) + "\n")
    conf = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionNum": "9"}
    for limit in (True, False):  # several splits in a partition, and one
        try:
            for k, v in conf.items():
                if limit or k != "spark.sql.files.maxPartitionNum":
                    spark.conf.set(k, v)
            db = f"{tmp_path}/db{limit}"
            ingest_lines(spark, str(tmp_path / "in"), db, f"{tmp_path}/ck{limit}", 0).awaitTermination()
        finally:
            for k in conf:
                spark.conf.unset(k)
        rows = sorted((r.seq, r.value) for r in Store(spark, db).scan().collect())
        assert len({s for s, _ in rows}) == len(rows) and [v for _, v in rows] == [i for i in range(2000) if i % 50]
        rejected = read_rejected(spark, db).orderBy("seq").collect()
        assert [r.line for r in rejected] == [f"broken{i}" for i in range(0, 2000, 50)] and all(r.error for r in rejected)


def test_stream_of_intervals(spark, tmp_path):
    src, out = tmp_path / "iv", {}
    src.mkdir()
    schema = "entity string, start_ms long, end_ms long"
    q = stream_periods(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))

    def keep(batch, _):
        rows = batch.collect()
        for e in {r.entity for r in rows}:
            out[e] = sorted((r.kind, r.start_ms, r.end_ms) for r in rows if r.entity == e)

    for part in ([("a", 0, 9), ("a", 20, 29), ("b", 5, None)], [("a", 10, 14), ("a", 50, 40)], [("a", 15, 19), ("b", 1, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        q.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        if part[0][1] == 10:
            assert out["a"] == [("gap", 15, 19), ("period", 0, 14), ("period", 20, 29)]
    assert out == {"a": [("period", 0, 29)], "b": [("period", 1, 1)]}


def test_core_stands_without_the_text_operators():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['tidegrid.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p9_found' not in e.queries()\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for f in (root / "tidegrid").rglob("*.py"):
        assert "llm" in f.parts or "tidegrid.llm" not in f.read_text()
