"""HTTP surface over an engine and a store, on the standard library's server."""

from __future__ import annotations

import json
import logging
import re
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegrid.lang import QueryError, parse_duration, parse_time
from tidegrid.operators.rollup import rebuild_rollups
from tidegrid.operators.select import dedup_last
from tidegrid.plans.engine import INSTANT_MS, Engine
from tidegrid.sources.line_protocol import parse_lines
from tidegrid.sources.store import Store

DAY_MS = 86_400_000


class HttpError(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


class Service:
    """What the routes do. Rows of one request are one append; writes are serialised, reads are not."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.clock = spark, clock
        self.store, self.rollups = Store(spark, f"{root}/samples"), f"{root}/rollups"
        self._lock, self._writes = threading.Lock(), int(time.time() * 1000)

    def engine(self, start: int | None = None, end: int | None = None) -> Engine:
        return Engine(self.store.scan(start, end))

    def write(self, body: str) -> None:
        """Append the lines up to the first bad one; that one is an error."""
        # Line numbers give the order; Python splits the request, Spark parses it.
        rows = [(line, i) for i, line in enumerate(body.split("\n"))]
        parsed = parse_lines(self.spark.createDataFrame(rows, "value string, seq long"), self.clock(), "quarantine", seq="seq").orderBy("seq").collect()
        bad = next((r for r in parsed if r["error"]), None)
        good = [r for r in parsed if bad is None or r["seq"] < bad["seq"]]
        with self._lock:
            self._writes += 1
            if good:
                base = self._writes << 20
                schema = self.store.raw().drop("day").schema
                self.store.append(self.spark.createDataFrame([(r["metric"], r["labels"], r["series_key"], r["ts"], r["value"], base + r["seq"]) for r in good], schema))
        if bad is not None:
            raise HttpError(400, bad["error"])

    def query(self, text: str, at: str | None) -> dict:
        t = parse_time(at) if at else self.clock()
        return self.engine(t - INSTANT_MS, t).instant(text, t).to_dict()

    def query_range(self, text: str, start: str, end: str, step: str | None) -> dict:
        if step:
            parse_duration(step)
        a, b = parse_time(start), parse_time(end)
        return self.engine(a, b).range(text, a, b).to_dict()

    def series(self, names: list[str], start: str | None, end: str | None) -> list[dict]:
        b = parse_time(end) if end else self.clock()
        a = parse_time(start) if start else b - DAY_MS
        return [r["series"] for r in self.engine(a, b).series_matching(names, a, b).collect()]

    def status(self) -> dict:
        r = self.engine().status().first()
        return {"numSeries": r["num_series"], "numBlocks": self.store.num_files(), "totalSamples": r["total_samples"], "minTime": r["min_time"], "maxTime": r["max_time"]}

    def labels(self) -> list[str]:
        return [r[0] for r in self.engine().label_names().collect()]

    def label_values(self, name: str) -> list[str]:
        return [r[0] for r in self.engine().label_values(name).collect()]

    def compact(self) -> None:
        self.store.compact()

    def downsample(self) -> None:
        rebuild_rollups(dedup_last(self.store.scan().where(F.lit(True))), self.rollups)

    def maintain(self, stop: threading.Event, compact_s: float = 300, downsample_s: float = 600) -> list[threading.Thread]:
        """Until ``stop``: a round of compaction every five minutes, rollups now and every ten. A failed round is left to the next."""

        def every(seconds: float, work: Callable[[], object], at_once: bool) -> None:
            while at_once or not stop.wait(seconds):
                at_once = False
                try:
                    work()
                except Exception as e:  # noqa: BLE001
                    logging.getLogger(__name__).warning("maintenance failed: %s", e)

        threads = [threading.Thread(target=every, args=a, daemon=True) for a in ((compact_s, self.store.cycle, False), (downsample_s, self.downsample, True))]
        for t in threads:
            t.start()
        return threads


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, status: int, body: object = None) -> None:
            raw = b"" if body is None else body.encode() if isinstance(body, str) else json.dumps(body, allow_nan=False).encode()
            self.send_response(status)
            if body is not None:
                self.send_header("Content-Type", "text/plain" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _serve(self, method: str) -> None:
            parts = urlsplit(self.path)
            args = parse_qs(parts.query, keep_blank_values=True)
            size = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(size).decode("utf-8", "replace") if size else ""
            try:
                self._send(*self._route(method, parts.path, args, body))
            except HttpError as e:
                self._send(e.status, str(e))
            except (QueryError, ValueError) as e:
                self._send(400, str(e))
            except Exception as e:  # noqa: BLE001
                self._send(500, f"{type(e).__name__}: {str(e)[:500]}")

        def _route(self, method: str, path: str, args: dict, body: str) -> tuple:
            def one(name: str, form: dict | None = None) -> str | None:
                return (args.get(name) or (form or {}).get(name) or [None])[0]

            def need(name: str, form: dict | None = None) -> str:
                value = one(name, form)
                if not value:
                    raise HttpError(400, f"missing parameter: {name}")
                return value

            post_only = {"/api/v1/write", "/api/v1/admin/flush", "/api/v1/admin/compact", "/api/v1/admin/downsample"}
            either = {"/api/v1/query", "/api/v1/query_range"}
            if (path in post_only) != (method == "POST") and path not in either:
                raise HttpError(405, "method not allowed")
            if path == "/api/v1/write":
                service.write(body)
                return (204,)
            if path == "/api/v1/query":
                return 200, service.query(need("query", parse_qs(body) if method == "POST" else None), one("time"))
            if path == "/api/v1/query_range":
                return 200, service.query_range(need("query"), need("start"), need("end"), one("step"))
            if path == "/api/v1/series":
                need("match[]")
                return 200, service.series(args["match[]"], one("start"), one("end"))
            if path == "/api/v1/labels":
                return 200, service.labels()
            if m := re.fullmatch(r"/api/v1/label/([^/]+)/values", path):
                return 200, service.label_values(m[1])
            if path == "/api/v1/status":
                return 200, service.status()
            if path == "/api/v1/admin/flush":
                return 200, {"status": "flushed"}  # every write is a file already
            if path == "/api/v1/admin/compact":
                service.compact()
                return 200, {"status": "compacted"}
            if path == "/api/v1/admin/downsample":
                service.downsample()
                return 200, {"status": "downsampled"}
            if path == "/health":
                return 200, "OK"
            raise HttpError(404, "not found")

        def do_GET(self) -> None:  # noqa: N802
            self._serve("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._serve("POST")

    return Handler


def serve(spark: SparkSession, root: str, port: int = 9090, host: str = "127.0.0.1", maintenance: bool = False) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; with ``maintenance`` compaction and rollups run by themselves beside it."""
    service = Service(spark, root)
    if maintenance:
        service.maintain(threading.Event())
    return ThreadingHTTPServer((host, port), handler(service))
