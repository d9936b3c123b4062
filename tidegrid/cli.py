"""Command line: ``python -m tidegrid.cli serve`` and a client for a running server."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen


def call(server: str, path: str, method: str = "GET", body: str | None = None) -> str:
    with urlopen(Request(server.rstrip("/") + path, data=body.encode() if body is not None else None, method=method)) as r:
        return r.read().decode()


def when(ms: int | None) -> str:
    """RFC 3339, or N/A where there is no time."""
    return "N/A" if not ms else datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidegrid")
    p.add_argument("--server", default="http://127.0.0.1:9090")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("serve", help="run the server")
    s.add_argument("--data-dir", default="./data")
    s.add_argument("--port", type=int, default=9090)
    sub.add_parser("query", help="instant query").add_argument("text", nargs="+")
    for name, text in (("status", "what is stored"), ("write", "lines from standard input"), ("import", "lines from standard input"), ("flush", "flush"), ("compact", "compact"), ("downsample", "rebuild rollups")):
        sub.add_parser(name, help=text)
    e = sub.add_parser("export", help="series of metrics as JSON")
    e.add_argument("metric", nargs="+")
    e.add_argument("--start")
    e.add_argument("--end")
    a = p.parse_args(argv)
    try:
        if a.command == "serve":
            from tidegrid.api import serve
            from tidegrid.session import build_session

            serve(build_session("tidegrid server"), a.data_dir, a.port, maintenance=True).serve_forever()
        elif a.command == "query":
            print(json.dumps(json.loads(call(a.server, "/api/v1/query?" + urlencode({"query": " ".join(a.text)}))), indent=2))
        elif a.command == "status":
            r = json.loads(call(a.server, "/api/v1/status"))
            for k in ("numSeries", "numBlocks", "totalSamples"):
                print(f"{k}: {r[k]}")
            print(f"minTime: {when(r['minTime'])}\nmaxTime: {when(r['maxTime'])}")
        elif a.command in ("write", "import"):
            lines = [x.strip() for x in sys.stdin if x.strip() and not x.strip().startswith("#")]
            call(a.server, "/api/v1/write", "POST", "\n".join(lines))
            print(f"{len(lines)} lines written")
        elif a.command == "export":
            print(call(a.server, "/api/v1/series?" + urlencode([("match[]", m) for m in a.metric] + [(k, v) for k, v in (("start", a.start), ("end", a.end)) if v])))
        else:
            print(call(a.server, f"/api/v1/admin/{a.command}", "POST", ""))
    except HTTPError as err:
        print(f"error {err.code}: {err.read().decode()}", file=sys.stderr)
        return 1
    except OSError as err:
        print(f"error: {err}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
