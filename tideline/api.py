"""The HTTP query interface: a handler of paths and parameters, and a small server around it."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from tideline.engine import Engine, to_result
from tideline.plans.compiler import kind
from tideline.plans.parser import duration, parse
from tideline.sources.store import clear, load, save
from tideline.sources.wide import import_wide


class BadRequest(ValueError):
    pass


def time_ms(text: str) -> int:
    """Unix seconds or RFC 3339."""
    try:
        return round(float(text) * 1000)
    except ValueError:
        pass
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise BadRequest(f"bad time {text!r}") from e
    return round((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def step_ms(text: str) -> int:
    try:
        step = round(float(text) * 1000)
    except ValueError:
        step = duration(text)
    if step <= 0:
        raise BadRequest("the step must be positive")
    return step


class Api:
    """Answers of the query interface over the store in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def engine(self) -> Engine:
        return Engine(load(self.spark, self.path))

    def handle(self, method: str, path: str, params: dict[str, list[str]]) -> tuple[int, dict]:
        """(HTTP status, body): bad parameters give 400, everything else that fails 500."""

        def need(name: str) -> str:
            if not params.get(name):
                raise BadRequest(f"missing parameter {name}")
            return params[name][0]

        try:
            return 200, {"status": "success", "data": self._data(method, path, params, need)}
        except BadRequest as e:
            return 400, {"status": "error", "errorType": "bad_data", "error": str(e)}
        except LookupError as e:
            return 404, {"status": "error", "errorType": "not_found", "error": str(e)}
        except Exception as e:
            return 500, {"status": "error", "errorType": "execution", "error": str(e)[:2000]}

    def _data(self, method: str, path: str, params: dict[str, list[str]], need):
        if path == "/api/v1/query":
            at, text = time_ms(params["time"][0]) if params.get("time") else round(datetime.now(timezone.utc).timestamp() * 1000), need("query")
            return to_result(self.engine.query_instant(text, at).collect(), True, kind(parse(text)) == "s")
        if path == "/api/v1/query_range":
            text, start, end, step = need("query"), time_ms(need("start")), time_ms(need("end")), step_ms(need("step"))
            if end < start:
                raise BadRequest("the end is before the start")
            return to_result(self.engine.query_range(text, start, end, step).collect(), False)
        if m := re.fullmatch(r"/api/v1/label/([^/]+)/values", path):
            return sorted(r["value"] for r in self.engine.label_values(m[1]).collect())
        if path == "/api/v1/series":
            if not params.get("match[]"):
                raise BadRequest("missing parameter match[]")
            return [r["labels"] for r in self.engine.series(*params["match[]"]).collect()]
        if path == "/api/v1/scrape_data" and method == "POST":
            save(import_wide(self.spark, need("path")), self.path)
            return None
        if path == "/api/v1/scrape_data" and method == "DELETE":
            clear(self.spark, self.path, time_ms(params["start"][0]) if params.get("start") else None, time_ms(params["end"][0]) if params.get("end") else None)
            return None
        raise KeyError(f"no such path: {path}")


def serve(api: Api, port: int = 9090, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server on a port (0: any free one); the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            url = urlsplit(self.path)
            params = parse_qs(url.query)
            if self.command == "POST" and (n := int(self.headers.get("Content-Length") or 0)):
                params |= parse_qs(self.rfile.read(n).decode())
            status, body = api.handle(self.command, url.path, params)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = answer

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
