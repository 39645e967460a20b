"""Analysis requests over HTTP: GET /health, POST /analyze with an API key.

`answer` is the whole service as a function from request to (status, object); the server around it takes one request at a
time for each thread and shares one session.
"""

from __future__ import annotations

import hmac
import json
import threading
import time
from collections import defaultdict, deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mailweave.operators.summary import LocalModel, model_summaries
from mailweave.plans.analyze import analyze
from mailweave.sinks.reports import response
from mailweave.sources.requests import parse_requests

#: Accepted requests for each client within so many seconds.
LIMIT, SECONDS = 100, 60


class Limiter:
    """At most LIMIT accepted requests of a client in any SECONDS; refused ones don't count."""

    def __init__(self, limit: int = LIMIT, seconds: float = SECONDS) -> None:
        self.limit, self.seconds, self.seen, self.lock = limit, seconds, defaultdict(deque), threading.Lock()

    def accept(self, client: str, now: float) -> bool:
        with self.lock:
            times = self.seen[client]
            while times and now - times[0] >= self.seconds:
                times.popleft()
            if len(times) >= self.limit:
                return False
            times.append(now)
            return True


def answer(spark: SparkSession, body: str, config: dict | None = None) -> tuple[int, dict]:
    """(status, response) of an analysis request. Mails without readable date come first, as in every thread."""
    mails = parse_requests(spark.createDataFrame([("request", body)], "request_id string, value string")).cache()
    try:
        status = mails.select("status").first()["status"]
        if status != 200:
            return status, {"detail": {400: "No mails provided in the request", 413: "Too many mails in one request"}[status]}
        given = json.loads(body)
        day = F.coalesce(F.unix_micros("date"), F.lit(-(2**62)))
        rows = mails.withColumn("thread_id", F.col("request_id")).withColumn("mail_id", F.format_string("%06d", "mail_ord")).withColumn("mail_ord", day).withColumn("source_file", F.lit("api_input"))
        sections = analyze(rows, config, extractor="hybrid")
        out = response(sections)
        if given.get("use_local_ai"):
            model = LocalModel(model=given.get("ai_model_name") or "llama3")
            out["metrics"]["summary"] = model_summaries(sections["Mails"], model).first()["answer"]
        return 200, out
    except Exception as e:  # noqa: BLE001
        return 500, {"detail": f"{type(e).__name__}: {e}"}
    finally:
        mails.unpersist()


def handle(spark: SparkSession, method: str, path: str, headers: dict, body: str, client: str, key: str, limiter: Limiter, config: dict | None = None) -> tuple[int, dict]:
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok", "model_reachable": LocalModel().reachable()}
    if (method, path) != ("POST", "/analyze"):
        return 404, {"detail": "Not found"}
    if not key or not hmac.compare_digest(headers.get("x-api-key", "").encode(), key.encode()):
        return 403, {"detail": "Invalid API key"}
    if not limiter.accept(client, time.monotonic()):
        return 429, {"detail": "Too many requests"}
    return answer(spark, body, config)


def serve(spark: SparkSession, key: str, host: str = "127.0.0.1", port: int = 8000, config: dict | None = None) -> ThreadingHTTPServer:
    """A server that isn't running yet; call serve_forever. Without a key every analysis is refused."""
    limiter = Limiter()

    class Handler(BaseHTTPRequestHandler):
        def _do(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            status, out = handle(spark, method, self.path.split("?")[0], {k.lower(): v for k, v in self.headers.items()}, body, self.client_address[0], key, limiter, config)
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._do("GET")

        def do_POST(self) -> None:
            self._do("POST")

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
