"""Local HTTP interface: GET /health and /status, POST /update, /search and /context."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from .plans import answers, index


def respond(spark: SparkSession, index_dir: str, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """(status, JSON value) of one request."""
    try:
        q = json.loads(body or b"{}")
    except ValueError:
        return 400, {"error": "the body is not JSON"}
    if not isinstance(q, dict):
        return 400, {"error": "the body is not an object"}
    try:
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok"}
        if (method, path) == ("GET", "/status"):
            return 200, index.status(spark, index_dir)
        if (method, path) == ("POST", "/update"):
            return 200, index.update(spark, index_dir, bool(q.get("lite")))
        if (method, path) == ("POST", "/search"):
            if not q.get("query"):
                return 400, {"error": "query is required"}
            return 200, answers.search(spark, index_dir, q["query"], q.get("kind", ""), int(q.get("limit", 20)))
        if (method, path) == ("POST", "/context"):
            names = q.get("symbols") or []
            names = [n.strip() for n in names.split(",")] if isinstance(names, str) else names
            if not names:
                return 400, {"error": "symbols are required"}
            return 200, answers.context(
                spark, index_dir, names, bool(q.get("partial")), bool(q.get("basic")), int(q.get("level", 0)), int(q.get("budget_chars", 60000)), bool(q.get("include_tree")), bool(q.get("include_types"))
            )
        return 404, {"error": "not found"}
    except Exception as e:  # noqa: BLE001  a request's error is its answer
        return 500, {"error": str(e)}


def server(spark: SparkSession, index_dir: str, port: int) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            code, value = respond(spark, index_dir, self.command, self.path, self.rfile.read(size))
            data = json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Connection", "close")
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = answer

        def log_message(self, *args) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


def serve(spark: SparkSession, index_dir: str, port: int = 7123) -> None:
    with server(spark, index_dir, port) as s:
        s.serve_forever()
