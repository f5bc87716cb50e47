"""Topics over HTTP, as the HTTP source and sink expect them: GET /topics/{topic}/{cursor} a page, POST /topics/{topic} a list of payloads."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote


class Topics(dict[str, list[str]]):
    """Payloads in base64 by topic. A bounded service says that the input has ended after the last one."""

    def __init__(self, page_size: int = 1000, bounded: bool = True) -> None:
        super().__init__()
        self.page_size, self.bounded = page_size, bounded
        self.lock = threading.Lock()

    def page(self, topic: str, cursor: int) -> dict:
        with self.lock:
            held = self.get(topic, [])
            events = held[cursor : cursor + self.page_size]
            after = cursor + len(events)
            return {"Events": events, "Status": "eoi" if self.bounded and after >= len(held) else "more", "Cursor": after}

    def add(self, topic: str, payloads: list[str]) -> None:
        with self.lock:
            self.setdefault(topic, []).extend(payloads)


@contextmanager
def serve(topics: Topics) -> Iterator[str]:
    """The address of a service that runs inside the block."""

    class Serve(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _answer(self, status: int, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            _, _, topic, cursor = self.path.split("/")
            self._answer(200, json.dumps(topics.page(unquote(topic), int(cursor))).encode())

        def do_POST(self):
            topics.add(unquote(self.path.split("/")[2]), json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self._answer(200, b"")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Serve)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}"
    finally:
        server.shutdown()
        server.server_close()
