"""The run's HTTP side: state queries, webhooks, an event stream, and the dashboard page."""

from __future__ import annotations

import json
import threading
import urllib.request
import uuid
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from .events import Tracker

KEEPALIVE = 15.0

PAGE = """<!doctype html><meta charset=utf-8><title>millrace</title>
<style>body{font:14px sans-serif;margin:2em}.s{margin:1em 0}.t{display:inline-block;width:12px;height:12px;margin:1px;background:#bbb}
.running{background:#48f}.success{background:#3a3}.failed{background:#d33}.skipped{background:#cc8}.queued{background:#ddd}</style>
<h1 id=r></h1><div id=b></div><script>
async function go(){const s=await(await fetch('/api/state')).json();r.textContent=s.run_id;
b.replaceChildren(...s.stages.map(x=>{const d=document.createElement('div');d.className='s';
d.append(x.deps.join(', ')+(x.deps.length?' \\u2192 ':'')+x.name+' '+JSON.stringify(x.counts),document.createElement('br'));
x.tasks.forEach(t=>{const q=document.createElement('span');q.className='t '+t.state;q.title=t.key+': '+t.state;d.append(q)});return d}))}
go();setInterval(go,1000)</script>"""


def wanted(event: Mapping, names: list[str] | None) -> bool:
    """Whether a filter of states and types lets an event through."""
    return not names or event.get("type") in names or event.get("state") in names


class Webhooks:
    """Callback URLs; each event is posted from a thread of its own."""

    def __init__(self, tracker: Tracker) -> None:
        self._hooks: dict[str, dict] = {}
        tracker.subscribe(self._send)

    def add(self, url: str, events: list[str] | None = None) -> str:
        if urlparse(url).scheme not in ("http", "https"):
            raise ValueError("a webhook needs an http or https address")
        key = uuid.uuid4().hex[:12]
        self._hooks[key] = {"id": key, "url": url, "events": events}
        return key

    def remove(self, key: str) -> bool:
        return self._hooks.pop(key, None) is not None

    def list(self) -> list[dict]:
        return list(self._hooks.values())

    def _send(self, event: dict) -> None:
        for hook in self.list():
            if wanted(event, hook["events"]):
                threading.Thread(target=self._post, args=(hook["url"], event), daemon=True).start()

    @staticmethod
    def _post(url: str, event: dict) -> None:
        request = urllib.request.Request(url, json.dumps(event, default=str).encode(), {"Content-Type": "application/json"}, method="POST")
        try:
            urllib.request.urlopen(request, timeout=5).close()
        except OSError:
            return


def _handler(tracker: Tracker, status: Any, pipe: Any, investigator: Any, hooks: Webhooks) -> type[BaseHTTPRequestHandler]:
    def failures(q: dict) -> Any:
        return [r for r in (status.latest().values() if status else []) if r["state"] == "failed"]

    def stage(q: dict) -> Any:
        found = next((s for s in tracker.snapshot()["stages"] if s["name"] == q.get("name")), None)
        return (found | {"source": pipe.stages[found["name"]].source_text()}) if found and pipe and found["name"] in pipe.stages else found

    gets: dict[str, Callable[[dict], Any]] = {
        "/api/state": lambda q: tracker.snapshot(),
        "/api/failures": failures,
        "/api/task": lambda q: status.latest().get(q.get("key")) if status else None,
        "/api/stage": stage,
        "/api/subscriptions": lambda q: hooks.list(),
    }
    asks: dict[str, Callable[[dict], Any]] = {
        "/api/diagnose": lambda q: investigator.diagnose(q["key"]),
        "/api/ask": lambda q: investigator.ask(q["question"], q.get("key")),
        "/api/check": lambda q: investigator.check_run(),
    }

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: object) -> None:
            return

        def _reply(self, code: int, value: Any, kind: str = "application/json") -> None:
            data = value.encode() if kind == "text/html" else json.dumps(value, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _query(self) -> tuple[str, dict]:
            u = urlparse(self.path)
            return u.path, {k: v[0] for k, v in parse_qs(u.query).items()}

        def do_GET(self) -> None:
            path, q = self._query()
            if path == "/":
                return self._reply(200, PAGE, "text/html")
            if path == "/api/events":
                return self._stream(q.get("events", "").split(",") if q.get("events") else None)
            if path not in gets:
                return self._reply(404, {"error": "no such path"})
            found = gets[path](q)
            return self._reply(200 if found is not None else 404, found)

        def _stream(self, names: list[str] | None) -> None:
            place = len(tracker.log)
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            self.wfile.flush()
            try:
                for event in tracker.log.follow(place, KEEPALIVE):
                    if event is None:
                        self.wfile.write(b": waiting\n\n")
                    elif event["type"] != "stage" and wanted(event, names):
                        self.wfile.write(f"data: {json.dumps(dict(event), default=str)}\n\n".encode())
                    self.wfile.flush()
            except OSError:
                return

        def do_POST(self) -> None:
            path, q = self._query()
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = q | (json.loads(self.rfile.read(size)) if size else {})
            except ValueError:
                return self._reply(400, {"error": "the body is not JSON"})
            try:
                if path == "/api/subscribe":
                    return self._reply(200, {"id": hooks.add(body["url"], body.get("events"))})
                if path == "/api/unsubscribe":
                    return self._reply(200, {"removed": hooks.remove(body["id"])})
                if path in asks:
                    if investigator is None:
                        return self._reply(503, {"error": "the agent API is off"})
                    return self._reply(200, asks[path](body))
            except (KeyError, ValueError) as e:
                return self._reply(400, {"error": str(e)})
            except Exception as e:  # noqa: BLE001 - the caller learns what went wrong
                return self._reply(500, {"error": str(e)})
            return self._reply(404, {"error": "no such path"})

    return Handler


def start_server(tracker: Tracker, *, status: Any = None, pipe: Any = None, investigator: Any = None, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Serves in a daemon thread; port 0 takes a free one (see ``server_port``)."""
    server = ThreadingHTTPServer((host, port), _handler(tracker, status, pipe, investigator, Webhooks(tracker)))
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def serve_snapshot(snapshot: dict, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """The dashboard over a saved snapshot."""
    tracker = Tracker(snapshot["run_id"])
    for s in snapshot["stages"]:
        tracker.add_stage(s["name"], s["deps"], s.get("kind", "stage"))
        for t in s["tasks"]:
            tracker.set_state(s["name"], t["key"], t["state"])
    return start_server(tracker, host=host, port=port)
