"""Command line: run, status, worker, viz and explain for ``package.module:pipeline``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from pathlib import Path


def value(text: str) -> int | float | str:
    """A run argument as a whole number, a number or a string, whichever fits first."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def load(spec: str):
    module, _, name = spec.partition(":")
    if not name:
        raise SystemExit(f"{spec!r} is not package.module:name")
    sys.path.insert(0, ".")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a pipeline")
    run.add_argument("spec")
    run.add_argument("--master", help="Spark master; default: local, or what spark-submit says")
    run.add_argument("--workers", type=int)
    run.add_argument("--viz", action="store_true")
    run.add_argument("--force", action="store_true")
    run.add_argument("--no-smoke", action="store_true")
    run.add_argument("args", nargs="*", metavar="key=value")
    for name in ("status", "explain"):
        sub.add_parser(name).add_argument("spec")
    viz = sub.add_parser("viz", help="serve a saved snapshot")
    viz.add_argument("snapshot")
    viz.add_argument("--port", type=int, default=8765)
    a = p.parse_args(argv)
    if a.command == "viz":
        from .streaming.server import serve_snapshot

        server = serve_snapshot(json.loads(Path(a.snapshot).read_text()), port=a.port)
        print(f"http://127.0.0.1:{server.server_port}")
        while True:
            time.sleep(3600)
    pipe = load(a.spec)
    if a.command == "status":
        from collections import Counter

        from .plans.status import Status
        from .sources.store import Store

        done = Counter(r["stage"] for r in Status(Store(pipe.config.root), pipe.name).latest().values() if r["state"] == "success")
        print(json.dumps({s: done.get(s, 0) for s in pipe.stages}))
        return 0
    from .session import session

    if a.command == "explain":
        from .plans.pipeline import explain

        print(explain(pipe, session("local[1]")))
        return 0
    spark = session(a.master or (f"local[{a.workers or pipe.config.workers}]"))
    args = dict(x.split("=", 1) for x in a.args)
    snap = pipe.run(spark, viz=a.viz, force=a.force, smoke=not a.no_smoke, **{k: value(v) for k, v in args.items()})
    print(json.dumps({s["name"]: s["counts"] for s in snap["stages"]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
