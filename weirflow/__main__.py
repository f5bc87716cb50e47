"""python -m weirflow run|testrun|savepoint|version"""

from __future__ import annotations

import argparse
import base64
import importlib
import json
import sys

import weirflow
from weirflow.interp import TestRun
from weirflow.model import Handler, KeyedEvent


def _handler(name: str) -> Handler:
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)()


def _state(entries: dict) -> dict:
    """A value by namespace, or values by key of entry, in base64."""
    text = lambda b: base64.b64encode(b).decode()
    out: dict = {}
    for (name, key), value in sorted(entries.items()):
        if key:
            out.setdefault(name, {})[text(key)] = text(value)
        else:
            out[name] = text(value)
    return out


def testrun(handler: Handler, lines, out) -> None:
    """Commands are JSON lines: {"event": {"key", "ts_us", "value" (base64)}}, {"watermark": true}, {"run": true}. Prints what was sent and each key's state."""
    steps = TestRun(handler)
    for line in lines:
        c = json.loads(line)
        if "event" in c:
            e = c["event"]
            steps.add_event(KeyedEvent(e["key"], int(e["ts_us"]), base64.b64decode(e.get("value", ""))))
        elif c.get("watermark"):
            steps.add_watermark()
        elif c.get("run"):
            done = steps.run()
            for s in done.sent:
                out.write(json.dumps({"sent": base64.b64encode(s).decode()}) + "\n")
            for key in sorted(done.state):
                out.write(json.dumps({"key": key, "state": _state(done.state[key])}) + "\n")
            return
    raise SystemExit("the input ended before the run command")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weirflow", description="Keyed jobs over event streams on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    run = sub.add_parser("run", help="run a job")
    run.add_argument("config")
    run.add_argument("--handler", required=True, help="module:class")
    run.add_argument("--param", action="append", default=[], help="name=value")
    run.add_argument("--checkpoint")
    run.add_argument("--from-savepoint")
    run.add_argument("--savepoint-to", help="make a savepoint in this folder at the end")
    run.add_argument("--follow", action="store_true", help="go on when the input is read")
    save = sub.add_parser("savepoint", help="copy the state of a job, running or not")
    save.add_argument("checkpoint", help="the folder the job was started with")
    save.add_argument("folder", help="where savepoints go")
    test = sub.add_parser("testrun", help="feed a handler from standard input")
    test.add_argument("--handler", required=True)
    a = p.parse_args(argv)
    if a.command == "version":
        print(f"weirflow {weirflow.__version__}")
    elif a.command == "testrun":
        testrun(_handler(a.handler), sys.stdin, sys.stdout)
    elif a.command == "savepoint":
        from weirflow.runtime import build_session
        from weirflow.streaming import savepoint

        print(savepoint.save(build_session(cores=1), a.checkpoint, a.folder))
    else:
        from weirflow.runtime import build_session
        from weirflow.streaming.job import Job

        with open(a.config) as f:
            job = Job.from_json(_handler(a.handler), f.read(), dict(x.split("=", 1) for x in a.param))
        query = job.start(build_session(), checkpoint=a.checkpoint, from_savepoint=a.from_savepoint, once=not a.follow)
        query.awaitTermination()
        if a.savepoint_to:
            print(job.create_savepoint(a.savepoint_to), file=sys.stderr)


if __name__ == "__main__":
    main()
