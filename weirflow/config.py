"""Job configuration: a JSON document with literal values or references to parameters.

    {"job": {"workerCount": {"value": 2}, "keyGroupCount": 256, "workingStorageLocation": {"value": "/data/work"}},
     "sources": [{"id": "in", "httpApi": {"addr": {"param": "ADDR"}, "topics": ["events"]}}],
     "sinks": [{"id": "out", "stdio": {}}]}

A reference {"param": name} takes its value from given parameters, else from the environment variable WEIRFLOW_PARAM_<name>; an empty variable
counts as missing.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from weirflow.sources.httpapi import check_address
from weirflow.sources.kafka import options as kafka_options
from weirflow.sources.kinesis import check_arn

PREFIX = "WEIRFLOW_PARAM_"
_KINDS = {"kinesis": "kinesis", "httpApi": "httpapi", "embedded": "embedded", "stdio": "stdio", "kafka": "kafka", "memory": "memory", "parquet": "parquet"}


class ConfigError(ValueError):
    pass


@dataclass
class Connector:
    kind: str
    id: str = ""
    options: dict = field(default_factory=dict)


@dataclass
class JobConfig:
    source: Connector
    sink: Connector
    worker_count: int = 1
    key_groups: int = 256
    working_storage: str = ""
    savepoint_storage: str = ""


def lookup(name: str, params: dict[str, str]) -> str:
    value = params[name] if name in params else os.environ.get(PREFIX + name, "")
    if value == "" and name not in params:
        raise ConfigError(f'no value is given for parameter "{name}"')
    return value


def resolve(node, params: dict[str, str]):
    """The document with every {"value": v} and {"param": name} replaced."""
    if isinstance(node, list):
        return [resolve(n, params) for n in node]
    if not isinstance(node, dict):
        return node
    if set(node) == {"param"}:
        return lookup(node["param"], params)
    if set(node) == {"value"}:
        return node["value"]
    return {k: resolve(v, params) for k, v in node.items()}


def _number(value, name: str, default: int) -> int:
    if value is None or value == "":
        return default
    try:
        n = int(value)
    except (TypeError, ValueError):
        raise ConfigError(f"{name} must be a whole number, not {value!r}") from None
    if not -(2**31) <= n < 2**31:
        raise ConfigError(f"{name} must fit 32 bits: {value!r}")
    return n


def _connector(doc: dict) -> Connector:
    kinds = [k for k in doc if k in _KINDS]
    if len(kinds) != 1:
        raise ConfigError(f"no connector this version knows: {sorted(doc)}")
    return Connector(_KINDS[kinds[0]], doc.get("id", ""), doc[kinds[0]] or {})


def _check(c: Connector, what: str, errors: list[str]) -> None:
    o = c.options
    try:
        if c.kind == "httpapi":
            check_address(o.get("addr", ""))
            if what == "source" and len(o.get("topics", [])) != 1:
                raise ValueError("exactly one topic")
        elif c.kind == "kinesis" and what == "source":
            check_arn(o.get("streamArn", ""))
        elif c.kind == "kafka" and what == "source":
            kafka_options(o.get("brokers", []), o.get("topics", []), o.get("consumerGroup", ""))
        elif c.kind == "stdio" and what == "source" and not o.get("delimiter", "\n"):
            raise ValueError("the delimiter has at least one byte")
        elif (c.kind in ("kinesis", "embedded")) and what == "sink" or c.kind in ("memory", "parquet") and what == "source":
            raise ValueError(f"{c.kind} is no {what}")
    except ValueError as e:
        errors.append(f"{what} {c.id or c.kind}: {e}")


def load(text: str, params: dict[str, str] | None = None) -> JobConfig:
    """A checked configuration; all that is wrong with it is said at once."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"the configuration is no JSON document: {e}") from None
    doc = resolve(doc, params or {})
    sources, sinks = [_connector(s) for s in doc.get("sources", [])], [_connector(s) for s in doc.get("sinks", [])]
    errors = [f"exactly one {w}, not {len(x)}" for w, x in (("source", sources), ("sink", sinks)) if len(x) != 1]
    for c in sources:
        _check(c, "source", errors)
    for c in sinks:
        _check(c, "sink", errors)
    if errors:
        raise ConfigError("; ".join(errors))
    job = doc.get("job", {})
    return JobConfig(sources[0], sinks[0], _number(job.get("workerCount"), "workerCount", 1), _number(job.get("keyGroupCount"), "keyGroupCount", 256), job.get("workingStorageLocation") or "", job.get("savepointStorageLocation") or "")
