"""What a handler is made of.

A handler turns raw records into keyed events and reacts to events and timers of one key at a time. Times are whole microseconds since
1970 UTC. The same handler runs in the interpreter (weirflow.interp) and in a streaming query (weirflow.streaming.processor).
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any, NamedTuple


class KeyedEvent(NamedTuple):
    key: str
    ts_us: int
    value: bytes


class Codec:
    """How a state value becomes bytes."""

    def encode(self, value: Any) -> bytes:
        raise NotImplementedError

    def decode(self, data: bytes) -> Any:
        raise NotImplementedError


class JsonCodec(Codec):
    def encode(self, value):
        return json.dumps(value, separators=(",", ":")).encode()

    def decode(self, data):
        return json.loads(data)


class LongCodec(Codec):
    """8 bytes, most significant first; empty is 0."""

    def encode(self, value):
        return int(value).to_bytes(8, "big", signed=True)

    def decode(self, data):
        return int.from_bytes(data, "big", signed=True)


def int_key(n: int) -> bytes:
    """A whole number as an entry's key: byte order is the order of numbers."""
    return (n + (1 << 63)).to_bytes(8, "big")


def key_int(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


#: (namespace, key of the entry). A namespace that holds one value only has it under the empty key.
Entry = tuple[str, bytes]
_FIXED = (int, float, str, bytes, type(None))


@dataclass
class Subject:
    """The key a handler is called for: its state, its timers and what it sends to the sink.

    State is made of entries: a namespace, a key of bytes, a value. Values that can't change in place are encoded when the call is over, if they changed.
    """

    key: str
    watermark_us: int
    codecs: dict[str, Codec]
    stored: dict[Entry, bytes]
    new_timers: set[int] = field(default_factory=set)
    sent: list[bytes] = field(default_factory=list)
    _seen: dict[Entry, Any] = field(default_factory=dict)
    _put: set[Entry] = field(default_factory=set)
    _before: dict[Entry, bytes | None] = field(default_factory=dict)

    def get(self, name: str, default: Any = None) -> Any:
        return self.entry(name, b"", default)

    def entry(self, name: str, key: bytes, default: Any = None) -> Any:
        at = (name, key)
        if at in self._seen:
            return self._seen[at]
        data = self.stored.get(at)
        if data is None:
            return default
        value = self.codecs[name].decode(data)
        if isinstance(value, _FIXED):
            self._seen[at] = value
        return value

    def entries(self, name: str) -> list[tuple[bytes, Any]]:
        """(key, value) of all entries of a namespace, by key."""
        keys = {k for n, k in self.stored if n == name} | {k for n, k in self._put if n == name}
        return [(k, self.entry(name, k)) for k in sorted(keys)]

    def put(self, name: str, *entry: Any) -> None:
        """put(namespace, value) or put(namespace, key, value)."""
        key, value = entry if len(entry) == 2 else (b"", *entry)
        if len(name.encode()) > 255:
            raise ValueError("a namespace has at most 255 bytes")
        at = (name, key)
        self._before.setdefault(at, self.stored.get(at))
        if isinstance(value, _FIXED):
            self._seen[at] = value
            self._put.add(at)
        else:
            self._seen.pop(at, None), self._put.discard(at)
            self.stored[at] = self.codecs[name].encode(value)

    def delete(self, name: str, key: bytes = b"") -> None:
        at = (name, key)
        self._before.setdefault(at, self.stored.get(at))
        self._seen.pop(at, None), self._put.discard(at)
        self.stored.pop(at, None)

    def changes(self) -> dict[Entry, bytes | None]:
        """What is other than before the call; None is an entry that has gone. `stored` is up to date afterwards."""
        for at in self._put:
            self.stored[at] = self.codecs[at[0]].encode(self._seen[at])
        self._put.clear()
        return {at: self.stored.get(at) for at, old in self._before.items() if self.stored.get(at) != old}

    def set_timer(self, ts_us: int) -> None:
        """Nothing happens if the watermark has reached it; a timer set twice is one timer."""
        if ts_us > self.watermark_us:
            self.new_timers.add(ts_us)

    def send(self, value: bytes | str) -> None:
        self.sent.append(value.encode() if isinstance(value, str) else value)


class Handler:
    """Subclass and override. `state` declares the namespaces of state and the codecs of their values."""

    state: dict[str, Codec] = {}

    def key_events(self, raw: bytes) -> Iterable[KeyedEvent]:
        raise NotImplementedError

    def on_event(self, subject: Subject, event: KeyedEvent) -> None:
        raise NotImplementedError

    def on_timer(self, subject: Subject, ts_us: int) -> None:
        pass
