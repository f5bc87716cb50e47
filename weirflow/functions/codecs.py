"""Byte and text forms of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long_to_bytes(value: Column) -> Column:
    """8 bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def bytes_to_long(value: Column) -> Column:
    """The number of up to 8 bytes, most significant first, as a signed long; empty is 0."""
    text = F.lpad(F.hex(value), 16, "0")
    half = lambda start: F.conv(F.substring(text, start, 8), 16, 10).cast("long")
    return F.when(value.isNotNull(), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def micros_to_bytes(us: Column) -> Column:
    """Nanoseconds since 1970 in 8 bytes."""
    return long_to_bytes(us * 1000)


def rfc3339(us: Column) -> Column:
    """UTC time of microseconds to the second, as yyyy-MM-ddTHH:mm:ssZ, whatever the session's zone."""
    inside = F.pmod(us, F.lit(86_400_000_000))
    day = F.date_from_unix_date(((us - inside) / 86_400_000_000).cast("int")).cast("string")
    two = lambda step, of: F.lpad(F.pmod((inside / step).cast("int"), F.lit(of)).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(3_600_000_000, 24), F.lit(":"), two(60_000_000, 60), F.lit(":"), two(1_000_000, 60), F.lit("Z"))


def frames(text: Column, delimiter: str) -> Column:
    """The records of a text as an array: what stands between delimiters, an unterminated last one included, an empty last one not."""
    parts = F.split(text, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def sink_record(topic: Column, data: Column) -> Column:
    """The JSON of one record for the HTTP sink, its data in base64."""
    return F.to_json(F.struct(topic.alias("Topic"), F.base64(data.cast("binary")).alias("Data")))


def state_key(group: Column, subject: Column, namespace: Column, entry: Column) -> Column:
    """Group (2 bytes), 0, length of subject (4), subject, length of namespace (1), namespace, entry: byte order groups a subject's entries by namespace."""
    number = lambda n, digits: F.unhex(F.lpad(F.hex(n.cast("long")), digits, "0"))
    raw = [x.cast("binary") for x in (subject, namespace, entry)]
    return F.concat(number(group, 4), F.unhex(F.lit("00")), number(F.octet_length(raw[0]), 8), raw[0], number(F.octet_length(raw[1]), 2), raw[1], raw[2])


def timer_key(group: Column, us: Column, subject: Column) -> Column:
    """Group (2 bytes), 1, nanoseconds (8), subject: byte order is time order inside a group."""
    return F.concat(F.unhex(F.lpad(F.hex(group.cast("long")), 4, "0")), F.unhex(F.lit("01")), micros_to_bytes(us), subject.cast("binary"))


def parse_state_key(key: Column) -> dict[str, Column]:
    """key_group, subject, namespace and entry of a state key; null where it is none."""
    part = lambda start, n: F.substring(key, start, n)
    number = lambda b: F.conv(F.hex(b), 16, 10).cast("int")
    whole = (F.octet_length(key) >= 8) & (F.hex(part(3, 1)) == "00")
    subject_size = number(part(4, 4))
    namespace_size = number(F.substring(key, subject_size + 8, F.lit(1)))
    out = {
        "key_group": number(part(1, 2)),
        "subject": F.substring(key, F.lit(8), subject_size),
        "namespace": F.substring(key, subject_size + 9, namespace_size),
        "entry": F.substring(key, subject_size + namespace_size + 9, F.octet_length(key)),
    }
    return {n: F.when(whole, c) for n, c in out.items()}
