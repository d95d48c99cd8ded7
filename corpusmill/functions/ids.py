"""Prefixed identifiers. They are hashes of a key, so a retried task gives the same id."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = ("doc", "col", "chk", "pipe", "ingjob")


class IdError(ValueError):
    pass


def new_id(prefix: str, *key) -> str:
    if prefix not in PREFIXES:
        raise IdError(f"unknown prefix {prefix!r}")
    return f"{prefix}_{hashlib.sha256('|'.join(map(str, key)).encode()).hexdigest()[:26]}"


def id_column(prefix: str, *key: Column) -> Column:
    """The same id in a plan."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256), 1, 26))


def parse_id(value: str, prefix: str | None = None) -> tuple[str, str]:
    """(prefix, suffix); an empty id, an unknown prefix or another prefix than asked is an error."""
    head, sep, tail = (value or "").partition("_")
    if not sep or not tail or head not in PREFIXES:
        raise IdError(f"not an id: {value!r}")
    if prefix and head != prefix:
        raise IdError(f"expected prefix {prefix!r}, got {head!r}")
    return head, tail


def to_sql(value: str | None) -> str | None:
    """The nil id is stored as NULL."""
    return value or None


def from_sql(value: str | None) -> str:
    """NULL prints as the empty string."""
    return value or ""


def to_bson(value: str | None) -> tuple[int, bytes]:
    """(BSON type, bytes): a string (2) with its length and a closing zero, or null (10) for the nil id."""
    if not value:
        return 10, b""
    data = value.encode() + b"\0"
    return 2, len(data).to_bytes(4, "little") + data


def from_bson(kind: int, data: bytes) -> str:
    """The id of a BSON string; null is the nil id, any other type is an error."""
    if kind == 10:
        return ""
    if kind != 2 or len(data) < 5 or int.from_bytes(data[:4], "little") != len(data) - 4 or data[-1] != 0:
        raise IdError(f"not a BSON id (type {kind})")
    value = data[4:-1].decode()
    if value:
        parse_id(value)
    return value


def has_prefix(c: Column, prefix: str) -> Column:
    return F.split(c, "_")[0] == prefix
