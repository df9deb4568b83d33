"""Deterministic identifiers and row hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two high bits of the variant digit are 10.
HEX_DIGITS = "0123456789abcdef"
VARIANT_DIGITS = "89ab89ab89ab89ab"


def uuid5(name: Column | str, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID (RFC 4122, version 5) of a string column; NULL stays NULL."""
    name = (F.col(name) if isinstance(name, str) else name).cast("string")
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.translate(F.substring(digest, 17, 1), HEX_DIGITS, VARIANT_DIGITS)
    dash = F.lit("-")
    return F.concat(
        F.substring(digest, 1, 8), dash,
        F.substring(digest, 9, 4), dash,
        F.lit("5"), F.substring(digest, 14, 3), dash,
        variant, F.substring(digest, 18, 3), dash,
        F.substring(digest, 21, 12),
    )


# A text that is no UUID gets a byte at its end, or two where one would give it the length of a packed one.
_ONE, _TWO = b"\x01", b"\x02\x02"
_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def packed_text(text: Column | str) -> Column:
    """The 16 bytes of a UUID in lower case, other texts as they are with a mark: equal only for equal texts."""
    text = F.col(text) if isinstance(text, str) else text
    uuid_text = (F.length(text) == 36) & text.rlike(rf"\A{_UUID}\z")
    end = F.when(F.octet_length(text) == 15, F.lit(_TWO)).otherwise(F.lit(_ONE))
    return F.when(uuid_text, F.unhex(F.translate(text, "-", ""))).otherwise(F.concat(text.cast("binary"), end))


def unpacked_text(packed: Column | str) -> Column:
    """The text that ``packed_text`` was given."""
    packed = F.col(packed) if isinstance(packed, str) else packed
    digits = F.lower(F.hex(packed))
    places = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    dashed = F.concat_ws("-", *[F.substring(digits, start, n) for start, n in places])
    added = F.when(F.substring(packed, -1, 1) == F.lit(_TWO[:1]), len(_TWO)).otherwise(len(_ONE))
    bare = F.substring(packed, F.lit(1), F.octet_length(packed) - added).cast("string")
    return F.when(F.octet_length(packed) == 16, dashed).when(packed.isNotNull(), bare)


def synthetic_key(*cols: Column | str) -> Column:
    """Composite key ``a:b``; NULL when a part is NULL."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit(":"), part)
    return joined


def external_id(source: str, pk: Iterable[str]) -> Column:
    """Key of a row across sources: ``<source>:<pk>``."""
    return synthetic_key(F.lit(source), *pk)


def _typed_parts(cols: Iterable[str]) -> list[Column]:
    parts: list[Column] = []
    for name in cols:
        # Hashes skip NULLs, so the position of a NULL is hashed as well.
        parts += [F.col(name).isNull(), F.col(name)]
    return parts


def row_fingerprint(cols: Iterable[str]) -> Column:
    """64-bit hash used to compare two versions of the *same* key."""
    return F.xxhash64(*_typed_parts(cols))


def content_hash(cols: Iterable[str]) -> Column:
    """sha-256 of the row content: a change detector for tables without a timestamp."""
    packed = F.struct(*[F.col(c) for c in cols])
    return F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)


def row_id() -> Column:
    """Random row id stamped on raw rows."""
    return F.expr("uuid()")


def load_stamp() -> Column:
    """Time of the load."""
    return F.current_timestamp()
