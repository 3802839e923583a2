"""Identifiers made of names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "glyphmax:pages")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version 5 UUID of a name, as text, without leaving the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
