"""Template filling as a Column expression: ``"a {x} b"`` → ``concat('a ', x, ' b')``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{(\w+)\}")


def fmt(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` placeholders with (string-cast) columns; NULL if any column is NULL."""
    parts: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")
