"""PII scrubbing as JVM-side expressions.

Text scrubbing is a chain of ``regexp_replace`` calls, so it stays inside
whole-stage codegen; nested values are scrubbed by an expression builder that
walks the Spark schema (``transform`` for arrays, ``transform_values`` for
maps, field-wise ``struct`` rebuild for structs). Map keys, numbers,
booleans and nulls pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's results: the six regex-mode
# entity patterns, applied in this order, and their replacement tokens.
PATTERNS: list[tuple[str, str, str]] = [
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
    ("CREDIT_CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CC_REDACTED]"),
    ("PHONE_NUMBER", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE_REDACTED]"),
    ("US_PASSPORT", r"\b[A-Z]{1,2}\d{6,9}\b", "[PASSPORT_REDACTED]"),
]
# Tiered masking (documented policy): card numbers deleted, SSNs vaulted.
TIERED_TOKENS = {"CREDIT_CARD": "[PAN_DELETED]", "US_SSN": "[SSN_VAULTED]"}
# Optional hostname entity (off by default; regex mode has no hostname pattern).
HOSTNAME_PATTERN = ("HOSTNAME", r"\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:internal|local|corp|lan)\b", "[HOSTNAME_REDACTED]")

ALL_ENTITIES = [p[0] for p in PATTERNS]


def _table(entities=None, tokens=None, hostnames: bool = False):
    chosen = [p for p in PATTERNS if entities is None or p[0] in entities]
    if hostnames:
        chosen.append(HOSTNAME_PATTERN)
    tokens = tokens or {}
    return [(name, pat, tokens.get(name, tok)) for name, pat, tok in chosen]


# Cheap necessary conditions: every pattern but the e-mail one needs an ASCII
# digit, the e-mail one needs an '@'. Tokens contain neither, so a text that
# fails a gate is left untouched by those patterns — the gates only skip work.
_NEEDS_AT = {"EMAIL_ADDRESS"}
_NEEDS_DIGIT = {"IP_ADDRESS", "US_SSN", "CREDIT_CARD", "PHONE_NUMBER", "US_PASSPORT"}


def scrub_text(col: Column | str, entities=None, tokens=None, hostnames: bool = False) -> Column:
    """Apply the patterns in order; NULL and '' stay as they are.

    Consecutive patterns that share a gate are replaced as one nested chain
    under a single ``CASE WHEN gate`` (each input referenced once per gate)."""
    c = F.col(col) if isinstance(col, str) else col
    gates = {"at": F.instr(c, "@") > 0, "digit": c.rlike("[0-9]")}

    def gate_of(name):
        return "at" if name in _NEEDS_AT else "digit" if name in _NEEDS_DIGIT else None

    table = _table(entities, tokens, hostnames)
    i = 0
    while i < len(table):
        g = gate_of(table[i][0])
        chain = c
        j = i
        while j < len(table) and gate_of(table[j][0]) == g:
            chain = F.regexp_replace(chain, table[j][1], table[j][2])
            j += 1
        c = chain if g is None else F.when(gates[g], chain).otherwise(c)
        i = j
    return c


def entity_counts(col: Column | str, entities=None) -> Column:
    """Struct of match counts per entity, counted on the progressively
    scrubbed text (each pattern sees the output of the previous ones)."""
    c = F.col(col) if isinstance(col, str) else col
    fields = []
    for name, pat, tok in _table(entities):
        fields.append(F.coalesce(F.regexp_count(c, F.lit(pat)), F.lit(0)).cast("bigint").alias(name.lower()))
        c = F.regexp_replace(c, pat, tok)
    return F.struct(*fields)


def has_pii(col: Column | str, entities=None) -> Column:
    """True when any pattern still matches."""
    c = F.col(col) if isinstance(col, str) else col
    conds = [c.rlike(pat) for _, pat, _ in _table(entities)]
    out = conds[0]
    for x in conds[1:]:
        out = out | x
    return F.coalesce(out, F.lit(False))


# Stand-ins for an escaped backslash and an escaped quote while a JSON text is cut at its quotes:
# valid JSON holds no control characters but tab, line feed and carriage return.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scrub_json_leaf(raw: Column, **kw) -> Column:
    """A string of a JSON text, without its quotes: decoded, scrubbed, and written anew if that changed it."""

    def decoded(as_written: Column) -> Column:
        quoted = F.concat(F.lit('["'), as_written, F.lit('"]'))
        return F.when(F.contains(as_written, F.lit("\\")), F.from_json(quoted, "array<string>").getItem(0)).otherwise(as_written)

    def rewritten(text: Column, scrubbed: Column) -> Column:
        written = _bound(F.to_json(F.array(scrubbed)), lambda a: F.substring(a, F.lit(3), F.length(a) - 4))  # of ["..."]
        return F.when(scrubbed == text, raw).otherwise(written)

    as_written = F.replace(F.replace(raw, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    return _bound(
        _bound(as_written, decoded),
        lambda text: _bound(scrub_text(text, **kw), lambda scrubbed: rewritten(text, scrubbed)),
    )


def scrub_json(col: Column | str, **kw) -> Column:
    """C2 on a raw JSON text of any shape and depth: string leaves are scrubbed; keys, numbers,
    booleans, nulls and white space stay as they are, byte for byte, as do leaves without a finding.

    A JSON text cut at its unescaped quotes has string contents at the odd places, and a string
    is a key where a colon follows it; so no schema and no recursion is needed, and the work is
    linear: the cut is made once and bound, not again for every part. NULL stays NULL. A text that
    is no valid JSON (or nested deeper than Spark parses) is scrubbed as one plain text, keys
    included: nothing leaves it unscrubbed."""

    def scrubbed(c: Column) -> Column:
        marked = F.replace(F.replace(c, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))

        def parts_scrubbed(parts: Column) -> Column:
            def part(x: Column, i: Column) -> Column:
                key = F.get(parts, i + 1).rlike(r"^\s*:")
                return F.when((i % 2 == 1) & ~key, _scrub_json_leaf(x, **kw)).otherwise(x)

            return F.array_join(F.transform(parts, part), '"')

        joined = _bound(F.split(marked, '"', -1), parts_scrubbed)
        done = F.replace(F.replace(joined, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
        return F.when(F.try_parse_json(c).isNull(), scrub_text(c, **kw)).otherwise(done)

    return _bound(F.col(col) if isinstance(col, str) else col, scrubbed)


def scrub_value(col: Column, dtype: T.DataType, **kw) -> Column:
    """Recursively scrub every string leaf of a typed value.

    A VARIANT goes through its JSON text: dates and times in it become strings."""
    if isinstance(dtype, T.StringType):
        return scrub_text(col, **kw)
    if isinstance(dtype, T.VariantType):
        return F.parse_json(scrub_json(F.to_json(col), **kw))
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(*[scrub_value(col.getField(f.name), f.dataType, **kw).alias(f.name) for f in dtype.fields])
        return F.when(col.isNull(), F.lit(None).cast(dtype)).otherwise(rebuilt)
    if isinstance(dtype, T.ArrayType):
        if not _has_string(dtype.elementType):
            return col
        return F.transform(col, lambda x: scrub_value(x, dtype.elementType, **kw))
    if isinstance(dtype, T.MapType):
        if not _has_string(dtype.valueType):
            return col
        return F.transform_values(col, lambda _k, v: scrub_value(v, dtype.valueType, **kw))
    return col


def _has_string(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.StringType, T.VariantType)):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has_string(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_string(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_string(dtype.valueType)
    return False


def scrub_columns(df, columns=None, **kw):
    """Scrub the named (default: all) columns of a DataFrame in place."""
    names = set(columns or df.columns)
    return df.select(
        *[
            scrub_value(F.col(f"`{f.name}`"), f.dataType, **kw).alias(f.name) if f.name in names else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def tokenize(col: Column | str, salt: str, prefix: str = "usr_", length: int = 8) -> Column:
    """C11: deterministic, non-reversible token ``prefix + first hex chars of sha256(salt||x)``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, length))
    )


def generalize_location(col: Column | str) -> Column:
    """Keep the text before the first comma (untrimmed)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split(c, ",", 2).getItem(0)
