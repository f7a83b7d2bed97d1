"""PII scrubbing: reference examples, nested values, brute-force parity, invariants."""

import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import scrub as S
from vigil.sources.tables import table


def py_scrub(text, entities=None, tokens=None):
    """Plain-Python application of the same ordered pattern list."""
    if not text:
        return text
    for _, pat, tok in S._table(entities, tokens):
        text = re.sub(pat, tok, text)
    return text


def _scrub_one(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(S.scrub_text("t", **kw).alias("s")).first()["s"]


@pytest.mark.parametrize(
    "text,token",
    [
        ("Login by john.doe@acme.com failed", "[EMAIL_REDACTED]"),
        ("from 192.168.1.100 to 10.0.0.50", "[IP_REDACTED]"),
        ("SSN 123-45-6789 on file", "[SSN_REDACTED]"),
        ("card 4532-1234-5678-9010", "[CC_REDACTED]"),
        ("card 4532 1234 5678 9010", "[CC_REDACTED]"),
        ("card 4532123456789010", "[CC_REDACTED]"),
        ("call 555-123-4567", "[PHONE_REDACTED]"),
        ("call 555.123.4567", "[PHONE_REDACTED]"),
        ("call 5551234567", "[PHONE_REDACTED]"),
        ("passport AB1234567", "[PASSPORT_REDACTED]"),
    ],
)
def test_entity_tokens(spark, text, token):
    out = _scrub_one(spark, text)
    assert token in out
    assert out == py_scrub(text)


def test_null_and_empty_unchanged(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    got = [r["s"] for r in df.select(S.scrub_text("t").alias("s")).collect()]
    assert got == [None, ""]


def test_nested_struct_array_map(spark):
    schema = T.StructType([
        T.StructField("user", T.StringType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("ips", T.ArrayType(T.StringType())),
        T.StructField("payment", T.StructType([
            T.StructField("card", T.StringType()),
            T.StructField("billing", T.MapType(T.StringType(), T.StringType())),
        ])),
    ])
    row = ("admin@corp.com", 7, ["10.0.0.1", "ok"], ("4111 1111 1111 1111", {"admin@corp.com": "555-867-5309"}))
    df = spark.createDataFrame([row], schema)
    out = S.scrub_columns(df).first()
    assert out["user"] == "[EMAIL_REDACTED]"
    assert out["count"] == 7
    assert out["ips"] == ["[IP_REDACTED]", "ok"]
    assert out["payment"]["card"] == "[CC_REDACTED]"
    # map keys are untouched, values scrubbed
    assert out["payment"]["billing"] == {"admin@corp.com": "[PHONE_REDACTED]"}


def test_documents_match_python(spark, sf_small):
    docs = table(spark, sf_small, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", S.scrub_text("text").alias("s")).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == py_scrub(r["text"])


def test_scrub_idempotent_and_leak_free(spark, sf_small):
    docs = table(spark, sf_small, "documents").select(S.scrub_text("text").alias("s"))
    twice = docs.select((S.scrub_text("s") == F.col("s")).alias("same"), S.has_pii("s").alias("leak"))
    assert twice.filter(~F.col("same")).count() == 0
    assert twice.filter("leak").count() == 0


def test_tiered_tokens(spark):
    out = _scrub_one(spark, "pan 4532-1234-5678-9010 ssn 123-45-6789 mail a@b.io", tokens=S.TIERED_TOKENS)
    assert "[PAN_DELETED]" in out and "[SSN_VAULTED]" in out and "[EMAIL_REDACTED]" in out


def test_entity_counts_progressive(spark):
    df = spark.createDataFrame([("a@b.com 10.1.2.3 10.1.2.4 123-45-6789",)], "t string")
    c = df.select(S.entity_counts("t").alias("c")).select("c.*").first().asDict()
    assert c["email_address"] == 1 and c["ip_address"] == 2 and c["us_ssn"] == 1 and c["phone_number"] == 0


def test_tokenize_deterministic(spark):
    df = spark.createDataFrame([("user_1",), ("user_1",), ("user_2",)], "u string")
    toks = [r["t"] for r in df.select(S.tokenize("u", "salt").alias("t")).collect()]
    assert toks[0] == toks[1] != toks[2] and toks[0].startswith("usr_") and len(toks[0]) == 12


def _walk(value):
    if isinstance(value, str):
        return py_scrub(value)
    if isinstance(value, list):
        return [_walk(v) for v in value]
    if isinstance(value, dict):
        return {k: _walk(v) for k, v in value.items()}
    return value


_BITS = ["a@b.io", "10.0.0.1", "123-45-6789", '"', "\\", "\n", "é", "\U0001f600", ":", " ", "plain", "{", "]", ",", "\x01", "\x02", "\\u0041"]


def _random_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 5 else 5)
    text = lambda: "".join(rng.choice(_BITS) for _ in range(rng.randrange(6)))
    if kind < 3:
        return text()
    if kind < 5:
        return rng.choice([None, True, False, 5551234567, 4111111111111111, -1.5, 0])
    if kind < 7:
        return {text() + str(i): _random_json(rng, depth + 1) for i in range(rng.randrange(4))}
    return [_random_json(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_raw_json_equals_tree_walk(spark):
    import json
    import random

    rng = random.Random(5)
    values = [_random_json(rng) for _ in range(400)]
    raw = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=[None, 1][i % 3 == 0]) for i, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, j string")
    for r in df.select("i", "j", S.scrub_json("j").alias("s")).collect():
        assert json.loads(r["s"]) == _walk(values[r["i"]]), r["j"]
        if _walk(values[r["i"]]) == values[r["i"]]:
            assert r["s"] == r["j"]  # nothing found: byte for byte


def test_raw_json_odd_rows(spark):
    deep = "[" * 600 + '"a@b.io"' + "]" * 600
    long = '"' + "a\\n\\\"" * 50_000 + ' 10.0.0.1"'
    rows = {None: None, "": "", "12": "12", '"a@b.io"': '"[EMAIL_REDACTED]"', "{a@b.io": "{[EMAIL_REDACTED]",
            '{"k":"a@b.io"': '{"k":"[EMAIL_REDACTED]"', deep: deep.replace("a@b.io", "[EMAIL_REDACTED]"),
            long: long.replace("10.0.0.1", "[IP_REDACTED]")}
    df = spark.createDataFrame([(k,) for k in rows], "j string").select("j", S.scrub_json("j").alias("s"))
    assert {r["j"]: r["s"] for r in df.collect()} == rows
    assert df.limit(0).count() == 0


def test_variant_leaves_are_scrubbed(spark):
    df = spark.sql("""SELECT parse_json('{"a@b.io":["10.0.0.1",5551234567,{"x":"a@b.io"}]}') AS v, 'a@b.io' AS t""")
    got = S.scrub_columns(df).select(F.to_json("v").alias("v"), "t").first()
    assert got["v"] == '{"a@b.io":["[IP_REDACTED]",5551234567,{"x":"[EMAIL_REDACTED]"}]}' and got["t"] == "[EMAIL_REDACTED]"


def test_scrub_json_work_grows_with_the_text(spark):
    """Four times the leaves must not take sixteen times the time: the text is cut once, not per part."""
    import json
    import time

    from pyspark.sql import functions as F

    from vigil.functions.scrub import scrub_json

    def seconds(leaves):
        text = json.dumps([f"word {i}" for i in range(leaves)] + ["a@b.example.com"])
        df = spark.range(4, numPartitions=1).select(F.lit(text).alias("t"), "id")
        df = df.select("id", scrub_json(F.concat("t", F.repeat(F.lit(" "), F.col("id").cast("int")))).alias("t"))
        began = time.time()
        rows = df.collect()
        assert all(json.loads(r["t"])[-1] == "[EMAIL_REDACTED]" for r in rows)
        return time.time() - began

    seconds(10)
    assert seconds(8000) < 8 * max(seconds(2000), 1.0)
