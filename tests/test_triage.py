"""Response parsing and validation guardrails (table of bad inputs)."""

import pytest

from vigil.operators import triage as T


def _one(spark, text):
    df = spark.createDataFrame([(text,)], "response_text string")
    return T.validate_response(T.parse_response(df)).first()


GOOD = "<result>CRITICAL</result><confidence>0.9</confidence><reasoning>Base64 PowerShell with C2</reasoning><action>Isolate</action><ioc> 1.2.3.4 </ioc><ioc> </ioc>"


def test_good_response(spark):
    r = _one(spark, GOOD)
    assert r["is_valid"] and r["triage_result"] == "CRITICAL" and r["confidence"] == 0.9
    assert r["next_actions"] == ["Isolate"] and r["iocs_clean"] == ["1.2.3.4"]


@pytest.mark.parametrize(
    "text,err",
    [
        (GOOD.replace("0.9", "-0.1"), "Confidence must be between 0 and 1"),
        (GOOD.replace("0.9", "1.5"), "Confidence must be between 0 and 1"),
        (GOOD.replace("CRITICAL", "MAYBE"), "Invalid triage_result"),
        (GOOD.replace("<action>Isolate</action>", ""), T.ERR_NO_ACTIONS),
        (GOOD.replace("<action>Isolate</action>", "<action>  </action>"), T.ERR_BLANK_ACTIONS),
        (GOOD.replace("Base64 PowerShell with C2", "short"), T.ERR_REASONING),
    ],
)
def test_bad_responses_quarantined(spark, text, err):
    r = _one(spark, text)
    assert not r["is_valid"] and any(err in e for e in r["errors"])


def test_defaults_for_missing_fields(spark):
    r = _one(spark, "<action>Look</action> free text answer without tags")
    assert r["triage_result"] == "NEEDS_INVESTIGATION" and r["confidence"] == 0.0
    assert r["reasoning"].startswith("<action>")


def test_risk_bounds(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(GOOD,)], "response_text string")
    for risk, ok in ((-1, False), (101, False), (100, True)):
        r = T.validate_response(T.parse_response(df), risk=F.lit(risk)).first()
        assert r["is_valid"] == ok
