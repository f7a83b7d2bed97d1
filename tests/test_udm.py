"""UDM alert documents: JSON round trip, flatten, conversion, nested scrub."""

from pyspark.sql import functions as F

from vigil.functions.scrub import has_pii
from vigil.sources import udm as U


def test_udm_pipeline(spark, sf_small):
    bodies = U.udm_json(spark, sf_small)
    parsed = U.parse_udm(bodies).cache()
    n_alerts = parsed.count()
    assert n_alerts > 0 and parsed.filter(F.size("errors") > 0).count() == 0
    # severity defaults to MEDIUM when the document has none
    assert parsed.filter(F.col("severity").isNull()).count() == 0
    total_events = parsed.agg(F.sum(F.size("udm_events"))).first()[0]
    assert U.flatten_udm(parsed).count() == total_events
    conv = U.udm_to_alert(parsed).collect()
    for r in conv:
        assert r["alert_id"].startswith("chronicle_ru_idor_seq_enum_")
        assert r["title"] == "Chronicle: idor_sequential_enumeration"
        n = r["raw_data"]["distinct_resources"] or r["raw_data"]["udm_event_count"]
        assert r["description"].endswith(f"Detected {n} matching events.")
        assert len(r["raw_data"]["udm_sample_events"]) <= 3
    scrubbed = U.scrub_udm(parsed.drop("body", "errors"))
    flat = scrubbed.select(F.explode("udm_events").alias("e")).select(
        F.col("e.principal.user.email_addresses")[0].alias("mail"), F.col("e.principal.ip")[0].alias("ip"),
        F.element_at(F.col("e.security_result"), 1)["description"].alias("d"),
    )
    assert flat.filter(has_pii("mail") | has_pii("ip") | has_pii("d")).count() == 0
