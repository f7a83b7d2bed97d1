"""EDR summaries and process lines on rows of their own."""

from vigil.operators import edr as J

_EVENT = "endpoint_id string, alert_id long, process_name string, file_path string, remote_ip string, ts_us long, threat_name string, tactic string"


def test_edr_summary_copies_no_row_and_shuffles_once(spark, capsys):
    rows = [("e", 1, "p", "f", None, 5, "t", "a"), ("e", 1, "p", "g", None, 9_000_005, None, "b"), ("e", 1, None, "f", None, 7, "t", "a"), (None, None, None, None, "ip", 3, None, None)]
    out = J.edr_summary(spark.createDataFrame(rows, _EVENT))
    got = {r["alert_id"]: tuple(r)[2:] for r in out.collect()}
    assert got == {
        1: (3, 1, 2, 0, 5, 9_000_005, 9, ["t"], ["a", "b"]),
        None: (1, 0, 0, 1, 3, 3, 0, [], []),
    }
    out.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    assert "Expand" not in plan
    assert plan.count("Exchange ") == 1


def test_process_ancestry_rounds_take_open_lines_only(spark, monkeypatch):
    from vigil.operators import ownership

    written = []
    real = ownership.materialize

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(ownership, "materialize", counted)
    rows = [("e", i, i - 1 if i > 1 else None, f"p{i}", i) for i in range(1, 6)]  # one line of five
    rows += [("e", 100 + i, None, "alone", 1) for i in range(20)]
    rows += [("e", 200, 201, "a", 1), ("e", 201, 200, "b", 2), ("e", 300, 300, "self", 1), ("e", 400, 399, "orphan", 1)]
    rows += [("e", 500, None, "late", 9), ("e", 500, None, "later", 10), ("e", 501, 500, "child", 4), (None, 1, 1, "null", 1)]
    ev = spark.createDataFrame(rows, "endpoint_id string, process_id long, parent_process_id long, process_name string, ts_us long")
    got = {r["process_name"]: (r["ancestors"], r["cyclic"]) for r in J.process_ancestry(ev).collect() if r["process_name"] != "alone"}
    assert got == {
        "p1": ([], False), "p2": (["p1"], False), "p3": (["p2", "p1"], False), "p4": (["p3", "p2", "p1"], False),
        "p5": (["p4", "p3", "p2", "p1"], False), "a": (["b"], True), "b": (["a"], True), "self": ([], True),
        "orphan": ([], False), "late": ([], False), "later": ([], False), "child": (["late"], False), "null": ([], False),
    }
    assert written[:2] == [len(rows), len(rows)]
    assert max(written[2:]) <= 6
