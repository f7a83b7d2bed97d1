"""Greedy span grouping / suppression and windowed rules."""

from vigil.operators import rules as R

US = 1_000_000


def test_greedy_groups(spark):
    df = spark.createDataFrame([(i, "s", t * US) for i, t in enumerate([0, 100, 290, 310, 400, 700])],
                               "event_id long, session_id string, ts_us long")
    g = R.greedy_span_groups(df, "session_id", "ts_us", 300 * US).collect()
    sizes = {}
    for r in g:
        sizes[r["group_start_us"]] = sizes.get(r["group_start_us"], 0) + 1
    assert sorted(sizes.values(), reverse=True) == [3, 2, 1]


def test_suppression(spark):
    df = spark.createDataFrame([(i, "u", t * US) for i, t in enumerate([0, 10, 3600 * 5, 3600 * 5 + 1])],
                               "event_id long, user_id string, ts_us long")
    fired = sorted((r["ts_us"], r["fired"]) for r in R.suppress_alerts(df, "user_id", "ts_us", 5 * 3600).collect())
    assert [f for _, f in fired] == [True, False, True, False]


def _greedy(times, span):
    out, start = {}, None
    for i, t in sorted(times, key=lambda x: (x[1], x[0])):
        if start is None or t > start + span:
            start = t
        out[i] = start
    return out


def test_greedy_groups_match_sequential_fold(spark):
    import random

    rnd = random.Random(11)
    rows = [(i, f"k{rnd.randrange(3)}", rnd.randrange(0, 5000) * US) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, session_id string, ts_us long")
    got = {r["event_id"]: r["group_start_us"] for r in R.greedy_span_groups(df, "session_id", "ts_us", 250 * US).collect()}
    want = {}
    for k in {r[1] for r in rows}:
        want.update(_greedy([(i, t) for i, kk, t in rows if kk == k], 250 * US))
    assert got == want
