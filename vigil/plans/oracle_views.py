"""DuckDB text of the derived inputs (must mirror ``vigil.sources.fixtures``)."""

from __future__ import annotations


def access_log_sql(id_prefix: str = "") -> str:
    k = "json_extract_string(props, '$.k')"
    rid = f"'{id_prefix}' || {k}" if id_prefix else k
    return f"""
    SELECT event_id,
           epoch_us(ts) AS ts_us,
           'user_' || user_id AS user_id,
           'sess_' || user_id AS session_id,
           {rid} AS resource_id,
           'loan_application' AS resource_type,
           CASE WHEN event_id % 5 = 0 THEN NULL
                WHEN event_id % 5 = 1 THEN 'user_' || user_id
                ELSE 'user_' || (user_id + 1 + CAST({k} AS BIGINT)) END AS resource_owner_id,
           event_type <> 'error' AS success,
           CASE WHEN event_type <> 'error' THEN 200 ELSE 403 END AS http_status,
           'GET' AS http_method,
           '/api/v' || (event_id % 2 + 1) || '/consumer/loan_applications/' || {rid} AS request_path,
           'u' || user_id || '@mail.example.com' AS user_email,
           '10.20.' || (user_id % 256) || '.' || {k} AS client_ip,
           'agent/' || event_type AS user_agent
    FROM events"""


def with_views(**views: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix from named SELECT texts."""
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in views.items()) + "\n"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick_sql(values: list[str], idx: str) -> str:
    return "([" + ", ".join(_lit(v) for v in values) + f"])[({idx}) + 1]"


def scrub_sql(expr: str, entities=None, tokens=None, hostnames: bool = False) -> str:
    """Nested ``regexp_replace`` chain — same published patterns, same order."""
    from vigil.functions.scrub import _table

    out = expr
    for _, pat, tok in _table(entities, tokens, hostnames):
        out = f"regexp_replace({out}, {_lit(pat)}, {_lit(tok)}, 'g')"
    return out


def entity_counts_sql(expr: str, entities=None) -> list[tuple[str, str]]:
    from vigil.functions.scrub import _table

    cols = []
    cur = expr
    for name, pat, tok in _table(entities):
        cols.append((name.lower(), f"CAST(coalesce(len(regexp_extract_all({cur}, {_lit(pat)})), 0) AS BIGINT)"))
        cur = f"regexp_replace({cur}, {_lit(pat)}, {_lit(tok)}, 'g')"
    return cols


def has_pii_sql(expr: str) -> str:
    from vigil.functions.scrub import PATTERNS

    return "coalesce(" + " OR ".join(f"regexp_matches({expr}, {_lit(p)})" for _, p, _ in PATTERNS) + ", false)"


def alerts_sql() -> str:
    from vigil.sources.fixtures import ALERT_HOSTS, ALERT_PHRASES, ALERT_USERS, SEVERITIES

    return f"""
    SELECT 'alert_' || doc_id AS alert_id, doc_id,
           {pick_sql(SEVERITIES, 'doc_id % 4')} AS severity,
           source,
           'Document alert ' || doc_id || ' (' || lang || ')' AS title,
           {pick_sql(ALERT_PHRASES, 'doc_id % 7')} || ' ' || coalesce(text, '') AS description,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
           {pick_sql(ALERT_USERS, 'doc_id % 6')} AS affected_user,
           {pick_sql(ALERT_HOSTS, 'doc_id % 5')} AS affected_host,
           ['ioc-' || (doc_id % 500 + 1), '10.0.0.' || (doc_id % 100 + 1), md5(CAST(doc_id AS VARCHAR)),
            'evil-' || (doc_id % 13) || '.example.net', sha256(CAST(doc_id AS VARCHAR)),
            'http://bad.example.org/p/' || (doc_id % 17)] AS iocs,
           CAST(doc_id % 6 AS BIGINT) AS distinct_resources
    FROM documents"""


def customer_pii_sql() -> str:
    return """
    SELECT c_custkey, c_nationkey, ssn, phone, passport, card, email,
           'Customer ' || c_name || ' ssn ' || ssn || ' phone ' || phone || ' passport ' || passport ||
           ' card ' || card || ' mail ' || email || ' from 172.16.' || (c_custkey % 256) || '.9' AS text
    FROM (
      SELECT c_custkey, c_name, c_nationkey,
             substr(p9, 1, 3) || '-' || substr(p9, 4, 2) || '-' || substr(p9, 6, 4) AS ssn,
             substr(p10, 1, 3) || sep || substr(p10, 4, 3) || sep || substr(p10, 7, 4) AS phone,
             'X' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS passport,
             '4111 ' || substr(p10, 1, 4) || ' ' || substr(p10, 5, 4) || ' ' || lpad(substr(p10, 9, 2), 4, '0') AS card,
             'cust' || c_custkey || '@bank.example.com' AS email
      FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS p9, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS p10,
                   CASE c_custkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '.' ELSE '' END AS sep
            FROM customer))"""


def ownership_ops_sql(removes: bool = False, clears: bool = False) -> str:
    q = "SELECT user_id, resource_id, ts_us, 'record' AS op FROM access_log WHERE success"
    if removes:
        q += (" UNION ALL SELECT a.user_id, a.resource_id, a.ts_us, 'remove' FROM access_log a JOIN events e USING (event_id)"
              " WHERE e.event_type = 'purchase' AND a.event_id % 7 = 3")
    if clears:
        q += (" UNION ALL SELECT a.user_id, NULL, a.ts_us, 'clear' FROM access_log a JOIN events e USING (event_id)"
              " WHERE e.event_type = 'signup' AND a.event_id % 11 = 4")
    return q


def ownership_state_sql(ttl_us: int) -> dict[str, str]:
    """Views over ``ops`` giving records with their ttl-session (plain windows
    per user — the independent formulation the bucketed plan is checked against)."""
    return dict(
        ops_s=("SELECT *, ts_us * 4 + CASE op WHEN 'clear' THEN 0 WHEN 'record' THEN 1 WHEN 'remove' THEN 2 END AS seq FROM ops"),
        pts=("SELECT DISTINCT user_id, ts_us, seq FROM ops_s WHERE op IN ('record', 'clear')"),
        pts2=("""SELECT *, max(CASE WHEN seq % 4 = 1 THEN seq END) OVER w AS prev_rec,
                          max(CASE WHEN seq % 4 = 0 THEN seq END) OVER w AS prev_clear
                 FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
        sess=(f"""SELECT user_id, seq, CAST(sum(CASE WHEN seq % 4 = 1 THEN
                       CASE WHEN prev_rec IS NULL OR ts_us - prev_rec // 4 >= {ttl_us} OR coalesce(prev_clear, -1) > prev_rec
                            THEN 1 ELSE 0 END END)
                   OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ttl_session
                 FROM pts2"""),
        recs_s=("""SELECT DISTINCT o.user_id, o.resource_id, o.ts_us, o.seq, s.ttl_session
                   FROM ops_s o JOIN sess s ON o.user_id = s.user_id AND o.seq = s.seq WHERE o.op = 'record'"""),
    )


def is_owner_sql(ttl_us: int, probes: str) -> str:
    """SELECT probe_id, owned for ``probes(probe_id, user_id, resource_id, ts_us)``."""
    return f"""
    SELECT p.probe_id,
           coalesce(u.last_rec IS NOT NULL AND coalesce(u.last_clear, -1) < u.last_rec
                    AND p.ts_us - u.last_rec // 4 < {ttl_us}
                    AND q.last_is_rec AND q.last_session = u.cur_session, false) AS owned
    FROM {probes} p
    LEFT JOIN LATERAL (
        SELECT max(r.seq) AS last_rec, max(r.ttl_session) AS cur_session,
               (SELECT max(c.seq) FROM ops_s c WHERE c.op = 'clear' AND c.user_id = p.user_id AND c.seq <= p.ts_us * 4 + 3) AS last_clear
        FROM recs_s r WHERE r.user_id = p.user_id AND r.seq <= p.ts_us * 4 + 3) u ON true
    LEFT JOIN LATERAL (
        SELECT arg_max(x.is_rec, x.seq) AS last_is_rec, arg_max(x.ttl_session, x.seq) AS last_session
        FROM (SELECT seq, true AS is_rec, ttl_session FROM recs_s r
               WHERE r.user_id = p.user_id AND r.resource_id = p.resource_id AND r.seq <= p.ts_us * 4 + 3
              UNION ALL
              SELECT seq, false, NULL FROM ops_s m
               WHERE m.op = 'remove' AND m.user_id = p.user_id AND m.resource_id = p.resource_id
                 AND m.seq <= p.ts_us * 4 + 3) x) q ON true"""


def http_requests_sql() -> str:
    """Requests with each header as its own column (h_<lower name>)."""
    return """
    SELECT o_orderkey AS request_id,
           CASE WHEN o_orderkey % 10 = 5 THEN '/api/v2/consumer/loan_applications/' || o_orderkey
                WHEN o_orderkey % 10 = 9 THEN '/api/loans/' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-' ||
                     substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 13, 4) || '-' ||
                     substr(md5(CAST(o_orderkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 21, 12)
                WHEN o_orderkey % 5 = 0 THEN '/consumer/loan_applications/' || o_orderkey
                WHEN o_orderkey % 5 = 1 THEN '/api/v' || (o_orderkey % 2 + 1) || '/loans/L' || o_orderkey
                WHEN o_orderkey % 5 = 2 THEN '/accounts/acc-' || o_orderkey
                WHEN o_orderkey % 5 = 3 THEN '/documents/doc_' || o_orderkey
                ELSE '/static/page/' || o_orderkey END AS path,
           CASE WHEN o_orderkey % 11 = 0 THEN 'POST' ELSE 'GET' END AS method,
           CASE o_orderstatus WHEN 'O' THEN 200 WHEN 'F' THEN 403 ELSE 404 END AS status,
           '192.0.2.' || (o_custkey % 256) AS client_host,
           CASE WHEN o_orderkey % 13 <> 0 THEN 'cust_' || o_custkey END AS h_x_user_id,
           'c' || o_custkey || '@shop.example.com' AS h_x_user_email,
           CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'dd-' || o_custkey END AS h_x_datadog_session_id,
           'view-' || o_orderkey AS h_x_datadog_view_id,
           'app-1' AS h_x_datadog_application_id,
           CASE WHEN o_orderkey % 17 <> 0 THEN 'ray-' || o_orderkey END AS h_cf_ray,
           'pl-' || o_orderkey AS h_x_pageload_id,
           'Mozilla/5.0 (' || o_orderpriority || ')' AS h_user_agent,
           CASE WHEN o_orderkey % 3 = 0 THEN '203.0.113.' || (o_orderkey % 256) || ', 10.0.0.1' END AS h_x_forwarded_for,
           CASE WHEN o_orderkey % 4 = 0 THEN 'theme=dark; session_id=sid-' || o_custkey || '; lang=en' END AS h_cookie,
           CASE WHEN o_orderkey % 4 = 1 THEN 'Bearer tok.' || o_custkey END AS h_authorization,
           CASE WHEN o_orderkey % 4 = 2 THEN 'acme-' || o_custkey END AS h_x_acme_id,
           epoch_us(o_orderdate) AS ts_us
    FROM orders"""


def url_resource_sql(path: str, extra: list[tuple[str, str]] | None = None) -> tuple[str, str]:
    from vigil.functions.telemetry import RESOURCE_PATTERNS

    pats = list(RESOURCE_PATTERNS) + list(extra or [])
    t = "CASE " + " ".join(f"WHEN regexp_matches({path}, {_lit(p)}) THEN {_lit(n)}" for n, p in pats) + " END"
    i = "CASE " + " ".join(f"WHEN regexp_matches({path}, {_lit(p)}) THEN regexp_extract({path}, {_lit(p)}, 1)" for n, p in pats) + " END"
    return t, i


def ioc_sightings_sql() -> str:
    return "SELECT 'ioc-' || l_partkey AS indicator, 'host-' || l_suppkey AS asset, epoch_us(l_shipdate) AS ts_us FROM lineitem"


def supplier_ip_sql(c: str) -> str:
    return f"'10.0.' || ({c} // 256 % 256) || '.' || ({c} % 256)"


def network_sql() -> str:
    return (f"SELECT {supplier_ip_sql('l_suppkey')} AS ip, 'host-' || (l_partkey % 50) AS asset, "
            "epoch_us(l_shipdate) AS ts_us FROM lineitem")


def reputation_sql() -> str:
    return f"SELECT {supplier_ip_sql('s_suppkey')} AS ip, CAST(abs(floor(s_acctbal)) % 100 AS INTEGER) AS reputation_score FROM supplier"


def logins_sql() -> str:
    return """SELECT e.event_id, 'user_' || e.user_id AS user_id, epoch_us(e.ts) AS ts_us,
                     coalesce(n.n_name, 'UNKNOWN') AS location,
                     '10.20.' || (e.user_id % 256) || '.' || (CAST(json_extract_string(e.props, '$.k') AS INTEGER) % 4) AS ip,
                     e.event_type AS agent
              FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""


def user_tags_sql(n: str) -> str:
    return f"list_filter([CASE WHEN {n} % 13 = 0 THEN 'qa_automation' END, CASE WHEN {n} % 17 = 0 THEN 'pentester' END], lambda x: x IS NOT NULL)"


def llm_responses_sql() -> str:
    return """
    SELECT 'alert_' || doc_id AS alert_id, doc_id,
      '<triage_analysis>' || chr(10) ||
      CASE WHEN doc_id % 23 = 4 THEN '' ELSE '<result> ' ||
           CASE WHEN doc_id % 11 = 3 THEN 'MAYBE' WHEN quality = 0 THEN 'FALSE_POSITIVE'
                WHEN toxic = 1 THEN 'CRITICAL_IDOR_ATTACK' ELSE 'NEEDS_INVESTIGATION' END || ' </result>' END ||
      chr(10) || '<confidence>' ||
      CASE WHEN doc_id % 13 = 5 THEN '1.5' WHEN doc_id % 13 = 6 THEN '-0.1' ELSE printf('%.2f', 0.5 + (doc_id % 50) / 100.0) END ||
      '</confidence>' || chr(10) || '<reasoning>' ||
      CASE WHEN doc_id % 17 = 7 THEN ' short ' ELSE chr(10) || '  Analyst-grade reasoning for document ' || doc_id || '.' || chr(10) END ||
      '</reasoning>' || chr(10) ||
      CASE WHEN doc_id % 19 = 2 THEN '<action>   </action>' WHEN doc_id % 19 = 3 THEN ''
           ELSE '<action> Review document ' || doc_id || ' </action><action>Notify owner</action>' END || chr(10) ||
      CASE WHEN doc_id % 7 = 0 THEN '<ioc>  </ioc>' ELSE '<ioc> ioc-' || doc_id || ' </ioc>' END ||
      chr(10) || '</triage_analysis>' AS response_text
    FROM labels"""


def raw_alerts_sql() -> str:
    return f"""
    SELECT alert_id, doc_id, CASE WHEN doc_id % 23 = 0 THEN 'SEVERE' ELSE severity END AS severity, source,
           CASE WHEN doc_id % 37 = 0 THEN '' ELSE title END AS title,
           CASE WHEN doc_id % 29 = 0 THEN NULL ELSE description END AS description,
           CASE WHEN doc_id % 31 = 0 THEN 'yesterday' ELSE timestamp END AS timestamp,
           affected_user, affected_host, iocs
    FROM ({alerts_sql()})"""


def edr_events_sql() -> str:
    return """SELECT 'ep-' || (l_orderkey % 100) AS endpoint_id, l_orderkey AS alert_id, l_orderkey * 10 + l_linenumber AS process_id,
       CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + l_linenumber - 1 END AS parent_process_id,
       'proc_' || lower(l_returnflag) || '.exe' AS process_name, 'C:\\data\\file_' || l_linenumber || '.dat' AS file_path,
       '198.18.' || (l_partkey // 256 % 256) || '.' || (l_partkey % 256) AS remote_ip,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'process_injected' WHEN l_returnflag = 'R' THEN 'registry_value_set'
            WHEN l_linestatus = 'F' THEN 'network_connection' ELSE 'process_created' END AS action,
       (['TA0004', 'TA0003', 'TA0010', 'TA0008', 'TA0002'])[(l_linenumber % 5) + 1] AS tactic,
       (['T1547', 'T1021', 'T1055', 'T1059'])[(l_linenumber % 4) + 1] AS technique,
       'threat-' || l_returnflag AS threat_name, epoch_us(l_shipdate) AS ts_us
FROM lineitem"""
