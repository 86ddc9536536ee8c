"""A raw lake made from the driver's tables: text columns, versions, tombstones, JSON.

The definitions are plain SQL that Spark and DuckDB read alike, so both sides of a check
start from the same rows; what is done with them is written twice.  ``@name`` stands for
one of the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnlake.plans.adapter import Tables

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
META = ("_record_id", "_source_key", "_source_updated_at", "_deleted")


def _iso(ts: str) -> str:
    return f"CAST(date_trunc('second', {ts}) AS STRING)"


def _days(ts: str, n: str) -> str:
    return f"({ts} + (INTERVAL 1 DAY) * ({n}))"


def _versions(entity: str, key: str, updated: str, columns: dict[str, str], source: str, again: str, changed: dict[str, str], gone: str) -> str:
    """First versions of all rows, later ones where ``again`` holds, tombstones where ``gone`` does."""

    def rows(shift: int, deleted: bool, cols: dict[str, str], where: str) -> str:
        values = ", ".join(f"CAST({v} AS STRING) AS {c}" for c, v in cols.items())
        return f"SELECT '{entity}:' || {key} AS _record_id, {key} AS _source_key, {_days(updated, str(shift))} AS _source_updated_at, {'true' if deleted else 'false'} AS _deleted, {values} FROM ({source}) x WHERE {where}"

    return " UNION ALL ".join((rows(0, False, columns, "true"), rows(2, False, columns | changed, again), rows(3, True, dict.fromkeys(columns, "NULL"), gone)))


_ORDERS = "SELECT o_orderkey k, o_custkey ck, o_orderdate od, o_orderstatus st, o_orderpriority pr, c_nationkey nk FROM @orders LEFT JOIN @customer ON c_custkey = o_custkey"
_LINES = "SELECT l_orderkey k, l_orderkey * 100 + l_linenumber id, l_linenumber ln, min(l_suppkey) sk, min(l_shipdate) sd, min(l_linestatus) ls, max(l_tax) tax FROM @lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber"

RAW: dict[str, str] = {
    "incident": _versions(
        "servicenow:incident", "'inc' || k", "od",
        {
            "number": "CASE WHEN k % 97 = 0 THEN '' WHEN k % 101 = 0 THEN 'INC7' ELSE 'INC' || (1000000 + k) END",
            "opened_at": f"CASE WHEN k % 5 = 0 THEN replace({_iso('od')}, ' ', 'T') || 'Z' ELSE {_iso('od')} END",
            "resolved_at": f"CASE WHEN st = 'F' THEN {_iso(_days('od', 'k % 40 - 2'))} WHEN st = 'P' THEN 'soon' ELSE '' END",
            "closed_at": f"CASE WHEN st = 'F' THEN {_iso(_days('od', '45'))} ELSE '' END",
            "priority": "CASE pr WHEN '1-URGENT' THEN '1 - Critical' WHEN '2-HIGH' THEN '2' WHEN '3-MEDIUM' THEN '3 - Moderate' WHEN '5-LOW' THEN '7 - none' ELSE 'Planning' END",
            "state": "CASE WHEN k % 4 = 0 THEN '' WHEN st = 'F' THEN 'Resolved' WHEN st = 'O' THEN 'IN PROGRESS' ELSE 'Canceled' END",
            "incident_state": "CASE WHEN k % 8 = 0 THEN 'resolved' WHEN k % 4 = 0 THEN 'strange' ELSE '' END",
            "business_service": "CASE WHEN k % 3 = 0 THEN 'svc' || nk WHEN k % 3 = 1 THEN '  ' ELSE '' END",
            "cmdb_ci": "'host' || (ck % 60)",
            "assignment_group": "CASE WHEN k % 7 = 0 THEN NULL ELSE 'g' || (ck % 44) END",
            "problem_id": "CASE WHEN k % 11 = 0 THEN 'prb' || (k % 100) ELSE '' END",
            "caused_by": "CASE WHEN k % 13 = 0 THEN 'chg' || (k * 100 + 1) ELSE '' END",
            "reassignment_count": "CASE WHEN k % 17 = 0 THEN 'x' ELSE CAST(k % 4 AS STRING) END",
            "reopen_count": "CAST(k % 2 AS STRING)",
            "short_description": "'Order ' || k",
            "close_code": "CASE WHEN k % 19 = 0 THEN 'Duplicate' ELSE 'Solved' END",
            "made_sla": "CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'NO' ELSE 'maybe' END",
            "business_duration": "CASE k % 3 WHEN 0 THEN CAST(k % 9000 AS STRING) WHEN 1 THEN '1970-01-01 02:00:00' ELSE '' END",
            "u_acknowledged": f"CASE WHEN k % 2 = 0 THEN {_iso('od')} ELSE '' END",
            "u_impact": "CASE k % 6 WHEN 0 THEN CAST(k % 500 AS STRING) WHEN 1 THEN 'NaN' WHEN 2 THEN 'many' ELSE '' END",
        },
        _ORDERS, "k % 4 = 1", {"state": "'Closed'"}, "k % 50 = 3",
    ),
    "change_request": _versions(
        "servicenow:change_request", "'chg' || id", "sd",
        {
            "number": "'CHG' || (1000000 + id)",
            "business_service": "CASE WHEN id % 4 = 0 THEN 'svc' || (sk % 25) ELSE '' END",
            "cmdb_ci": "'host' || (id % 70)",
            "assignment_group": "'g' || (sk % 44)",
            "short_description": "'Return ' || id",
            "type": "CASE id % 4 WHEN 0 THEN 'Emergency' WHEN 1 THEN 'normal' WHEN 2 THEN 'STANDARD' ELSE 'odd' END",
            "state": "CAST(ln AS STRING)",
            "state_display": "CASE id % 5 WHEN 0 THEN 'Cancelled' WHEN 1 THEN '' ELSE 'Closed' END",
            "risk": "CAST(id % 3 AS STRING)",
            "risk_display": "CASE WHEN id % 3 = 0 THEN 'High' ELSE '' END",
            "opened_at": _iso(_days("sd", "0 - ln")),
            "start_date": _iso("sd"),
            "end_date": _iso(_days("sd", "1")),
            "work_start": f"CASE WHEN id % 6 = 0 THEN '' ELSE {_iso('sd')} END",
            "work_end": f"CASE WHEN id % 6 = 0 THEN 'open' ELSE {_iso(_days('sd', 'ln - 3'))} END",
            "close_code": "CASE WHEN tax > 0.06 THEN 'Unsuccessful' WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN 'mystery' ELSE 'Successful' END",
        },
        _LINES, "id % 6 = 1", {"state_display": "'Review'"}, "id % 60 = 7",
    ),
    "problem": _versions(
        "servicenow:problem", "'prb' || k", "TIMESTAMP '2001-01-01 00:00:00'",
        {
            "number": "'PRB' || (10000 + k)",
            "business_service": "CASE WHEN k % 2 = 0 THEN 'svc' || (k % 25) ELSE ' ' END",
            "assignment_group": "'g' || (k % 44)",
            "opened_at": _iso(_days("TIMESTAMP '2001-01-01 10:00:00'", "k % 100")),
            "resolved_at": f"CASE WHEN k % 3 = 0 THEN {_iso(_days(chr(39).join(('TIMESTAMP ', '2001-06-01 10:00:00', '')), 'k % 30'))} ELSE '' END",
            "problem_state_display": "CASE WHEN k % 4 = 0 THEN 'Fix in progress' ELSE '' END",
            "state_display": "CASE WHEN k % 4 = 1 THEN 'Open' ELSE '' END",
            "problem_state": "CASE WHEN k % 4 = 2 THEN '104' ELSE '' END",
            "state": "'1'",
            "known_error": "CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'f' ELSE 'unsure' END",
            "cause_notes": "'cause of ' || k",
        },
        "SELECT p_partkey k FROM @part", "k % 5 = 0", {"known_error": "'1'"}, "k % 41 = 0",
    ),
    "cmdb_ci": _versions(
        "servicenow:cmdb_ci", "sid", "TIMESTAMP '2000-01-01 00:00:00'",
        {
            "name": "CASE WHEN n % 9 = 4 AND sid LIKE 'svc%' THEN 'Shared name' ELSE 'Name of ' || sid END",
            "owned_by": "CASE WHEN n % 3 = 0 THEN 'nobody' ELSE 'g' || n END",
            "support_group": "CASE WHEN n % 5 = 4 THEN '' ELSE ' g' || (n + 3) || ' ' END",
            "cost_center": "'cc' || (n % 6)",
            "company": "'Acme'",
            "sys_class_name": "CASE WHEN sid LIKE 'svc%' THEN CASE WHEN n % 4 = 0 THEN '' ELSE 'cmdb_ci_service' END ELSE 'cmdb_ci_server' END",
        },
        "SELECT n_nationkey n, 'svc' || n_nationkey sid FROM @nation UNION ALL SELECT n, 'host' || n FROM (SELECT DISTINCT c_custkey % 70 n FROM @customer) h", "n % 2 = 0", {"company": "'Acme 2'"}, "n = 66",
    ),
    "cmdb_ci_service": _versions(
        "servicenow:cmdb_ci_service", "'svc' || n_nationkey", "TIMESTAMP '2000-01-02 00:00:00'",
        {
            "name": "CASE WHEN n_nationkey % 9 = 4 THEN 'shared NAME' WHEN n_nationkey % 2 = 0 THEN 'Service ' || n_nationkey ELSE '' END",
            "owned_by": "'g' || n_nationkey",
            "support_group": "'g' || (n_nationkey + 1)",
            "cost_center": "'cc1'",
            "company": "''",
            "sys_class_name": "''",
            "busines_criticality": "CASE n_nationkey % 5 WHEN 0 THEN '1 - most critical' WHEN 1 THEN '4' WHEN 2 THEN '9 - odd' WHEN 3 THEN 'none' ELSE '' END",
        },
        "SELECT n_nationkey FROM @nation WHERE n_nationkey % 3 <> 1", "n_nationkey % 4 = 0", {}, "n_nationkey = 23",
    ),
    "cmdb_rel_ci": _versions(
        "servicenow:cmdb_rel_ci", "'rel' || n || '-' || p", "TIMESTAMP '2000-01-01 00:00:00'",
        {"parent": "'svc' || p", "child": "'host' || n", "type": "'depends'", "type_display": "CASE WHEN n % 2 = 0 THEN 'Depends on::Used by' ELSE '' END"},
        "SELECT n, n % 25 p FROM (SELECT DISTINCT c_custkey % 70 n FROM @customer) h UNION ALL SELECT n, (n + 7) % 25 FROM (SELECT DISTINCT c_custkey % 70 n FROM @customer) h WHERE n % 5 = 0", "false", {}, "n = 12",
    ),
    "sys_user_group": _versions(
        "servicenow:sys_user_group", "'g' || n", "TIMESTAMP '2000-01-01 00:00:00'",
        {"sys_id": "'g' || n", "name": "CASE WHEN n > 41 THEN 'Twins' ELSE 'Group ' || n END", "parent": "CASE WHEN n >= 8 THEN 'g' || (n % 8) ELSE '' END", "manager": "'m' || n", "cost_center": "CASE WHEN n % 7 = 6 THEN ' ' ELSE 'cc' || (n % 7) END", "type": "'it'", "active": "CASE n % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'no' WHEN 2 THEN 'perhaps' ELSE '' END"},
        "SELECT DISTINCT c_custkey % 44 n FROM @customer", "n % 3 = 0", {"manager": "'m0'"}, "n = 40",
    ),
    "cmn_department": _versions(
        "servicenow:cmn_department", "'d' || r_regionkey", "TIMESTAMP '2000-01-01 00:00:00'",
        {"sys_id": "'d' || r_regionkey", "name": "r_name", "parent": "CASE WHEN r_regionkey = 0 THEN '' WHEN r_regionkey = 4 THEN 'gone' ELSE 'd0' END", "cost_center": "'cc' || (r_regionkey % 4)"},
        "SELECT r_regionkey, r_name FROM @region", "false", {}, "false",
    ),
    "task_sla": _versions(
        "servicenow:task_sla", "'sla' || k || '-' || j", "od",
        {"task": "CASE WHEN k % 31 = 0 THEN ' ' ELSE ' inc' || k END", "has_breached": "CASE WHEN k % 10 = 2 * j THEN 'true' WHEN k % 26 = 0 THEN 'unknown' ELSE 'false' END"},
        "SELECT k, od, j FROM (SELECT o_orderkey k, o_orderdate od, 1 j FROM @orders UNION ALL SELECT o_orderkey, o_orderdate, 2 FROM @orders) s WHERE k % 2 = 0", "false", {}, "k % 70 = 0",
    ),
    "issue": _versions(
        "jira:issue", "'iss' || k", "od",
        {
            "key": "'P' || (k % 6) || '-' || k",
            "issuetype": """CASE WHEN k % 43 = 0 THEN 'no json' ELSE '{"name": "' || CASE WHEN k % 90 = 1 THEN 'Initiative' WHEN k % 18 = 1 THEN 'Epic' WHEN k % 6 = 1 THEN 'Feature' WHEN k % 6 = 2 THEN 'Bug' WHEN k % 6 = 3 THEN 'Spike' ELSE 'Story' END || '"}' END""",
            "parent": """CASE WHEN k % 90 = 1 THEN '' WHEN k % 18 = 1 THEN '{"key": "P' || ((k - k % 90 + 1) % 6) || '-' || (k - k % 90 + 1) || '"}' WHEN k % 6 = 1 THEN '{"key": "P' || ((k - k % 18 + 1) % 6) || '-' || (k - k % 18 + 1) || '"}' ELSE '{"key": "P' || ((k - k % 6 + 1) % 6) || '-' || (k - k % 6 + 1) || '"}' END""",
            "project": """'{"key": "P' || (k % 6) || '"}'""",
            "components": """CASE k % 3 WHEN 0 THEN '[{"name": "c' || (ck % 5) || '"}, {"name": "z"}]' WHEN 1 THEN CASE WHEN k % 900 IN (13, 91, 109) THEN '[{"name": "c1"}]' ELSE '[]' END ELSE '' END""",
            "labels": """CASE k % 4 WHEN 0 THEN '["a", "b c"]' WHEN 1 THEN '[' ELSE '' END""",
            "status": """'{"name": "' || CASE st WHEN 'F' THEN 'Done' WHEN 'O' THEN 'In Progress' ELSE 'Backlog' END || '"' || CASE k % 3 WHEN 0 THEN ', "statusCategory": {"key": "' || CASE st WHEN 'F' THEN 'done' WHEN 'O' THEN 'indeterminate' ELSE 'unknown' END || '"}' ELSE '' END || '}'""",
            "created": _iso("od"),
            "resolutiondate": f"CASE WHEN st = 'F' THEN {_iso(_days('od', 'k % 25'))} ELSE '' END",
            "summary": "'Item ' || k",
            "description": """CASE WHEN k % 2 = 0 THEN '{"type": "doc", "content": [{"text": "first part"}, {"content": [{"text" : "of ' || chr(92) || '"' || k || chr(92) || '""}]}]}' ELSE 'plain ' || k END""",
            "changelog": f"""CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'bad' WHEN 2 THEN '[{{"created": "' || {_iso('od')} || '", "items": [{{"field": "status", "fromString": "Backlog", "toString": "In Progress"}}, {{"field": "rank", "toString": "1"}}]}}]'
              ELSE '{{"histories": [{{"created": "' || {_iso('od')} || '", "items": [{{"field": "status", "fromString": "Backlog", "toString": "In Progress"}}]}}, {{"created": "' || {_iso(_days('od', '1 + k % 9'))} || '", "items": [{{"field": "status", "fromString": "In Progress", "toString": "' || CASE st WHEN 'F' THEN 'Done' ELSE 'Limbo' END || '"}}]}}]}}' END""",
            "issuelinks": """CASE k % 5 WHEN 2 THEN CASE k % 6 WHEN 1 THEN '[{"type": {"name": "Blocks"}, "outwardIssue": {"key": "P1-' || (k + 6) || '"}}]' ELSE '' END WHEN 0 THEN '[{"type": {"name": "Blocks"}, "outwardIssue": {"key": "P' || ((k + 1) % 6) || '-' || (k + 1) || '"}}, {"type": {"name": "Blocks"}, "inwardIssue": {"key": "P' || ((k + 2) % 6) || '-' || (k + 2) || '"}}, {"type": {"name": "Empty"}}]' WHEN 1 THEN 'x' ELSE '' END""",
            "remotelinks": """CASE k % 7 WHEN 0 THEN '[{"object": {"url": "https://t.example/INC' || (1000000 + k) || '?x=CHG12345", "title": "see PRB10' || (k % 10) || '0 or INC12"}}]' ELSE '' END""",
            "cf_points": "CASE k % 6 WHEN 5 THEN 'inf' WHEN 4 THEN '' ELSE CAST(k % 6 + 1 AS STRING) END",
            "cf_cost": "CASE k % 5 WHEN 0 THEN '1234.50' WHEN 1 THEN 'dear' ELSE '' END",
            "cf_team": """CASE k % 5 WHEN 0 THEN '{"title": "Group ' || (ck % 44) || '"}' WHEN 1 THEN '"group ' || (ck % 44) || '"' WHEN 2 THEN 'Twins' WHEN 3 THEN '{"name": "GROUP ' || (ck % 44) || '", "title": "x"}' ELSE '' END""",
            "cf_epic": "CASE WHEN k % 90 = 1 THEN '' ELSE 'P1-1' END",
        },
        f"{_ORDERS} WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0", "k % 9 = 2", {"summary": "'Item ' || k || ' again'"}, "k % 55 = 5",
    ),
    "event": _versions(
        "monitoring:event", "'t' || (event_id % 2) || ':' || event_id", "ts",
        {
            "source_tool": "'tool' || (event_id % 2)",
            "event_key": "event_id",
            "ts": f"CASE WHEN event_id % 53 = 0 THEN '' ELSE {_iso('ts')} END",
            "service": "CASE event_id % 4 WHEN 0 THEN 'SERVICE ' || (user_id % 25) WHEN 1 THEN 'Alias ' || (user_id % 5) WHEN 2 THEN 'shared name' ELSE 'Name of svc' || (user_id % 30) END",
            "host": "'host' || (user_id % 70)",
            "severity_raw": "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'Info' ELSE 'weird' END",
            "title": "event_type || ' of ' || user_id",
            "status": "'open'",
            "dedup_key": "CASE WHEN event_id % 2 = 0 THEN 'd' || user_id ELSE '' END",
            "end_ts": f"CASE event_id % 3 WHEN 0 THEN '' ELSE {_iso('(ts + (INTERVAL 1 MINUTE) * (event_id % 90 - 10))')} END",
            "incident_ref": "CASE event_id % 6 WHEN 0 THEN 'INC' || (1000000 + event_id) WHEN 1 THEN 'INC7' ELSE '' END",
        },
        "SELECT event_id, ts, user_id, event_type FROM @events", "event_id % 12 = 0", {"status": "'closed'"}, "event_id % 80 = 9",
    ),
    "metric_daily": _versions(
        "monitoring:metric_daily", "'m' || event_id", "ts",
        {
            "source_tool": "'tool' || (event_id % 2)",
            "metric_name": "CASE event_id % 5 WHEN 0 THEN 'availability' WHEN 1 THEN 'request_count' WHEN 2 THEN 'error_rate' WHEN 3 THEN 'latency' ELSE '' END",
            "unit": "'u'",
            "service": "CASE event_id % 3 WHEN 0 THEN 'SERVICE ' || (user_id % 25) WHEN 1 THEN 'alias ' || (user_id % 5) ELSE 'unknown ' || user_id END",
            "date": "CASE WHEN event_id % 29 = 0 THEN 'today' ELSE substr(CAST(ts AS STRING), 1, 10) END",
            "value": "CASE WHEN event_id % 31 = 0 THEN 'n/a' ELSE CAST(event_id % 1000 AS STRING) || '.5' END",
        },
        "SELECT event_id, ts, user_id FROM @events", "event_id % 10 = 0", {"unit": "'v'"}, "event_id % 90 = 9",
    ),
    # tables of the configuration
    "service_override": "SELECT 'servicenow:cmdb_ci:svc1' AS service_id, 'servicenow:sys_user_group:g2' AS team_id, 'P1' AS jira_project, 'c1' AS jira_component, CAST(NULL AS STRING) AS org_id, 'delivery' AS role UNION ALL SELECT 'servicenow:cmdb_ci:svc2', CAST(NULL AS STRING), 'P2', CAST(NULL AS STRING), CAST(NULL AS STRING), 'delivery' UNION ALL SELECT 'servicenow:cmdb_ci:svc3', 'servicenow:sys_user_group:g3', CAST(NULL AS STRING), CAST(NULL AS STRING), 'servicenow:cmn_department:d2', 'owner' UNION ALL SELECT 'servicenow:cmdb_ci:svc9', 'servicenow:sys_user_group:g9', 'P2', CAST(NULL AS STRING), CAST(NULL AS STRING), 'delivery'",
    "service_alias": "SELECT 'alias ' || n_nationkey AS alias_lc, 'servicenow:cmdb_ci:svc' || (n_nationkey + 10) AS service_id FROM @nation WHERE n_nationkey < 4 UNION ALL SELECT 'name of svc7', 'servicenow:cmdb_ci:svc8'",
    "service_ci_class": "SELECT 'cmdb_ci_service' AS ci_class",
    "approved_mapping": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'jira_component' WHEN n_nationkey = 5 THEN 'host' ELSE 'team' END AS subject_type, 'servicenow:cmdb_ci:svc' || n_nationkey AS service_id, CASE WHEN n_nationkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE 'servicenow:sys_user_group:g' || n_nationkey END AS team_id, 'P' || (n_nationkey % 6) AS jira_project, CASE WHEN n_nationkey % 4 = 0 THEN 'c' || (n_nationkey % 5) END AS jira_component, 0.5 + n_nationkey * 0.01 AS score FROM @nation",
    "deleted_record": "SELECT 'servicenow:incident:inc' || o_orderkey AS record_id FROM @orders WHERE o_orderkey % 500 = 77",
    # results of enrichment
    "cluster_member": "SELECT 'servicenow:incident:inc' || o_orderkey AS record_id, 'c' || (o_custkey % 12) AS cluster_id, CAST(0.25 + (o_orderkey % 8) * 0.1 AS DOUBLE) AS membership_prob FROM @orders WHERE o_orderkey % 5 <> 2 UNION ALL SELECT 'servicenow:incident:inc' || o_orderkey, 'c' || ((o_custkey + 1) % 12), CAST(0.55 AS DOUBLE) FROM @orders WHERE o_orderkey % 5 = 0",
    "change_link": "SELECT DISTINCT 'servicenow:incident:inc' || l_orderkey AS incident_id, 'servicenow:change_request:chg' || (l_orderkey * 100 + l_linenumber) AS change_id, CAST(0.35 + (l_linenumber % 6) * 0.1 AS DOUBLE) AS score FROM @lineitem WHERE l_returnflag = 'R' AND l_orderkey % 3 = 0",
    "cluster": "SELECT DISTINCT 'c' || (o_custkey % 12) AS cluster_id, CASE (o_custkey % 12) % 3 WHEN 0 THEN 'disk' WHEN 1 THEN 'network' ELSE 'code' END AS root_cause_category FROM @orders",
    "cluster_service": "SELECT 'c' || (n_nationkey % 12) AS cluster_id, 'servicenow:cmdb_ci:svc' || n_nationkey AS service_id FROM @nation",
    "decision": "SELECT 'jira:issue:iss' || o_orderkey AS record_id, 'root_cause' AS question, CASE o_orderkey % 3 WHEN 0 THEN 'disk' WHEN 1 THEN 'network' ELSE 'code' END AS answer, CAST(0.5 + (o_orderkey % 5) * 0.1 AS DOUBLE) AS probability, o_orderdate AS decided_at, 'd0' AS decider FROM @orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT 'jira:issue:iss' || o_orderkey, 'root_cause', 'code', CAST(0.8 AS DOUBLE), o_orderdate + INTERVAL 1 DAY, 'd1' FROM @orders WHERE o_orderkey % 6 = 1",
    "cases": "SELECT o_orderkey AS record_id, CASE o_orderkey % 3 WHEN 0 THEN 'incident' WHEN 1 THEN 'change' ELSE 'problem' END AS entity, 'h' || (o_custkey % 500) || '-' || (o_orderkey % 3) AS content_hash, o_orderdate AS opened_at, o_orderdate + (INTERVAL 1 DAY) * (o_orderkey % 30) AS updated_at, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 4 END AS priority, o_custkey % 25 AS service_id FROM @orders",
    "cases_before": "SELECT o_orderkey AS record_id, 'h' || (o_custkey % 500) || '-' || (CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE o_orderkey % 3 END) AS content_hash, o_orderdate + (INTERVAL 1 DAY) * (CASE WHEN o_orderkey % 5 = 0 THEN 99 ELSE o_orderkey % 30 END) AS updated_at, 'redacted ' || o_orderkey AS text_redacted FROM @orders WHERE o_orderkey % 4 <> 2",
    "answers": "SELECT l_orderkey * 100 + l_linenumber AS answer_id, 'h' || (l_partkey % 500) || '-' || (l_linenumber % 3) AS content_hash, 'q' || (l_linenumber % 4) AS question, 'f' || (l_linenumber % 4) || CASE WHEN l_quantity > 45 THEN 'x' ELSE '' END AS fingerprint, CASE l_suppkey % 4 WHEN 0 THEN 'ensemble' WHEN 1 THEN 'small' WHEN 2 THEN 'large' ELSE 'other' END AS decider, CASE WHEN l_tax > 0.04 THEN 'true' ELSE 'false' END AS answer, l_discount * 8 + 0.1 AS p_true, l_shipdate AS decided_at FROM @lineitem",
    "questions": "SELECT 'q0' AS question, 'f0' AS fingerprint, 'bool' AS qtype, CAST(0.7 AS DOUBLE) AS threshold, 'small' AS first_decider, 'large,other' AS chain, 'incident,change' AS applies_to, CAST(1.5 AS DOUBLE) AS t UNION ALL SELECT 'q1', 'f1', 'choice', CAST(0.6 AS DOUBLE), 'large', 'other', 'incident', CAST(0.8 AS DOUBLE) UNION ALL SELECT 'q2', 'f2', 'bool', CAST(0.5 AS DOUBLE), 'small', 'other,large', 'problem,incident', CAST(1.0 AS DOUBLE) UNION ALL SELECT 'q3', 'f3', 'choice', CAST(0.9 AS DOUBLE), 'other', '', 'change', CAST(2.0 AS DOUBLE)",
    "human_answers": "SELECT 'h' || (c_custkey % 500) || '-' || (c_custkey % 3) AS content_hash, 'q' || (c_custkey % 4) AS question, CASE WHEN c_acctbal > 4000 THEN 'true' ELSE 'false' END AS answer, TIMESTAMP '2001-05-01 00:00:00' + (INTERVAL 1 SECOND) * c_custkey AS labeled_at FROM @customer WHERE c_custkey % 6 = 0",
    "embedded": "SELECT DISTINCT 'h' || (o_custkey % 500) || '-' || (o_orderkey % 3) AS content_hash, 'm1' AS model FROM @orders WHERE o_custkey % 3 <> 0",
}

#: Enum tables: domain, raw word (lower case), canonical value.
ENUMS: dict[str, dict[str, str]] = {
    "incident_state": {"resolved": "resolved", "in progress": "in_progress", "canceled": "canceled", "closed": "closed"},
    "change_type": {"normal": "normal", "standard": "standard", "emergency": "emergency"},
    "change_close_code": {"successful": "success", "unsuccessful": "failed"},
    "issue_type": {"initiative": "initiative", "epic": "epic", "feature": "feature", "story": "story", "bug": "bug"},
    "status_category_key": {"new": "todo", "indeterminate": "in_progress", "done": "done"},
    "status_category": {"backlog": "todo", "in progress": "in_progress", "done": "done"},
    "severity": {"critical": "critical", "warn": "warning", "info": "info"},
}


def raw_sql(name: str) -> str:
    """The definition as DuckDB reads it."""
    return RAW[name].replace("@", "")


def raw(t: Tables, name: str) -> DataFrame:
    """The table as a DataFrame."""
    sql = RAW[name]
    for s in SOURCES:
        if f"@{s}" in sql:
            t.raw(s).createOrReplaceTempView(f"tarnlake_raw_{s}")
            sql = sql.replace(f"@{s}", f"tarnlake_raw_{s}")
    return t.spark.sql(sql)


def enum_sql(domain: str) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ENUMS[domain].items()) + f") {domain}(word, canonical)"


def enum_table(t: Tables, domain: str) -> DataFrame:
    """word, canonical: a few rows from the configuration."""
    return t.spark.createDataFrame(list(ENUMS[domain].items()), "word string, canonical string")
