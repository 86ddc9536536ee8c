"""Typed staging tables: the live rows of each raw entity, with a flag for each cast that failed.

Each builder takes a ``Raw`` (the lake's tables by name) and returns a DataFrame.  An empty
text counts as missing.  ``typed`` gives a column, whether its raw value is there
(``_nn_``) and whether it could not be read (``_cf_``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import columns as X
from tarnlake.operators import joins as J
from tarnlake.sources import lake

Raw = Callable[[str], DataFrame]
TICKETS = r"(INC|CHG|PRB)[0-9]{4,}"


def text(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def typed(raw: Column, value: Column, name: str) -> list[Column]:
    return [value.alias(name), raw.isNotNull().alias(f"_nn_{name}"), (raw.isNotNull() & value.isNull()).alias(f"_cf_{name}")]


def instant(column: str, name: str | None = None) -> list[Column]:
    return typed(text(column), X.to_utc(text(column)), name or column)


def meta() -> list[Column]:
    return [F.col("_record_id").alias("record_id"), F.col("_source_key").alias("source_key"), F.col("_source_updated_at").alias("source_updated_at")]


def live(raw: Raw, entity: str, deleted: DataFrame | None = None) -> DataFrame:
    gone = None if deleted is None else deleted.select(F.col("record_id").alias("_record_id"))
    return lake.latest(raw(entity), gone, order=("_source_updated_at",))


def mapped(df: DataFrame, enums: Callable[[str], DataFrame], domain: str, word: Column, name: str) -> DataFrame:
    """``df`` with the canonical value of a word: exact once in lower case; the table is a few rows of configuration."""
    e = F.broadcast(enums(domain).select(F.col("word").alias(f"__{name}"), F.col("canonical").alias(name)))
    return df.join(e, F.lower(word) == F.col(f"__{name}"), "left").drop(f"__{name}")


# -- service desk ---------------------------------------------------------------
def incident(raw: Raw, enums, acknowledged: str | None = "u_acknowledged", impact: str | None = "u_impact") -> DataFrame:
    state = F.coalesce(text("state"), text("incident_state"))
    x = mapped(live(raw, "incident", raw("deleted_record")), enums, "incident_state", state, "e_state")
    return x.select(
        *meta(),
        text("number").alias("number"),
        *instant("opened_at"),
        *instant("resolved_at"),
        *instant("closed_at"),
        *(instant(acknowledged, "acknowledged_at") if acknowledged else [F.lit(None).cast("timestamp").alias("acknowledged_at")]),
        *typed(text("priority"), X.lead_int(text("priority"), 1, 5), "priority"),
        *typed(state, F.col("e_state"), "state"),
        *[text(c).alias(c) for c in ("business_service", "cmdb_ci", "assignment_group", "problem_id", "caused_by")],
        *typed(text("reassignment_count"), text("reassignment_count").try_cast("int"), "reassignment_count"),
        *typed(text("reopen_count"), text("reopen_count").try_cast("int"), "reopen_count"),
        "short_description",
        text("close_code").alias("close_code"),
        *typed(text("made_sla"), X.to_flag(text("made_sla")), "made_sla"),
        *typed(text("business_duration"), X.duration_seconds(text("business_duration")), "business_duration_s"),
        *(typed(text(impact), X.to_finite(text(impact)), "customer_impact_minutes") if impact else [F.lit(None).cast("double").alias("customer_impact_minutes")]),
    )


def change_request(raw: Raw, enums) -> DataFrame:
    x = mapped(live(raw, "change_request"), enums, "change_type", text("type"), "e_type")
    x = mapped(x, enums, "change_close_code", text("close_code"), "e_outcome")
    return x.select(
        *meta(),
        *[text(c).alias(c) for c in ("number", "business_service", "cmdb_ci", "assignment_group")],
        "short_description",
        *typed(text("type"), F.col("e_type"), "type"),
        F.coalesce(text("state_display"), text("state")).alias("state"),
        F.coalesce(text("risk_display"), text("risk")).alias("risk"),
        *instant("opened_at"),
        *instant("start_date", "planned_start"),
        *instant("end_date", "planned_end"),
        *instant("work_start", "actual_start"),
        *instant("work_end", "actual_end"),
        *typed(text("close_code"), F.col("e_outcome"), "outcome"),
    )


def problem(raw: Raw, enums) -> DataFrame:
    state = F.coalesce(*[text(c) for c in ("problem_state_display", "state_display", "problem_state", "state")])
    known = typed(text("known_error"), X.to_flag(text("known_error")), "known_error")
    return live(raw, "problem").select(*meta(), *[text(c).alias(c) for c in ("number", "business_service", "assignment_group")], *instant("opened_at"), *instant("resolved_at"), state.alias("state"), *known, F.col("cause_notes").alias("root_cause_text"))


def ci(raw: Raw, enums) -> DataFrame:
    """Configuration items of both entities: the newest row of a key, a service row's name and criticality before it."""
    columns = ["_record_id", "_source_key", "_source_updated_at"]
    own = [text(c).alias(c) for c in ("name", "owned_by", "support_group", "cost_center", "company")]
    plain = live(raw, "cmdb_ci").select(*columns, F.lit(False).alias("is_service"), *own, text("sys_class_name").alias("ci_class"), F.lit(None).cast("string").alias("level"))
    service = live(raw, "cmdb_ci_service").select(*columns, F.lit(True).alias("is_service"), *own, F.coalesce(text("sys_class_name"), F.lit("cmdb_ci_service")).alias("ci_class"), text("busines_criticality").alias("level"))
    newest = J.best_by(plain.unionByName(service), ["_source_key"], F.desc("_source_updated_at"), F.desc("is_service"), F.desc("_record_id")).drop("level")
    s = service.select("_source_key", F.col("name").alias("s_name"), F.col("ci_class").alias("s_class"), "level")
    criticality = typed(F.col("level"), X.lead_int(F.col("level"), 1, 4), "criticality")
    x = newest.join(s, "_source_key", "left")
    return x.select(*meta(), F.col("_source_key").alias("sys_id"), F.coalesce("s_name", "name").alias("name"), "owned_by", "support_group", "cost_center", "company", F.coalesce("ci_class", "s_class").alias("ci_class"), *criticality)


def rel_ci(raw: Raw, enums) -> DataFrame:
    return live(raw, "cmdb_rel_ci").select(*meta(), text("parent").alias("parent"), text("child").alias("child"), F.coalesce(text("type_display"), text("type")).alias("type"))


def group(raw: Raw, enums) -> DataFrame:
    own = [text(c).alias(c) for c in ("sys_id", "name", "parent", "manager", "cost_center", "type")]
    return live(raw, "sys_user_group").select(*meta(), *own, *typed(text("active"), X.to_flag(text("active")), "active"))


def department(raw: Raw, enums) -> DataFrame:
    return live(raw, "cmn_department").select(*meta(), *[text(c).alias(c) for c in ("sys_id", "name", "parent", "cost_center")])


def task_sla(raw: Raw, enums) -> DataFrame:
    return live(raw, "task_sla").select(*meta(), text("task").alias("task"), *typed(text("has_breached"), X.to_flag(text("has_breached")), "has_breached"))


# -- work items -------------------------------------------------------------------
def issue(raw: Raw, enums) -> DataFrame:
    kind, status, key = (X.json_member(text(c), p) for c, p in (("issuetype", "$.name"), ("status", "$.name"), ("status", "$.statusCategory.key")))
    x = mapped(live(raw, "issue"), enums, "issue_type", kind, "e_type")
    x = mapped(x, enums, "status_category_key", key, "e_key")
    x = mapped(x, enums, "status_category", status, "e_name")
    return x.select(
        *meta(),
        text("key").alias("key"),
        *typed(kind, F.col("e_type"), "type"),
        F.coalesce(X.json_member(text("parent"), "$.key"), text("cf_epic")).alias("parent_key"),
        X.json_member(text("project"), "$.key").alias("project"),
        F.transform(F.from_json(text("components"), "array<struct<name:string>>"), lambda c: c["name"]).alias("components"),
        F.from_json(text("labels"), "array<string>").alias("labels"),
        status.alias("status"),
        *typed(F.coalesce(key, status), F.coalesce("e_key", "e_name"), "status_category"),
        *instant("created", "created_at"),
        *instant("resolutiondate", "resolved_at"),
        *typed(text("cf_points"), X.to_finite(text("cf_points")), "story_points"),
        *typed(text("cf_cost"), text("cf_cost").try_cast("decimal(18,2)"), "estimate_cost_usd"),
        X.named_value(text("cf_team")).alias("team_value"),
        "summary",
        X.document_text(F.col("description")).alias("description"),
        "changelog",
        "issuelinks",
        "remotelinks",
    )


def transition(issues: DataFrame, enums) -> DataFrame:
    """One row for each status change in the histories, which are an array or a member of an object."""
    histories = F.when(F.trim("changelog").startswith("{"), F.get_json_object("changelog", "$.histories")).otherwise(F.col("changelog"))
    kind = "array<struct<created:string,items:array<struct<field:string,fromString:string,toString:string>>>>"
    h = issues.select("record_id", F.explode(F.from_json(histories, kind)).alias("h")).select("record_id", "h.created", F.explode("h.items").alias("i")).filter("i.field = 'status'")
    x = h.select("record_id", "created", F.col("i.fromString").alias("from_status"), F.col("i.toString").alias("to_status"))
    x = mapped(x, enums, "status_category", F.col("from_status"), "from_category")
    x = mapped(x, enums, "status_category", F.col("to_status"), "to_category")
    return x.select("record_id", X.to_utc(F.col("created")).alias("at"), "from_status", "to_status", "from_category", "to_category")


def link(issues: DataFrame) -> DataFrame:
    """Distinct links between issues, in their direction, and ticket numbers that remote links mention."""
    kind = "array<struct<type:struct<name:string>,outwardIssue:struct<key:string>,inwardIssue:struct<key:string>>>"
    own = issues.select("key", F.explode(F.from_json(text("issuelinks"), kind)).alias("l"))
    out = own.select(F.col("key").alias("from_key"), F.col("l.outwardIssue.key").alias("to_key"), F.col("l.type.name").alias("link_type"))
    into = own.select(F.col("l.inwardIssue.key").alias("from_key"), F.col("key").alias("to_key"), F.col("l.type.name").alias("link_type"))
    remote = issues.select("key", F.explode(F.from_json(text("remotelinks"), "array<struct<object:struct<url:string,title:string>>>")).alias("r"))
    said = remote.select("key", F.explode(F.array("r.object.url", "r.object.title")).alias("t")).select(F.col("key").alias("from_key"), F.explode(F.regexp_extract_all("t", F.lit(TICKETS), 0)).alias("to_key"), F.lit("mentions_incident").alias("link_type"))
    return out.unionByName(into).unionByName(said).filter("from_key is not null and to_key is not null").distinct()


# -- monitoring ---------------------------------------------------------------------
def event(raw: Raw, enums) -> DataFrame:
    x = mapped(live(raw, "event"), enums, "severity", text("severity_raw"), "e_severity")
    own = [text(c).alias(c) for c in ("source_tool", "event_key", "host", "status", "dedup_key", "incident_ref")]
    return x.select(*meta(), *own, text("service").alias("service_name"), *instant("ts"), *instant("end_ts"), *typed(text("severity_raw"), F.col("e_severity"), "severity"), text("title").alias("alert_name"))


def metric_daily(raw: Raw, enums) -> DataFrame:
    day = F.try_to_date(text("date"), "yyyy-MM-dd")
    own = [text(c).alias(c) for c in ("source_tool", "metric_name", "unit")]
    return live(raw, "metric_daily").select(*meta(), *own, text("service").alias("service_name"), *typed(text("date"), day, "date"), *typed(text("value"), X.to_finite(text("value")), "value"))


def generic(raw: Raw, entity: str, columns: list[str]) -> DataFrame:
    """Any other entity: its live rows with its own columns as text."""
    return live(raw, entity).select(*meta(), *columns)


BUILDERS = {"incident": incident, "change_request": change_request, "problem": problem, "ci": ci, "rel_ci": rel_ci, "group": group, "department": department, "task_sla": task_sla, "issue": issue, "event": event, "metric_daily": metric_daily}


def cast_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, n_rows, n_present, n_failed of every typed column."""
    out = None
    for name, df in tables.items():
        typed_columns = [c.removeprefix("_nn_") for c in df.columns if c.startswith("_nn_")]
        if typed_columns:
            part = lake.cast_statistics(df, name, typed_columns)
            out = part if out is None else out.unionByName(part)
    return out
