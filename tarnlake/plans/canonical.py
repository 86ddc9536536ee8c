"""Canonical tables from the staged ones: organisation, services and their map, tickets, events, work items.

``Model`` builds each table when it is first asked for; what is used again it writes and
reads back, so that a build makes it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators import joins as J
from tarnlake.plans import rawlake, staging
from tarnlake.plans.adapter import Tables
from tarnlake.store import new_path

CI, GROUP, DEPARTMENT = "servicenow:cmdb_ci", "servicenow:sys_user_group", "servicenow:cmn_department"
OPEN_CANDIDATES = ("initiative", "epic", "feature")


def record_id(prefix: str, raw: Column) -> Column:
    """``prefix:key`` with the key trimmed; null for a blank one."""
    return F.when(F.trim(raw) != "", F.concat(F.lit(prefix + ":"), F.trim(raw)))


def filled(raw: Column) -> Column:
    return F.when(F.trim(raw) != "", F.trim(raw))


#: Tables that several others are made from: they are written once.
REUSED = {"stg_issue", "stg_ci", "stg_group", "core_team", "core_service", "core_service_map", "core_name_lookup", "core_incident", "core_work_item", "core_change", "core_work_item_closure", "core_event", "fact_incident", "fact_change", "fact_org_closure", "score_funding", "score_metrics", "score_org", "score_lever", "score_portfolio_input", "score_portfolio"}


class Model:
    """``folder``: where tables go that are used again; without one they go into the shared folder."""

    def __init__(self, t: Tables, folder: str | None = None):
        self.t, self.folder = t, folder or new_path(t.spark, "model")
        self.made: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return rawlake.raw(self.t, name)

    def enums(self, domain: str) -> DataFrame:
        return rawlake.enum_table(self.t, domain)

    def kept(self, name: str, build) -> DataFrame:
        if name not in self.made:
            df = build()
            if name in REUSED:
                df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
                df = self.t.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")
            self.made[name] = df
        return self.made[name]

    def stg(self, name: str) -> DataFrame:
        def build() -> DataFrame:
            if name == "transition":
                return staging.transition(self.stg("issue"), self.enums)
            if name == "link":
                return staging.link(self.stg("issue"))
            return staging.BUILDERS[name](self.raw, self.enums)

        return self.kept(f"stg_{name}", build)

    def core(self, name: str) -> DataFrame:
        return self.kept(f"core_{name}", lambda: CORE[name](self))

    def fact(self, name: str) -> DataFrame:
        from tarnlake.plans.facts import FACTS  # facts are built over this module

        return self.kept(f"fact_{name}", lambda: FACTS[name](self))

    @classmethod
    def of(cls, t: Tables) -> Model:
        """The session's model of a folder of tables as its files are now: what is written stays for later queries of the session."""
        return _MODELS.setdefault((t.spark.sparkContext.applicationId, t.dir, state_of(t)), cls(t))


_MODELS: dict[tuple[str, str, str], Model] = {}


def state_of(t: Tables) -> str:
    """Names, sizes and times of the tables' files: other files mean another model."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.dir}/*")
    found = path.getFileSystem(t.spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return " ".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


# -- organisation -------------------------------------------------------------------
def org(m: Model) -> DataFrame:
    """Departments, or without any the groups that have child groups; a parent only if it is one of them."""
    columns = lambda prefix: [record_id(prefix, F.col("sys_id")).alias("org_id"), "name", record_id(prefix, F.col("parent")).alias("parent_id"), filled(F.col("cost_center")).alias("cost_center"), "record_id"]
    departments = m.stg("department").select(*columns(DEPARTMENT))
    if departments.isEmpty():
        groups = m.stg("group").select(*columns(GROUP))
        parents = groups.filter("parent_id is not null").select(F.col("parent_id").alias("org_id")).distinct()
        orgs = groups.join(parents, "org_id", "left_semi")
    else:
        orgs = departments
    orgs = J.best_by(orgs.filter("org_id is not null"), ["org_id"], F.asc("record_id"))
    known = orgs.select(F.col("org_id").alias("parent_id"), F.col("org_id").alias("parent_org_id"))
    return orgs.join(known, "parent_id", "left").select("org_id", "name", "parent_org_id", "cost_center", F.lit("servicenow").alias("source"))


def team(m: Model) -> DataFrame:
    """Every group with the department of its cost centre; without departments the leaf groups, under their parent."""
    g = m.stg("group").select(record_id(GROUP, F.col("sys_id")).alias("team_id"), "name", record_id(GROUP, F.col("parent")).alias("parent_id"), filled(F.col("cost_center")).alias("cost_center"), "active", "record_id").filter("team_id is not null")
    departments = m.stg("department")
    if departments.isEmpty():
        orgs = m.core("org").select("org_id")
        g = g.join(orgs.withColumnRenamed("org_id", "team_id"), "team_id", "left_anti").join(orgs.withColumn("parent_id", F.col("org_id")), "parent_id", "left")
    else:
        d = departments.select(filled(F.col("cost_center")).alias("cost_center"), filled(F.col("sys_id")).alias("d"), "sys_id").filter("cost_center is not null and d is not null")
        d = d.groupBy("cost_center").agg(record_id(DEPARTMENT, F.min("sys_id")).alias("org_id"))
        g = g.join(d, "cost_center", "left")
    return J.best_by(g, ["team_id"], F.asc("record_id")).select("team_id", "name", "org_id", F.lit("servicenow").alias("source"), F.coalesce("active", F.lit(True)).alias("active"))


def service(m: Model) -> DataFrame:
    """Items of the configured classes; the owner is the first of owner and support group that is a team."""
    teams = m.core("team").select("team_id", "org_id")
    own, support = (teams.select(F.col("team_id").alias(f"{x}_id"), F.col("org_id").alias(f"{x}_org")) for x in ("own", "support"))
    c = m.stg("ci").join(m.raw("service_ci_class").select("ci_class").distinct(), "ci_class", "left_semi").withColumn("service_id", record_id(CI, F.col("sys_id"))).filter("service_id is not null")
    c = c.join(own, record_id(GROUP, F.col("owned_by")) == F.col("own_id"), "left").join(support, record_id(GROUP, F.col("support_group")) == F.col("support_id"), "left")
    org_id = F.when(F.col("own_id").isNotNull(), F.col("own_org")).otherwise(F.col("support_org"))
    return c.select("service_id", "name", "ci_class", "criticality", F.coalesce("own_id", "support_id").alias("business_owner_team_id"), org_id.alias("org_id"), F.lit("servicenow").alias("source"))


def service_map(m: Model) -> DataFrame:
    """Overrides, owners and support groups, approved suggestions; of rows for one thing the first in this order."""
    teams = m.core("team").select("team_id", F.col("org_id").alias("t_org"))
    services = m.core("service").select("service_id", F.col("org_id").alias("s_org"), "business_owner_team_id")
    none = F.lit(None).cast("string")
    columns = ["service_id", "team_id", "jira_project", "jira_component", "org_id", "role", "link_source", "confidence", "rank"]
    known = lambda df: df.join(teams, "team_id", "left").join(services, "service_id", "left")
    first = known(m.raw("service_override")).withColumn("org_id", F.coalesce("org_id", "t_org", "s_org")).withColumn("link_source", F.lit("override")).withColumn("confidence", F.lit(1.0)).withColumn("rank", F.lit(1))
    cmdb = lambda df, role: df.select("service_id", "team_id", none.alias("jira_project"), none.alias("jira_component"), F.col("t_org").alias("org_id"), F.lit(role).alias("role"), F.lit("cmdb").alias("link_source"), F.lit(1.0).alias("confidence"), F.lit(2).alias("rank"))
    owner = cmdb(services.join(teams, F.col("business_owner_team_id") == F.col("team_id")), "owner")
    c = m.stg("ci").select(record_id(CI, F.col("sys_id")).alias("service_id"), record_id(GROUP, F.col("support_group")).alias("team_id"))
    support = cmdb(services.join(c, "service_id").join(teams, "team_id").filter(~F.col("team_id").eqNullSafe(F.col("business_owner_team_id"))), "support")
    jira = F.col("subject_type") == "jira_component"
    a = known(m.raw("approved_mapping").filter(F.col("subject_type").isin("jira_component", "team")))
    approved = a.select("service_id", "team_id", F.when(jira, F.col("jira_project")).alias("jira_project"), F.when(jira, F.col("jira_component")).alias("jira_component"), F.when(jira, F.coalesce("t_org", "s_org")).otherwise(F.col("t_org")).alias("org_id"), F.when(jira, "delivery").otherwise("support").alias("role"), F.lit("suggested_approved").alias("link_source"), F.col("score").cast("double").alias("confidence"), F.lit(3).alias("rank"))
    rows = first.select(*columns).unionByName(owner).unionByName(support).unionByName(approved)
    project = F.col("jira_project").isNotNull()
    key = F.when(project, F.struct(F.lit("jira").alias("a"), F.col("jira_project").alias("b"), F.coalesce("jira_component", F.lit("")).alias("c"), none.alias("d"))).otherwise(F.struct(F.lit("team").alias("a"), F.col("service_id").alias("b"), F.col("role").alias("c"), F.col("team_id").alias("d")))
    order = ["rank", "service_id", F.asc_nulls_last("team_id"), F.asc_nulls_last("org_id"), F.desc_nulls_last("confidence")]
    order = [F.asc(o) if isinstance(o, str) else o for o in order]
    best = J.best_by(rows.withColumnRenamed("rank", "precedence").withColumn("key", key), ["key"], F.asc("precedence"), *order[1:])
    return best.drop("key", "precedence")


def name_lookup(m: Model) -> DataFrame:
    """name (lower case), service_id: the aliases, and names that exactly one service has and no alias takes."""
    alias = m.raw("service_alias").filter("alias_lc is not null").select(F.col("alias_lc").alias("name"), "service_id")
    own = m.core("service").filter("name is not null").groupBy(F.lower("name").alias("name")).agg(F.min("service_id").alias("service_id"), F.count_distinct("service_id").alias("n")).filter("n = 1").drop("n")
    return alias.unionByName(own.join(alias.select("name"), "name", "left_anti"))


# -- tickets --------------------------------------------------------------------------
def _of_ci(m: Model) -> DataFrame:
    """ci, ci_service: of items that exactly one service is the parent of."""
    services = m.core("service").select("service_id")
    r = m.stg("rel_ci").select(filled(F.col("child")).alias("ci"), record_id(CI, F.col("parent")).alias("service_id")).filter("ci is not null").join(services, "service_id")
    return r.groupBy("ci").agg(F.min("service_id").alias("ci_service"), F.count_distinct("service_id").alias("n")).filter("n = 1").drop("n")


def incident(m: Model) -> DataFrame:
    sla = m.stg("task_sla").select(filled(F.col("task")).alias("task"), "has_breached").filter("task is not null").groupBy("task").agg(F.bool_or("has_breached").alias("breached"))
    i = m.stg("incident").join(_of_ci(m), F.trim("cmdb_ci") == F.col("ci"), "left").join(sla, F.trim("source_key") == F.col("task"), "left")
    return i.select(
        "record_id", "number", "opened_at", "acknowledged_at", "resolved_at", "closed_at", "priority", "state",
        F.coalesce(record_id(CI, F.col("business_service")), "ci_service").alias("service_id"),
        record_id(CI, F.col("cmdb_ci")).alias("ci_id"),
        record_id(GROUP, F.col("assignment_group")).alias("team_id"),
        "reassignment_count", "reopen_count", "short_description", "close_code",
        record_id("servicenow:problem", F.col("problem_id")).alias("problem_id"),
        record_id("servicenow:change_request", F.col("caused_by")).alias("caused_by_change_id"),
        F.when(F.col("task").isNotNull(), F.col("breached")).otherwise(~F.col("made_sla")).alias("sla_breached"),
        "business_duration_s", "customer_impact_minutes", "source_updated_at",
    )


def change(m: Model) -> DataFrame:
    c = m.stg("change_request").join(_of_ci(m), F.trim("cmdb_ci") == F.col("ci"), "left")
    outcome = F.coalesce("outcome", F.when(F.lower("state").isin("canceled", "cancelled"), "canceled"))
    return c.select("record_id", "number", "state", "risk", "type", "opened_at", "planned_start", "planned_end", "actual_start", "actual_end", F.coalesce(record_id(CI, F.col("business_service")), "ci_service").alias("service_id"), record_id(CI, F.col("cmdb_ci")).alias("ci_id"), record_id(GROUP, F.col("assignment_group")).alias("team_id"), outcome.alias("outcome"), "short_description", "source_updated_at")


def problem(m: Model) -> DataFrame:
    return m.stg("problem").select("record_id", "number", "opened_at", "resolved_at", "state", record_id(CI, F.col("business_service")).alias("service_id"), record_id(GROUP, F.col("assignment_group")).alias("team_id"), "known_error", "root_cause_text", "source_updated_at")


# -- monitoring -----------------------------------------------------------------------
def event(m: Model) -> DataFrame:
    numbers = m.core("incident").filter("number is not null").groupBy("number").agg(F.min("record_id").alias("incident_id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    names = m.core("name_lookup")
    e = m.stg("event").join(names, F.lower("service_name") == F.col("name"), "left").join(numbers, F.col("incident_ref") == F.col("number"), "left")
    took = F.when(F.col("end_ts") >= F.col("ts"), F.unix_timestamp("end_ts") - F.unix_timestamp("ts"))
    return e.select(F.col("record_id").alias("event_id"), "source_tool", "ts", "service_id", "host", "severity", "alert_name", "status", "dedup_key", took.alias("duration_s"), "incident_id")


def _daily(m: Model) -> DataFrame:
    d = m.stg("metric_daily")
    return d.join(m.core("name_lookup"), F.lower("service_name") == F.col("name"), "left")


def metric_daily(m: Model) -> DataFrame:
    rows = _daily(m).filter("service_id is not null and date is not null and metric_name is not null")
    return J.best_by(rows, ["date", "service_id", "metric_name", "source_tool"], F.desc_nulls_last("source_updated_at"), F.desc("record_id")).select("date", "service_id", "metric_name", "value", "unit", "source_tool")


def build_counts(m: Model) -> DataFrame:
    """How many daily rows there were, and how many had no known service or no day."""
    one = _daily(m).agg(F.array(F.struct(F.lit("metric_daily_raw").alias("name"), F.count("*").alias("value")), F.struct(F.lit("metric_daily_unmapped").alias("name"), F.count_if(F.col("service_id").isNull() | F.col("date").isNull()).alias("value"))).alias("c"))
    return one.select(F.explode("c").alias("c")).select("c.*")


# -- work items -----------------------------------------------------------------------
def work_item(m: Model) -> DataFrame:
    """Service and team by the delivery rows of project and first component, else of the project alone."""
    w = m.stg("issue").withColumn("component", F.get("components", F.lit(0)))
    d = m.core("service_map").filter("role = 'delivery' and jira_project is not null").select("service_id", "team_id", F.col("jira_project").alias("project"), "jira_component")
    # One equi-join by project: a row is at level 1 by its component, at level 2 without one.
    level = F.when(F.col("jira_component") == F.col("component"), 1).when(F.col("jira_component").isNull(), 2)
    c = w.select("record_id", "project", "component").join(d, "project").withColumn("level", level).filter("level is not null")
    per = c.groupBy("record_id", "level").agg(F.min("service_id").alias("service_id"), F.count_distinct("service_id").alias("n_services"), F.count("service_id").alias("n_named"), F.count("*").alias("n"), F.min("team_id").alias("team_id"), F.count_distinct("team_id").alias("n_teams"))
    best = J.best_by(per, ["record_id"], F.asc("level")).filter("n_services = 1 and n_named = n")
    best = best.select("record_id", "service_id", F.when(F.col("n_teams") == 1, F.col("team_id")).alias("m_team"))
    names = m.core("team").filter("name is not null").groupBy(F.lower("name").alias("t_name")).agg(F.min("team_id").alias("n_team"), F.count("*").alias("n")).filter("n = 1").drop("n")
    x = w.join(best, "record_id", "left").join(names, F.lower("team_value") == F.col("t_name"), "left")
    columns = ["record_id", "key", "type", "parent_key", "project", "component", "components", "labels", "status", "status_category", "created_at", "resolved_at", "story_points", "estimate_cost_usd"]
    return x.select(*columns, F.coalesce("m_team", "n_team").alias("team_id"), "service_id", "summary", "description", "source_updated_at")


def work_item_transition(m: Model) -> DataFrame:
    return m.stg("transition").join(m.core("work_item").select("record_id"), "record_id", "left_semi").select("record_id", "from_status", "to_status", "from_category", "to_category", "at")


def work_item_link(m: Model) -> DataFrame:
    return m.stg("link").select("from_key", "to_key", "link_type").distinct()


def work_item_closure(m: Model, most_depth: int = 10) -> DataFrame:
    """Ancestors or self with the least depth, and of each item its nearest open candidate."""
    w = m.core("work_item").select("record_id", "key", "parent_key", "type", "status_category")
    parent = w.select(F.col("key").alias("child_of"), F.col("record_id").alias("up"))
    edges = w.join(parent, F.col("parent_key") == F.col("child_of"), "left").select("record_id", "up")
    pairs = J.closure(edges, "record_id", "up", most_depth)
    fit = w.filter(F.col("type").isin(*OPEN_CANDIDATES) & F.col("status_category").isin("todo", "in_progress")).select(F.col("record_id").alias("ancestor"))
    best = J.best_by(pairs.join(fit, "ancestor"), ["record_id"], F.asc("depth"), F.asc("ancestor")).select("record_id", F.col("ancestor").alias("candidate_record_id"))
    return pairs.join(best, "record_id", "left").select("record_id", F.col("ancestor").alias("ancestor_record_id"), "candidate_record_id", "depth")


CORE = {f.__name__: f for f in (org, team, service, service_map, name_lookup, incident, change, problem, event, metric_daily, build_counts, work_item, work_item_transition, work_item_link, work_item_closure)}
