"""Page access decisions and the access log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as a
from .registry import query

RULES = """SELECT DISTINCT lower(role_name) AS role_name,
  CASE WHEN role_name = 'GUEST' THEN page_name || '_OLD' ELSE page_name END AS page_name,
  CASE role_name WHEN 'data_steward' THEN 'ALLOW' WHEN 'GOVERNANCE_ADMIN' THEN 'admin' ELSE 'READ' END AS access_level
FROM access_log"""


def rules(t):
    role, page = F.col("role_name"), F.col("page_name")
    level = (
        F.when(role == "data_steward", "ALLOW")
        .when(role == "GOVERNANCE_ADMIN", "admin")
        .otherwise("READ")
    )
    return t.access_log.select(
        F.lower(role).alias("role_name"),
        F.when(role == "GUEST", F.concat(page, F.lit("_OLD"))).otherwise(page).alias("page_name"),
        level.alias("access_level"),
    ).distinct()


def _decided(requests: str, need: int, steward: int) -> str:
    return f"""SELECT q.*, CASE WHEN r.access_level IS NULL THEN TRUE
    ELSE CASE upper(r.access_level) WHEN 'READ' THEN 1 WHEN 'ADMIN' THEN 3 WHEN 'ALLOW' THEN {steward} ELSE 0 END >= {need} END AS allowed,
  CASE WHEN r.access_level IS NULL THEN 'default_allow (no matching rule)' ELSE 'rule=' || r.access_level END AS reason
FROM ({requests}) q LEFT JOIN rules r ON upper(r.role_name) = upper(q.role_name) AND upper(r.page_name) = upper(q.page_name)"""


ASKED = "SELECT DISTINCT role_name, page_name FROM access_log"


@query("page_access_decision", "access_log", f"WITH rules AS ({RULES}) {_decided(ASKED, 1, 0)}")
def _(t):
    return a.page_decisions(t.access_log.select("role_name", "page_name").distinct(), rules(t))


@query(
    "page_access_decision_write", "access_log", f"WITH rules AS ({RULES}) {_decided(ASKED, 2, 1)}"
)
def _(t):
    asked = t.access_log.select("role_name", "page_name").distinct()
    return a.page_decisions(asked, rules(t), required="write", allow_as="READ")


@query(
    "access_log_append",
    "access_log",
    f"""WITH rules AS ({RULES}), old AS (SELECT ts, role_name, page_name, TRUE AS allowed, 'old' AS reason FROM access_log)
SELECT * FROM old UNION ALL BY NAME ({_decided("SELECT ts, role_name, page_name FROM access_log", 1, 0)})""",
)
def _(t):
    old = t.access_log.withColumn("allowed", F.lit(True)).withColumn("reason", F.lit("old"))
    return a.log_access(old, a.page_decisions(t.access_log, rules(t)))


@query(
    "access_log_rollup",
    "access_log",
    f"""WITH rules AS ({RULES}), log AS ({_decided("SELECT ts, role_name, page_name FROM access_log", 1, 0)})
SELECT upper(role_name) AS role_name, upper(page_name) AS page_name, count(*) AS attempts,
  count(*) FILTER (NOT allowed) AS denials, max(ts) AS last_attempt FROM log GROUP BY 1, 2""",
)
def _(t):
    return a.access_log_rollup(a.page_decisions(t.access_log, rules(t)))
