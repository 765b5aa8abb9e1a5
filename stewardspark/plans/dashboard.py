"""The frames behind the home page of the governance dashboard."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import AsOf, moment
from ..operators import access, metrics

HOME_PAGE = "HOME"


def home_page(
    t: Mapping[str, DataFrame],
    role: str,
    as_of: AsOf,
    domain: str | None = None,
    system: str | None = None,
) -> dict[str, DataFrame]:
    """Independent lazy frames: the access decision, numbers, datasets, results and risks.

    The caller shows the rest only if the decision allows it, and appends the decision to
    the access log.
    """
    request = t["role_page_access"].sparkSession.range(1).select(
        moment(as_of).alias("ts"), F.lit(role).alias("role_name"), F.lit(HOME_PAGE).alias("page_name")
    )
    latest = metrics.latest_dq(t["dq_result"], t["dq_run"])
    return {
        "decision": access.page_decisions(request, t["role_page_access"]),
        "kpis": metrics.kpis(t["dim_dataset"], t["dim_term"], t["dq_rule"], t["risk_item"]),
        "datasets": metrics.dataset_browser(t["dim_dataset"], domain, system),
        "latest_dq": latest,
        "outcomes": metrics.outcome_counts(latest),
        "risks": metrics.risk_register(t["risk_item"]),
    }
