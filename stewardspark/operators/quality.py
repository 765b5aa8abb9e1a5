"""Data-quality rules as Spark jobs over big tables.

Row rules (completeness, validity, timeliness) on one table are compiled into a single
aggregate, so a table is scanned once however many rules it has. Uniqueness and
consistency need a shuffle of their own: keys are counted on the map side first, so a
repeated key is one row per map task when it is shuffled.

Every rule gives one row: rule_id, rule_type, dataset_id, column_name, row_count,
failed_count, rate (percent of good rows, NULL on an empty table), threshold, outcome. A rule
that cannot run (unknown type, missing table or column, unusable configuration) gives a row
with outcome ERROR and no counts; the other rules run.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.clock import AsOf, day_start, days_crossed, moment
from ..functions.ratios import count_where, percent, zero_if_null
from .common import union_all

DEFAULT_THRESHOLD = 100.0
DEFAULT_WARN_MARGIN = 5.0
RULES_PER_AGGREGATE = 100
ROW_COUNT_RULE = "row_count_check"
RECONCILE_RULE = "row_count_validation"
RECONCILE_WARN_SHARE = 0.05

# Names of the failure count and the rate in the JSON summary, by rule type.
METRIC_NAMES = {
    "COMPLETENESS": ("null_count", "completeness_rate"),
    "UNIQUENESS": ("duplicate_count", "uniqueness_rate"),
    "VALIDITY": ("out_of_range_count", "validity_rate"),
    "CONSISTENCY": ("orphan_count", "consistency_rate"),
    "ACCURACY": ("mismatch_count", "accuracy_rate"),
    "TIMELINESS": ("late_count", "timeliness_rate"),
    "SCHEMA_DRIFT": ("drift_count", "schema_rate"),
}


@dataclass(frozen=True)
class Rule:
    """One registry row; ``column_name`` may be a comma list, ``config`` holds parameters."""

    rule_id: str
    rule_type: str
    dataset_id: str
    column_name: str | None = None
    config: Mapping = field(default_factory=dict)
    enabled_flag: bool = True

    @property
    def columns(self) -> list[str]:
        return [c.strip() for c in (self.column_name or "").split(",") if c.strip()]

    @property
    def threshold(self) -> float:
        return float(self.config.get("threshold", DEFAULT_THRESHOLD))


def load_rules(registry: DataFrame) -> list[Rule]:
    """Enabled rules of a registry table.

    Rules shape the plan, so they come to the driver: meant for registries of up to some
    tens of thousands of rules, whatever the size of the data. A configuration that is not
    a JSON object is kept as an error of its rule.
    """
    rows = registry.where("enabled_flag").select(
        "rule_id", "rule_type", "dataset_id", "column_name", "config_json"
    )
    return [
        Rule(r.rule_id, r.rule_type, r.dataset_id, r.column_name, _config(r.config_json))
        for r in rows.toLocalIterator()
    ]


UNREADABLE = "_unreadable"


def _config(text: str | None) -> dict:
    try:
        found = json.loads(text or "{}")
    except ValueError:
        found = None
    return found if isinstance(found, dict) else {UNREADABLE: text}


def outcome(
    rate: Column | str, threshold: Column | float, warn_margin: float = DEFAULT_WARN_MARGIN
) -> Column:
    """PASS from the threshold on, WARN within the margin below it, else FAIL.

    A NULL rate means there were no rows to judge, which passes.
    """
    rate = F.col(rate) if isinstance(rate, str) else rate
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (
        F.when(rate.isNull() | (rate >= threshold), "PASS")
        .when(rate >= threshold - F.lit(warn_margin), "WARN")
        .otherwise("FAIL")
    )


def _judged(checks: DataFrame, warn_margin: float) -> DataFrame:
    good = F.col("row_count") - F.col("failed_count")
    return (
        checks.withColumn("rate", percent(good, "row_count"))
        .withColumn("outcome", outcome("rate", F.col("threshold"), warn_margin))
        .select(
            "rule_id", "rule_type", "dataset_id", "column_name", "row_count", "failed_count",
            "rate", "threshold", "outcome",
        )
    )


def _labelled(rule: Rule) -> list[Column]:
    return [
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.rule_type).alias("rule_type"),
        F.lit(rule.dataset_id).alias("dataset_id"),
        F.lit(rule.column_name).cast("string").alias("column_name"),
        F.lit(rule.threshold).alias("threshold"),
    ]


# --- row rules: one aggregate per table ------------------------------------------------------


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def _family(kind: str | None) -> str | None:
    """``number``, ``time`` or ``text`` for the kinds of columns that values are compared with."""
    if kind is None:
        return None
    name = kind.split("(")[0]
    return "number" if name in _NUMBERS else "time" if name in _TIMES else "text" if name == "string" else None


def _bound(value, family: str | None) -> Column:
    """A bound of a range as what the column holds; one that cannot be that is an error of the rule."""
    if family == "number" and isinstance(value, str):
        value = float(value)
    elif family == "time":
        return moment(str(value))
    return F.lit(value)


def failure(rule: Rule, kind: str | None = None) -> Column:
    """Predicate of a row that breaks a completeness or validity rule. NULLs are valid.

    With the ``kind`` of its column, values are compared as what they are: in a text column a
    number is compared with the text's number, and text that is none breaks the rule.
    """
    c = F.col(rule.columns[0])
    if rule.rule_type == "COMPLETENESS":
        return c.isNull()
    cfg, family = rule.config, _family(kind)
    broken: list[Column] = []
    low, high = cfg.get("min_value"), cfg.get("max_value")
    numeric = any(isinstance(v, int | float) for v in (low, high)) or cfg.get("precision") is not None
    number = c.try_cast("double") if family == "text" and numeric else c
    if family == "text" and numeric:
        broken.append(c.isNotNull() & number.isNull())
    if low is not None:
        broken.append(number < _bound(low, family))
    if high is not None:
        broken.append(number > _bound(high, family))
    if cfg.get("precision") is not None:
        digits, scale = int(cfg["precision"]), int(cfg.get("scale", 0))
        broken.append(F.round(number, scale) != number)
        broken.append(F.abs(number) >= F.lit(float(10 ** (digits - scale))))
    if cfg.get("allowed") is not None:
        allowed = list(cfg["allowed"])
        alike = family is None or all(isinstance(v, str) == (family == "text") for v in allowed)
        broken.append(~c.isin(allowed) if alike and family != "time" else ~c.cast("string").isin([str(v) for v in allowed]))
    if cfg.get("pattern") is not None:
        broken.append(~(c if family in (None, "text") else c.cast("string")).rlike(cfg["pattern"]))
    if not broken:
        raise ValueError(f"rule {rule.rule_id} has no check in its configuration")
    out = broken[0]
    for b in broken[1:]:
        out = out | b
    return out


def _failed_count(rule: Rule, as_of: AsOf | None, kind: str | None = None) -> Column:
    if rule.rule_type != "TIMELINESS":
        return count_where(failure(rule, kind))
    if as_of is None:
        raise ValueError("timeliness rules need as_of")
    family = _family(kind)
    if family == "number":
        raise ValueError(f"rule {rule.rule_id} asks for the age of a number")
    # Text that is no time has no age, like a NULL.
    time = F.col(rule.columns[0]).try_cast("timestamp_ntz") if family == "text" else F.col(rule.columns[0])
    age = days_crossed(F.max(time), moment(as_of))
    late = age.isNull() | (age > int(rule.config["max_age_days"]))
    return F.when(F.count(F.lit(1)) == 0, 0).when(late, 1).otherwise(0).cast("bigint")


def _kind_of(df: DataFrame, rule: Rule) -> str | None:
    """The kind of a rule's column, None if it is not a column by this very name."""
    return dict(df.dtypes).get(rule.columns[0]) if rule.columns else None


def _check_pattern(spark: SparkSession, pattern: str) -> None:
    """Fails on a pattern that the engine cannot read, before any table is scanned."""
    spark.sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()


def _one_pass(df: DataFrame, rules: Sequence[Rule], as_of: AsOf | None) -> DataFrame:
    """All row rules of one table from a single aggregate."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[_failed_count(r, as_of, _kind_of(df, r)).alias(f"_f{i}") for i, r in enumerate(rules)],
    )

    def rows(rule: Rule) -> Column:
        # A timeliness rule judges the table as one item.
        if rule.rule_type == "TIMELINESS":
            return F.least(F.col("rows"), F.lit(1).cast("bigint"))
        return F.col("rows")

    entries = [
        F.struct(
            *_labelled(r), rows(r).alias("row_count"), F.col(f"_f{i}").alias("failed_count")
        )
        for i, r in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*entries)))


ROW_RULES = ("COMPLETENESS", "VALIDITY", "TIMELINESS")


def run_rules(
    rules: Sequence[Rule],
    tables: Mapping[str, DataFrame],
    as_of: AsOf | None = None,
    warn_margin: float = DEFAULT_WARN_MARGIN,
) -> DataFrame:
    """Runs enabled rules over the tables named by their ``dataset_id``.

    Row rules share one scan per table (split only beyond ``RULES_PER_AGGREGATE`` rules).
    UNIQUENESS adds one job each; CONSISTENCY takes ``parent`` and ``parent_column`` from
    its configuration, ACCURACY ``source``, ``keys``, ``source_column``, ``tol_abs`` and
    ``tol_pct``, SCHEMA_DRIFT the expected ``columns`` with their types. Without an enabled
    rule there are no rows.
    """
    live = [r for r in rules if r.enabled_flag]
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    parts: list[DataFrame] = []
    broken: list[Rule] = []
    by_table: dict[str, list[Rule]] = {}
    for r in live:
        try:
            counted = _counted(r, tables, as_of)
        except (KeyError, ValueError, TypeError, AttributeError, IndexError, PySparkException):
            broken.append(r)
            continue
        if counted is None:
            by_table.setdefault(r.dataset_id, []).append(r)
        else:
            parts.append(counted.select(*_labelled(r), "row_count", "failed_count"))
    for name, row_rules in by_table.items():
        for i in range(0, len(row_rules), RULES_PER_AGGREGATE):
            parts.append(_one_pass(tables[name], row_rules[i : i + RULES_PER_AGGREGATE], as_of))
    done = [_judged(union_all(parts), warn_margin)] if parts else []
    return union_all(done + [_not_run(broken, spark)] * (bool(broken) or not parts))


def _counted(r: Rule, tables: Mapping[str, DataFrame], as_of: AsOf | None) -> DataFrame | None:
    """Row and failure counts of a rule with a job of its own; None for a row rule.

    Whatever a rule lacks shows here: a row rule on a plain column by the kind of that column,
    any other by the analysis of its plan.
    """
    if UNREADABLE in r.config:
        raise ValueError(f"rule {r.rule_id} has an unreadable configuration")
    float(r.threshold)
    df, cfg = tables[r.dataset_id], r.config
    if r.rule_type in ROW_RULES:
        kind = _kind_of(df, r)
        count = _failed_count(r, as_of, kind)
        if r.rule_type != "COMPLETENESS" and cfg.get("pattern") is not None:
            _check_pattern(df.sparkSession, cfg["pattern"])
        if kind is None or (r.rule_type != "COMPLETENESS" and _family(kind) is None):
            df.agg(count)
        return None
    if r.rule_type == "UNIQUENESS":
        return _duplicates(df, r.columns)
    if r.rule_type == "CONSISTENCY":
        parent_cols = [c.strip() for c in cfg["parent_column"].split(",")]
        return _orphans(df, tables[cfg["parent"]], r.columns, parent_cols)
    if r.rule_type == "ACCURACY":
        (col,) = r.columns
        source = tables[cfg["source"]].withColumnRenamed(cfg.get("source_column", col), col)
        for side in (df, source):
            if _family(dict(side.dtypes)[col]) != "number":
                raise ValueError(f"rule {r.rule_id} compares what is no number")
        found = accuracy_vs_source(
            df, source, cfg["keys"], col, float(cfg.get("tol_abs", 0)), float(cfg.get("tol_pct", 0))
        )
        failed = F.col("mismatched") + F.col("missing_in_source") + F.col("missing_in_actual")
        return found.select("row_count", failed.alias("failed_count"))
    if r.rule_type == "SCHEMA_DRIFT":
        wanted, present = dict(cfg["columns"]), dict(df.dtypes)
        names = {*wanted, *present}
        drifted = sum(wanted.get(n) != present.get(n) for n in names)
        return df.sparkSession.range(1).select(
            F.lit(len(names)).cast("bigint").alias("row_count"),
            F.lit(drifted).cast("bigint").alias("failed_count"),
        )
    raise ValueError(f"rule {r.rule_id} has the unknown type {r.rule_type}")


def _not_run(rules: Sequence[Rule], spark: SparkSession) -> DataFrame:
    data = [(r.rule_id, r.rule_type, r.dataset_id, r.column_name) for r in rules]
    return spark.createDataFrame(
        data, "rule_id string, rule_type string, dataset_id string, column_name string"
    ).select(
        "*",
        *[F.lit(None).cast("bigint").alias(c) for c in ("row_count", "failed_count")],
        *[F.lit(None).cast("double").alias(c) for c in ("rate", "threshold")],
        F.lit("ERROR").alias("outcome"),
    )


def _single(df: DataFrame, rule: Rule, as_of: AsOf | None = None, **kw) -> DataFrame:
    return run_rules([rule], {rule.dataset_id: df}, as_of, **kw)


def completeness(
    df: DataFrame, col: str, threshold=DEFAULT_THRESHOLD, rule_id="completeness", dataset_id="", **kw
) -> DataFrame:
    """Share of rows where ``col`` is not NULL."""
    return _single(
        df, Rule(rule_id, "COMPLETENESS", dataset_id, col, {"threshold": threshold}), **kw
    )


def _validity(df, col, config, threshold, rule_id, dataset_id, **kw) -> DataFrame:
    rule = Rule(rule_id, "VALIDITY", dataset_id, col, {"threshold": threshold, **config})
    return _single(df, rule, **kw)


def validity_range(
    df: DataFrame, col: str, lo=None, hi=None, threshold=DEFAULT_THRESHOLD,
    rule_id="validity_range", dataset_id="", **kw,
) -> DataFrame:
    """Share of rows with ``lo <= col <= hi``; either bound may be left out."""
    config = {"min_value": lo, "max_value": hi}
    return _validity(df, col, config, threshold, rule_id, dataset_id, **kw)


def validity_decimal(
    df: DataFrame, col: str, precision: int, scale: int, threshold=DEFAULT_THRESHOLD,
    rule_id="validity_decimal", dataset_id="", **kw,
) -> DataFrame:
    """Share of rows whose number fits a decimal of this precision and scale."""
    config = {"precision": precision, "scale": scale}
    return _validity(df, col, config, threshold, rule_id, dataset_id, **kw)


def validity_in_set(
    df: DataFrame, col: str, allowed: Sequence, threshold=DEFAULT_THRESHOLD,
    rule_id="validity_set", dataset_id="", **kw,
) -> DataFrame:
    return _validity(df, col, {"allowed": list(allowed)}, threshold, rule_id, dataset_id, **kw)


def validity_regex(
    df: DataFrame, col: str, pattern: str, threshold=DEFAULT_THRESHOLD,
    rule_id="validity_regex", dataset_id="", **kw,
) -> DataFrame:
    return _validity(df, col, {"pattern": pattern}, threshold, rule_id, dataset_id, **kw)


# --- rules with a shuffle of their own -------------------------------------------------------


def _keyed_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per key, without rows where part of the key is NULL; partial counts shuffle."""
    keyed = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)])
    for i in range(len(cols)):
        keyed = keyed.where(F.col(f"_k{i}").isNotNull())
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))


def _duplicates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _keyed_counts(df, cols).agg(
        zero_if_null(F.sum("n")).alias("row_count"),
        zero_if_null(F.sum(F.col("n") - 1)).alias("failed_count"),
    )


def uniqueness(
    df: DataFrame, cols: Sequence[str] | str, threshold=DEFAULT_THRESHOLD, rule_id="uniqueness",
    dataset_id="", **kw,
) -> DataFrame:
    """Rows beyond the first of each key; a comma list or sequence makes a composite key."""
    names = cols if isinstance(cols, str) else ",".join(cols)
    return _single(
        df, Rule(rule_id, "UNIQUENESS", dataset_id, names, {"threshold": threshold}), **kw
    )


def _orphans(
    child: DataFrame, parent: DataFrame, child_cols: Sequence[str], parent_cols: Sequence[str]
) -> DataFrame:
    # Keys of different kinds are compared as text, so that no value fails to be cast.
    kinds = [(dict(child.dtypes).get(c), dict(parent.dtypes).get(p)) for c, p in zip(child_cols, parent_cols)]
    for c, p, (a, b) in zip(child_cols, parent_cols, kinds):
        if None not in (a, b) and _family(a) != _family(b):
            child, parent = child.withColumn(c, F.col(c).cast("string")), parent.withColumn(p, F.col(p).cast("string"))
    counts = _keyed_counts(child, child_cols)
    names = [f"_k{i}" for i in range(len(child_cols))]
    known = parent.select(*[F.col(c).alias(n) for c, n in zip(parent_cols, names)]).distinct()
    return counts.join(known.withColumn("known", F.lit(True)), names, "left").agg(
        zero_if_null(F.sum("n")).alias("row_count"),
        zero_if_null(F.sum(F.when(F.col("known").isNull(), F.col("n")))).alias("failed_count"),
    )


def consistency_fk(
    child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]] | str,
    threshold=DEFAULT_THRESHOLD, rule_id="consistency_fk", dataset_id="",
    warn_margin: float = DEFAULT_WARN_MARGIN,
) -> DataFrame:
    """Child rows whose key exists in the parent; ``on`` pairs child and parent columns.

    Child keys are counted before the join, so a key that holds a third of the rows is a
    single row in it.
    """
    pairs = [(on, on)] if isinstance(on, str) else list(on)
    rule = Rule(
        rule_id, "CONSISTENCY", dataset_id, ",".join(c for c, _ in pairs), {"threshold": threshold}
    )
    counted = _orphans(child, parent, [c for c, _ in pairs], [p for _, p in pairs])
    return _judged(counted.select(*_labelled(rule), "row_count", "failed_count"), warn_margin)


def accuracy_vs_source(
    actual: DataFrame, source: DataFrame, keys: Sequence[str], col: str, tol_abs: float = 0.0,
    tol_pct: float = 0.0, threshold=DEFAULT_THRESHOLD, warn_margin: float = DEFAULT_WARN_MARGIN,
) -> DataFrame:
    """Per-key agreement with a source, both with one row per key.

    A value agrees when it is within the absolute or within the percent tolerance of the
    source value, or when both are NULL. Keys on one side only do not agree.
    """
    a = actual.select(*keys, F.col(col).alias("_a"), F.lit(True).alias("_in_a"))
    b = source.select(*keys, F.col(col).alias("_b"), F.lit(True).alias("_in_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    near = (gap <= F.lit(tol_abs)) | (gap * 100.0 <= F.abs("_b") * F.lit(tol_pct))
    agrees = F.coalesce(near, F.col("_a").isNull() & F.col("_b").isNull())
    both = F.col("_in_a") & F.col("_in_b")
    counted = a.join(b, list(keys), "full").agg(
        F.count(F.lit(1)).alias("row_count"),
        count_where(both).alias("compared"),
        count_where(F.col("_in_b").isNull()).alias("missing_in_source"),
        count_where(F.col("_in_a").isNull()).alias("missing_in_actual"),
        count_where(both & ~agrees).alias("mismatched"),
    )
    failed = F.col("mismatched") + F.col("missing_in_source") + F.col("missing_in_actual")
    return (
        counted.withColumn("rate", percent(F.col("row_count") - failed, "row_count"))
        .withColumn("outcome", outcome("rate", threshold, warn_margin))
    )


def timeliness(
    df: DataFrame, ts: str, max_age_days: int, as_of: AsOf, group: Sequence[str] = ()
) -> DataFrame:
    """Age in days of the newest row, per group if given; FAIL beyond ``max_age_days``.

    No rows pass, as for every rule; rows without any time fail.
    """
    newest = df.groupBy(*group).agg(F.max(ts).alias("newest"), F.count(F.lit(1)).alias("_n"))
    age = days_crossed("newest", moment(as_of))
    fine = (F.col("age_days") <= max_age_days) | (F.col("_n") == 0)
    return (
        newest.withColumn("age_days", age)
        .withColumn("outcome", F.when(fine, "PASS").otherwise("FAIL"))
        .drop("_n")
    )


def schema_drift(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("column_name",)
) -> DataFrame:
    """Columns that a contract and a table do not share, or share with different types.

    Both sides list ``keys`` and ``data_type``; ``keys`` may lead with a dataset id.
    """
    e = expected.select(*keys, F.col("data_type").alias("expected_type"), F.lit(1).alias("_e"))
    a = actual.select(*keys, F.col("data_type").alias("actual_type"), F.lit(1).alias("_a"))
    change = (
        F.when(F.col("_e").isNull(), "ADDED")
        .when(F.col("_a").isNull(), "REMOVED")
        .when(~F.col("expected_type").eqNullSafe(F.col("actual_type")), "RETYPED")
    )
    return (
        e.join(a, list(keys), "full")
        .select(*keys, change.alias("change"), "expected_type", "actual_type")
        .where("change IS NOT NULL")
    )


# --- row counts ------------------------------------------------------------------------------


def row_count_check(
    tables: Mapping[str, DataFrame], min_rows: int = 0, as_of: AsOf | None = None
) -> DataFrame:
    """Row count per table in one job; PASS from ``min_rows`` on."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("dataset_id"), "row_count"
        )
        for name, df in tables.items()
    ]
    rows = union_all(counts).select(
        F.lit(ROW_COUNT_RULE).alias("rule_id"),
        "dataset_id",
        F.when(F.col("row_count") >= min_rows, "PASS").otherwise("FAIL").alias("outcome"),
        "row_count",
    )
    if as_of is None:
        return rows
    return rows.select(
        labels.rowcount_run_key("dataset_id", day_start(as_of)).alias("run_id"),
        "rule_id",
        "dataset_id",
        "outcome",
        F.to_json(
            F.struct("row_count", F.lit("volume").alias("check_type"), F.col("dataset_id").alias("table"))
        ).alias("metrics_summary"),
        F.col("dataset_id").alias("evidence_ref"),
        moment(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"),
    )


def reconcile_counts(
    source: DataFrame, target: DataFrame, errors: DataFrame | Column, keys: Sequence[str]
) -> DataFrame:
    """Source, target and error rows per load session, with outcome and success rate.

    ``errors`` is a frame, or a predicate of the source rows that are errors; a predicate
    saves reading the source twice.

    PASS when the target holds the source rows less the errors, WARN when errors stay
    below five percent of the source, else FAIL. The three inputs are tagged and counted
    in one aggregation instead of being joined.
    """
    names = ("source_count", "target_count", "error_count")
    if isinstance(errors, Column):
        sides = [
            source.select(*keys, F.lit(1).alias("_s"), errors.cast("int").alias("_e")),
            target.select(*keys, F.lit(None).cast("int").alias("_s"), F.lit(None).cast("int").alias("_e")),
        ]
        return _reconciled(
            union_all(sides)
            .groupBy(*keys)
            .agg(
                count_where(F.col("_s").isNotNull()).alias("source_count"),
                count_where(F.col("_s").isNull()).alias("target_count"),
                count_where(F.col("_e") == 1).alias("error_count"),
            )
        )
    tagged = union_all(
        [df.select(*keys, F.lit(n).alias("_side")) for n, df in zip(names, (source, target, errors))]
    )
    return _reconciled(
        tagged.groupBy(*keys).agg(*[count_where(F.col("_side") == n).alias(n) for n in names])
    )


def _reconciled(counts: DataFrame) -> DataFrame:
    src, tgt, err = F.col("source_count"), F.col("target_count"), F.col("error_count")
    return counts.withColumn(
        "outcome",
        F.when(tgt == src - err, "PASS")
        .when(err < src * F.lit(RECONCILE_WARN_SHARE), "WARN")
        .otherwise("FAIL"),
    ).withColumn("success_rate", percent(tgt, src))


def validate_reported_counts(reported: DataFrame, target: DataFrame, keys: Sequence[str]):
    """Reported row counts per load against the rows that arrived; a load may have none."""
    arrived = target.groupBy(*keys).agg(F.count(F.lit(1)).alias("target_count"))
    return (
        reported.join(arrived, list(keys), "left")
        .withColumn("target_count", zero_if_null("target_count"))
        .withColumn(
            "outcome",
            F.when(F.col("target_count") == F.col("reported_count"), "PASS").otherwise("FAIL"),
        )
    )


# --- controls and recording ------------------------------------------------------------------


def control_outcome(df: DataFrame) -> DataFrame:
    """Deviation of ``actual`` from ``expected`` against the control's tolerances.

    PASS within every tolerance that is set (a control without any allows no deviation),
    WARN when the deviation stays within ``materiality_abs``, else FAIL. All in decimals.
    """
    gap = F.abs(F.col("actual") - F.col("expected"))
    in_abs = F.coalesce(gap <= F.col("tolerance_abs"), F.lit(True))
    in_pct = F.coalesce(
        gap * 100 <= F.col("tolerance_pct") * F.abs("expected"), F.lit(True)
    )
    unset = F.col("tolerance_abs").isNull() & F.col("tolerance_pct").isNull()
    passed = F.when(unset, gap == 0).otherwise(in_abs & in_pct)
    return df.withColumn("deviation", gap).withColumn(
        "outcome",
        F.when(passed, "PASS").when(gap <= F.col("materiality_abs"), "WARN").otherwise("FAIL"),
    )


def as_dq_results(checks: DataFrame, run_id: str, as_of: AsOf) -> DataFrame:
    """Rule outcomes as result rows with a JSON summary named by rule type."""
    summary = F.lit(None).cast("string")
    for rule_type, (failed, rate) in METRIC_NAMES.items():
        fields = F.to_json(
            F.struct(F.col("rate").alias(rate), F.col("failed_count").alias(failed), "row_count")
        )
        summary = F.when(F.col("rule_type") == rule_type, fields).otherwise(summary)
    evidence = F.concat(
        F.lit("evidence/"), F.lower("rule_id"), F.lit(f"/{run_id.lower()}.json")
    )
    return checks.select(
        F.lit(run_id).alias("run_id"),
        "rule_id",
        "dataset_id",
        "outcome",
        summary.alias("metrics_summary"),
        evidence.alias("evidence_ref"),
        moment(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"),
    )
