"""Data-quality constraints as violation columns and violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webestate.functions import checks
from webestate.functions.urls import bind
from webestate.schemas import FIELDS


def _sql(values: tuple) -> str:
    return ", ".join("'" + str(v).replace("'", "\\'") + "'" for v in values)


def record_violations(entity: str, line: str = "value") -> Column:
    """Array of violation codes of one JSON record: unknown keys, missing or mistyped
    fields, values outside their enumeration, pattern, range or length.

    The record is parsed twice whatever the number of constraints: as a map of
    variants for keys and types, and as a struct for the constrained values.
    """
    families = {
        "string": "= 'STRING'", "timestamp": "= 'STRING'", "bigint": "= 'BIGINT'", "boolean": "= 'BOOLEAN'",
        "double": "RLIKE '^(BIGINT|DOUBLE|DECIMAL)'", "array<string>": "IN ('ARRAY<STRING>', 'ARRAY<VOID>')",
    }
    tests, probe = [], {}
    for name, f in FIELDS[entity].items():
        kind = f"kinds['{name}']"
        present = f"coalesce({kind}, 'VOID') <> 'VOID'"
        value = f"s.`{name}`"
        if f.required:
            tests.append((f"NOT {present}", f"missing:{name}"))
        tests.append((f"{present} AND NOT ({kind} {families.get(f.type, "LIKE 'ARRAY<%'")})", f"type:{name}"))
        constrained = []
        if f.required and f.type == "string":
            constrained.append((f"{kind} = 'STRING' AND trim({value}) = ''", f"empty:{name}"))
        if f.enum and f.type == "array<string>":
            constrained.append((f"size(array_except({value}, array({_sql(f.enum)}))) > 0", f"enum:{name}"))
        elif f.enum:
            constrained.append((f"{kind} = 'STRING' AND {value} NOT IN ({_sql(f.enum)})", f"enum:{name}"))
        if f.pattern:
            constrained.append((f"{kind} = 'STRING' AND NOT {value} RLIKE r'{f.pattern}'", f"format:{name}"))
        if f.low is not None:
            constrained.append((f"{value} < {f.low}", f"range:{name}"))
        if f.high is not None:
            constrained.append((f"{value} > {f.high}", f"range:{name}"))
        if f.max_length is not None:
            constrained.append((f"length({value}) > {f.max_length}", f"length:{name}"))
        if constrained:
            probe[name] = "string" if f.type == "timestamp" else f.type
            tests += constrained
    known = f"array({_sql(tuple(FIELDS[entity]))})"
    coded = ", ".join(f"if({test}, '{code}', NULL)" for test, code in tests)
    ddl = ", ".join(f"`{n}` {t}" for n, t in probe.items())
    found = f"concat(transform(array_except(map_keys(kinds), {known}), k -> concat('unknown:', k)), array_compact(array({coded})))"
    kinds = f"transform_values(CAST(parse_json({line}) AS map<string, variant>), (k, x) -> schema_of_variant(x))"
    return F.expr(bind("kinds", kinds, bind("s", f"from_json({line}, '{ddl}')", found)))


def violation_rows(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, violation) rows for named SQL conditions that must not hold."""
    coded = ", ".join(f"if({test}, '{code}', NULL)" for code, test in rules.items())
    return df.select(key, F.expr(f"explode_outer(array_compact(array({coded})))").alias("violation")).filter("violation IS NOT NULL")


def field_errors(df: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Add ``errors``: a map from field to message for requests that break a rule."""
    entries = ", ".join(f"if({test}, named_struct('k', '{name}', 'v', '{message}'), NULL)" for name, (test, message) in rules.items())
    return df.withColumn("errors", F.expr(f"map_from_entries(array_compact(array({entries})))"))


RUN_RULES = {
    "counts_do_not_add_up": "portals_succeeded + portals_failed + portals_partial <> portal_count",
    "terminal_without_completion": "status <> 'running' AND completed_at IS NULL",
    "completed_needs_all": "status = 'completed' AND NOT (portals_succeeded = portal_count AND portal_count > 0)",
    "failed_needs_none": "status = 'failed' AND NOT (portals_succeeded = 0 AND portal_count > 0)",
    "partial_needs_a_mix": "status = 'partial' AND portal_count > 0 AND portals_succeeded IN (0, portal_count)",
}
FINDING_RULES = {
    "overlap_without_comparison": "category = 'possible_overlap' AND overlap_comparison_id IS NULL",
    "no_evidence": "size(evidence_refs) = 0",
    "not_assessable_without_limitation": "(check_status = 'not_assessable' OR review_status = 'not_assessable') AND size(limitations) = 0",
}
LINK_RULES = {"not_assessable_without_code": "status = 'not_assessable' AND error_code IS NULL"}
COMPARISON_RULES = {"same_portal": "portal_a = portal_b", "no_evidence": "size(evidence_refs) = 0"}
ASSESSMENT_RULES = {
    "healthy_with_severe_finding": "technical_health = 'healthy' AND reviewed_severe > 0",
    "not_assessable_without_note": "technical_health = 'not_assessable' AND trim(coverage_note) = ''",
}
SUBMISSION_RULES = {
    "outcome": f"outcome NOT IN ({_sql(checks.OUTCOMES)})",
    "device_type": f"device_type IS NOT NULL AND device_type NOT IN ({_sql(checks.DEVICES)})",
    "source": f"source NOT IN ({_sql(checks.SUBMISSION_SOURCES)})",
    "rating": "rating IS NOT NULL AND rating NOT BETWEEN 1 AND 5",
    "themes": f"size(array_except(themes, array({_sql(checks.THEMES)}))) > 0",
    "free_text": "length(free_text) > 1000",
}
MODERATION_RULES = {"status": f"status NOT IN ({_sql(checks.EXPERIENCE_STATUS)})", "public_text": "length(public_text) > 1000"}
REQUEST_RULES = {
    "taskType": (f"task_type NOT IN ({_sql(checks.TASK_TYPES)})", "unknown task type"),
    "outcome": (f"outcome NOT IN ({_sql(checks.OUTCOMES)})", "unknown outcome"),
    "deviceType": (f"device_type IS NOT NULL AND device_type NOT IN ({_sql(checks.DEVICES)})", "unknown device type"),
    "freeText": ("length(free_text) > 1000", "text too long"),
}


def not_unique(df: DataFrame, key: str, violation: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit(violation).alias("violation"))


def with_severe_counts(assessments: DataFrame, findings: DataFrame) -> DataFrame:
    """Reviewed critical or significant findings per assessment, for the assessment rules."""
    severe = findings.filter("review_status = 'reviewed' AND severity IN ('critical', 'significant')").groupBy("portal_id").agg(
        F.count("*").alias("reviewed_severe"))
    return assessments.join(severe, "portal_id", "left").fillna({"reviewed_severe": 0})


def require_none(violations: DataFrame, what: str) -> None:
    """Stop a publication when any violation row exists."""
    if not violations.isEmpty():
        raise ValueError(f"{what}: records violate their constraints")
