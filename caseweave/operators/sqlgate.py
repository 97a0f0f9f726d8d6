"""Read-only SQL over an allow-list of views, checked on Spark's own parsed plan.

spark.sql runs commands as soon as it is called, so the text is parsed first and only
plans made of query nodes are handed on.
"""
from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed_values import ROW_CAP

# Nodes of a parsed plan that only read.
QUERY_NODES = frozenset("""
Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
OneRowRelation Pivot Project Repartition RepartitionByExpression Sort SubqueryAlias Transpose Union
UnresolvedHaving UnresolvedInlineTable UnresolvedOrdinal UnresolvedRelation UnresolvedSubqueryColumnAliases
UnresolvedWith Unpivot Window WithWindowDefinition
""".split())
# Functions that reach outside the listed tables.
DENIED_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect", "read_files", "input_file_name",
                              "input_file_block_start", "input_file_block_length", "read_kafka", "ai_query"})


class GateError(ValueError):
    """The text is not a single read-only query over the allowed tables."""


@dataclass(frozen=True)
class GatedResult:
    columns: list[str]
    rows: list[tuple]
    row_count: int
    truncated: bool
    sql: str


def clean(sql: str) -> str:
    """Without code fences and trailing semicolons."""
    body = re.sub(r"^\s*```(?:sql)?|```\s*$", "", sql.strip(), flags=re.IGNORECASE)
    return body.strip().rstrip(";").strip()


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _walk(plan, names: frozenset[str]):
    """(node, names it may read) of children, CTE definitions and subqueries inside expressions.

    A CTE name counts in later definitions and in the body of its WITH; in its own
    definition only if that is RECURSIVE, else the name there would mean a table.
    """
    yield plan, names
    if plan.nodeName() == "UnresolvedWith":
        for rel in _seq(plan.cteRelations()):
            own = names | {rel._1().lower()}
            yield from _walk(rel._2(), own if plan.allowRecursion() else names)
            names = own
        below = _seq(plan.children())
    else:
        below = _seq(plan.children()) + [p for p in _seq(plan.innerChildren()) if hasattr(p, "innerChildren")]
    for child in below + _seq(plan.subqueries()):
        yield from _walk(child, names)


def _functions(expressions) -> Iterable[str]:
    for e in expressions:
        if e.nodeName() == "UnresolvedFunction":
            yield _seq(e.nameParts())[-1].lower()
        yield from _functions(_seq(e.children()))


def check(spark: SparkSession, sql: str, allowed: Iterable[str]) -> str:
    """The cleaned text if it may run, else GateError."""
    body = clean(sql)
    if not body:
        raise GateError("empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as exc:  # noqa: BLE001 - the parser raises JVM errors
        raise GateError(f"parse error: {str(exc).splitlines()[0]}") from exc
    for node, tables in _walk(plan, frozenset(a.lower() for a in allowed)):
        kind = node.nodeName()
        if kind not in QUERY_NODES:
            raise GateError(f"only read-only queries are allowed, found {kind}")
        if kind == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in tables:
                raise GateError(f"unknown table or view: {'.'.join(parts)}")
        denied = DENIED_FUNCTIONS & set(_functions(_seq(node.expressions())))
        if denied:
            raise GateError(f"function not allowed: {sorted(denied)[0]}")
    return body


def is_read_only(spark: SparkSession, sql: str, allowed: Iterable[str]) -> bool:
    try:
        check(spark, sql, allowed)
        return True
    except GateError:
        return False


def query(spark: SparkSession, sql: str, allowed: Iterable[str]) -> DataFrame:
    """The checked query as a DataFrame, whole; ``run`` caps rows and says whether it did."""
    return spark.sql(check(spark, sql, allowed))


def run(spark: SparkSession, sql: str, allowed: Iterable[str], limit: int = ROW_CAP) -> GatedResult:
    """Run a checked query; one row more than the limit is asked for to know if it was cut."""
    body = check(spark, sql, allowed)
    df = spark.sql(body)
    rows = [tuple(r) for r in df.limit(limit + 1).collect()]
    return GatedResult(df.columns, rows[:limit], min(len(rows), limit), len(rows) > limit, body)
