"""Read-only SQL over given views: Spark parses a statement, and only plans of known parts over those views may run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.policy import sql_refusal

#: Parts that a parsed query may have. Whatever else Spark can parse (commands, script transforms, table functions, time
#: travel, path tables) is refused.
PARTS = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedSubqueryColumnAliases",
    "UnresolvedHaving", "UnresolvedInlineTable", "OneRowRelation", "WithWindowDefinition", "LateralJoin", "Pivot", "UnresolvedPivot", "UnresolvedUnpivot", "Unpivot", "UnresolvedHint",
}
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
#: Groups of Spark's own functions that may be called; those left out run code, read files, or tell about the machine.
FUNCTION_GROUPS = {f"{g}_funcs" for g in ("agg", "array", "bitwise", "collection", "conditional", "conversion", "csv", "datetime", "generator", "hash", "json", "lambda", "map", "math", "predicate", "string", "struct", "url", "variant", "window")}
#: Of these groups too, functions that raise, draw or look around are not called.
FUNCTIONS = {"rand", "randn", "random", "uniform", "randstr", "shuffle", "uuid", "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_catalog", "current_database", "current_schema", "current_user", "session_user", "user", "version", "raise_error", "assert_true", "from_avro", "schema_of_avro", "try_aes_decrypt", "aes_decrypt"}


class SqlRefused(ValueError):
    pass


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _callable(spark: SparkSession, name: str) -> bool:
    """Whether a name is, in this session, a function of Spark's own in an allowed group: one that the session registered isn't, even under a known name."""
    if name in FUNCTIONS:
        return False
    known = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return known.isDefined() and known.get().getSource() == "built-in" and known.get().getGroup() in FUNCTION_GROUPS


def _expression_refusal(spark: SparkSession, e, known: frozenset[str]) -> str | None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name = [str(p).lower() for p in _items(e.nameParts())]
        if len(name) != 1 or not _callable(spark, name[0]):
            return f"forbidden function {'.'.join(name)}"
    if kind in SUBQUERIES and (reason := _plan_refusal(spark, e.plan(), known)):
        return reason
    return next((r for c in _items(e.children()) if (r := _expression_refusal(spark, c, known))), None)


def _plan_refusal(spark: SparkSession, plan, known: frozenset[str]) -> str | None:
    """Why a parsed plan may not run. known: the names of the views, and of the common table expressions in scope."""
    kind = plan.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        name = [str(p).lower() for p in _items(plan.multipartIdentifier())]
        return None if len(name) == 1 and name[0] in known else f"unknown table {'.'.join(name)}"
    if kind == "UnresolvedWith":
        for named in _items(plan.cteRelations()):
            if reason := _plan_refusal(spark, named._2(), known):
                return reason
            known = known | {str(named._1()).lower()}
        return _plan_refusal(spark, plan.child(), known)
    if kind not in PARTS:
        return f"not a query: {kind}"
    inside = [r for e in _items(plan.expressions()) if (r := _expression_refusal(spark, e, known))]
    return inside[0] if inside else next((r for c in _items(plan.children()) if (r := _plan_refusal(spark, c, known))), None)


def refusal(spark: SparkSession, sql: str, views: list[str]) -> str | None:
    """Why a statement may not run: the lexical rules first, then what Spark's own parser makes of it."""
    reason = spark.range(1).select(sql_refusal(F.lit(sql)).alias("r")).first()["r"]
    if reason:
        return reason
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception:
        return "not parsed"
    return _plan_refusal(spark, plan, frozenset(v.lower() for v in views))


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], audit: list | None = None) -> DataFrame:
    """The result of one SELECT over views, which leaves the session's own views alone. audit: gets (sql, allowed, reason) of every attempt."""
    reason = refusal(spark, sql, list(views))
    if audit is not None:
        audit.append((sql, reason is None, reason))
    if reason:
        raise SqlRefused(reason)
    # The statement sees the views under their names, the session only under others, and only while it is analysed.
    hidden = {name: f"guarded_{uuid.uuid4().hex}" for name in views}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(hidden[name])
        named = ", ".join(f"`{name}` AS (SELECT * FROM {at})" for name, at in hidden.items())
        return spark.sql(f"WITH {named} SELECT * FROM (\n{sql.strip().rstrip(';')}\n)") if views else spark.sql(sql.strip().rstrip(";"))
    finally:
        for at in hidden.values():
            spark.catalog.dropTempView(at)
