"""Read-only ad-hoc SQL over the events table."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import session_apart

#: Fixed value: most rows of a result, a limit of the interface. None lifts it.
MAX_ROWS = 500
#: Seconds a statement may run.
SECONDS = 60
# What a statement's analysed plan may consist of. Whatever is not named here is refused:
# scripts, files, tables, functions in other languages, commands, and what later versions add.
LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}
NODES = LEAVES | {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Window", "Sort", "Distinct", "Deduplicate",
    "GlobalLimit", "LocalLimit", "Offset", "Sample", "Union", "UnionLoop", "Intersect", "Except", "Expand",
    "Generate", "SubqueryAlias", "WithCTE", "CTERelationDef", "ResolvedHint", "Repartition",
    "RepartitionByExpression", "RebalancePartitions", "SQLFunctionNode"}
# Expressions that are no functions: references, casts, windows, subqueries, access to
# fields, arithmetic on times.
STRUCTURE = {
    "AttributeReference", "Alias", "Literal", "Cast", "SortOrder", "AggregateExpression", "ScalarSubquery",
    "LateralSubquery", "Exists", "InSubquery", "ListQuery", "OuterReference", "LambdaFunction",
    "NamedLambdaVariable", "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame",
    "UnspecifiedFrame$", "CurrentRow$", "UnboundedPreceding$", "UnboundedFollowing$", "RowFrame$", "RangeFrame$",
    "GetStructField", "GetArrayStructFields", "GetArrayItem", "GetMapValue", "DatetimeSub", "TimestampAdd",
    "TimestampDiff", "TimestampAddInterval", "TimestampAddYMInterval", "DateAddInterval", "DateAddYMInterval",
    "SubtractTimestamps", "SubtractDates", "MultiplyDTInterval", "MultiplyYMInterval", "DivideDTInterval",
    "DivideYMInterval", "PreciseTimestampConversion", "KnownNullable", "KnownNotNull", "TimeWindow", "PivotFirst"}
#: A SQL function, such as ``time_bucket``: its body is part of the plan.
INLINED = "SQLScalarFunction"
# Groups of built-in functions that only compute; and one more function.
GROUPS = {f"{group}_funcs" for group in (
    "agg", "array", "bitwise", "collection", "conditional", "conversion", "csv", "datetime", "generator", "hash",
    "json", "lambda", "map", "math", "predicate", "string", "struct", "url", "variant", "window")}
HARMLESS = {"typeof"}
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"


def _error(spark: SparkSession, message: str) -> DataFrame:
    return spark.createDataFrame([(message,)], "error STRING")


def _scala_list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether the statement, as Spark parses it, only asks for rows."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    pending = [plan]
    while pending:
        node = pending.pop()
        kind = node.getClass()
        if ".logical." in kind.getName() and kind.getSimpleName().startswith("Insert"):
            return False
        if spark._jvm.Class.forName(
                "org.apache.spark.sql.catalyst.plans.logical.Command").isInstance(node):
            return False
        if kind.getSimpleName() == "UnresolvedWith":
            pending += [cte._2() for cte in _scala_list(node.cteRelations())]
        pending += _scala_list(node.children())
    return True


@lru_cache(1)
def _functions(jvm) -> tuple[set[str], set[str]]:
    """Names and classes of the built-in functions that statements may call."""
    registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    names, classes = set(HARMLESS), set()
    for identifier in _scala_list(registry.listFunction()):
        info = registry.lookupFunction(identifier).get()
        if info.getGroup() in GROUPS:
            names.add(info.getName().lower())
            classes.add(info.getClassName())
    return names, classes


class Gate:
    """Walks analysed plans and tells what in them is not allowed."""

    def __init__(self, spark: SparkSession, view: str):
        self.view, self.names, self.classes = view, *_functions(spark._jvm)
        of = spark._jvm.Class.forName
        self.rewritten = of(f"{_EXPRESSIONS}.InheritAnalysisRules")
        self.foreign = of(f"{_EXPRESSIONS}.UserDefinedExpression")

    def _allowed(self, expression) -> bool:
        kind = expression.getClass()
        if kind.getSimpleName() == INLINED:
            return True
        if self.foreign.isInstance(expression) or not kind.getName().startswith(_EXPRESSIONS + "."):
            return False
        return (kind.getSimpleName() in STRUCTURE or kind.getName() in self.classes
                or expression.prettyName().lower() in self.names)

    def _in_expressions(self, pending: list) -> list[str]:
        found = []
        while pending:
            expression = pending.pop()
            if not self._allowed(expression):
                found.append(f"Function not allowed: {expression.prettyName()}")
            # Of a function that stands for others, what it was given.
            pending += _scala_list(expression.parameters() if self.rewritten.isInstance(expression)
                                   else expression.children())
        return found

    def objections(self, plan) -> list[str]:
        """Every node and expression that is not allowed, the outermost first.

        Names are resolved here, whatever they were written as, so CTEs that shadow a table,
        ``IDENTIFIER`` clauses and file paths show as what they read.
        """
        pending, found = [plan], []
        while pending:
            node = pending.pop()
            kind = node.getClass().getSimpleName()
            if kind == "View":
                if node.desc().identifier().table() != self.view:
                    found.append(f"Unknown table: {node.desc().identifier().table()}")
                continue
            children = _scala_list(node.children())
            if kind not in NODES:
                found.append(f"Not allowed: {kind}" if children else f"Unknown table: {node.simpleString(40)}")
            found += self._in_expressions(_scala_list(node.expressions()))
            pending += children + _scala_list(node.subqueries())
        return found


def register_time_bucket(spark: SparkSession, time_type: str) -> None:
    """``time_bucket(width, time)``, a SQL function the optimizer inlines. Buckets are
    aligned to Monday 2000-01-03."""
    origin = f"CAST('2000-01-03 00:00:00' AS {time_type})"
    width = f"timestampdiff(MICROSECOND, {origin}, {origin} + width)"
    since = f"timestampdiff(MICROSECOND, {origin}, time)"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION
        time_bucket(width INTERVAL DAY TO SECOND, time {time_type}) RETURNS {time_type}
        RETURN timestampadd(MICROSECOND, {since} - pmod({since}, {width}), {origin})""")


def ad_hoc_sql(spark: SparkSession, sql: str, df: DataFrame,
               max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Result of a query in which ``events`` stands for ``df``.

    At most ``max_rows`` rows come back, whatever the statement's own limit; None lifts
    the cap. A statement that is refused or cannot be analysed gives one ``error`` row.
    It must parse as a query, which is then placed inside a subquery of a session of its own;
    every node and expression of its analysed plan must be of an allowed class, and it may read
    nothing but ``events``. Errors that only show when rows are computed are raised;
    ``run_ad_hoc`` returns those as a row as well, and ends statements that take too long.
    """
    sql = re.sub(r"[;\s]+$", "", sql)
    view = f"events_{uuid.uuid4().hex}"
    try:
        if not is_query(spark, sql):
            return _error(spark, "Only queries can be run, not commands or changes")
        df.createGlobalTempView(view)
        child = session_apart(spark, spark_sql_runSQLOnFiles="false")
        register_time_bucket(child, df.schema["timestamp"].dataType.simpleString())
        result = child.sql(
            f"WITH events AS (SELECT * FROM global_temp.{view}) SELECT * FROM (\n{sql}\n)")
        refused = Gate(spark, view).objections(result._jdf.queryExecution().analyzed())
        if refused:
            return _error(spark, refused[0])
        return result if max_rows is None else result.limit(max_rows)
    except PySparkException as error:
        return _error(spark, str(error))
    finally:
        spark.catalog.dropGlobalTempView(view)


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[list[bool]]:
    """Cancels the jobs started inside once ``seconds`` have passed; what is given tells whether
    it did. Jobs of other threads go on."""
    sc, tag, late, done = spark.sparkContext, f"limit-{uuid.uuid4().hex}", [], threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.append(True)
        while not done.wait(0.2):  # also jobs that only start then
            sc.cancelJobsWithTag(tag)

    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    threading.Thread(target=watch, daemon=True).start()
    try:
        yield late
    finally:
        done.set()
        sc.setInterruptOnCancel(False)
        sc.removeJobTag(tag)


def run_ad_hoc(spark: SparkSession, sql: str, df: DataFrame, max_rows: int = MAX_ROWS,
               seconds: float = SECONDS) -> DataFrame:
    """``ad_hoc_sql``, executed: an error at run time, or taking longer than ``seconds``, gives an
    ``error`` row too. The rows, no more than ``max_rows``, come to the driver."""
    with time_limit(spark, seconds) as late:
        try:
            result = ad_hoc_sql(spark, sql, df, max_rows)
            return spark.createDataFrame(result.collect(), result.schema)
        except (PySparkException, Py4JJavaError) as error:
            return _error(spark, f"Time limit of {seconds:g} s exceeded" if late else str(error))


def _iso(name: str, zoned: bool) -> Column:
    seconds = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(name, "SSSSSS")
    text = F.when(micros == "000000", seconds).otherwise(F.concat_ws(".", seconds, micros))
    return F.concat(text, F.date_format(name, "xxx")) if zoned else text


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls included, timestamps in ISO form."""
    fields = [
        _iso(f.name, isinstance(f.dataType, T.TimestampType)).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name)
        for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("row"))
