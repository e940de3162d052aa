"""Read-only SQL over registered tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Words that mark a statement as writing.
WRITE_WORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "REPLACE", "ATTACH", "DETACH",
)
_WRITES = re.compile(r"\b(?:" + "|".join(WRITE_WORDS) + r")\b", re.IGNORECASE)

_CATALYST = "org.apache.spark.sql.catalyst."
#: What a query may be made of, by the names of Spark's plan nodes. A node that is not here, known today or not, is refused.
_NODES = set(
    "Aggregate AsOfJoin CTERelationDef CTERelationRef Distinct Except Expand Filter Generate GlobalLimit HintInfo Intersect Join JoinHint LateralJoin LocalLimit "
    "LocalRelation NoneHint Offset OneRowRelation PipeOperator Pivot Project Range Sample Sort SubqueryAlias Tail Union UnionLoop Unpivot UnresolvedHint "
    "UnresolvedWith Window WithWindowDefinition WithCTE Transpose UnresolvedTranspose".split()
)
#: Names that the parser leaves open in a query.
_OPEN_NAMES = set(
    "MultiAlias UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedHaving UnresolvedInlineTable "
    "UnresolvedOrdinal UnresolvedRegex UnresolvedRelation UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedStarWithColumns "
    "UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction".split()
)
#: Functions and expressions that reach beyond the tables, by the class behind every name they have: calls into Java, files named by path, logs.
_BEYOND = re.compile(r"Reflect|Invoke|Protobuf|Avro|Python|ScalaUDF|Hive")


def _elements(value: JavaObject, name: str) -> Iterator:
    """What a node, an option, a tuple, a list or a map of the plan holds."""
    items = value.iterator() if name.startswith("scala.collection.") else value.productIterator()
    while items.hasNext():
        yield items.next()


def _parts(value: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """(class name, object) of everything a parsed plan is made of: nodes, expressions, subqueries, named queries and windows."""
    waiting = [value]
    while waiting:
        value = waiting.pop()
        if not isinstance(value, JavaObject):
            continue  # a name, number or flag
        name = value.getClass().getName()
        if name.startswith(("scala.None", "java.", "org.apache.spark.unsafe.", "org.apache.spark.sql.types.", "org.apache.spark.sql.util.")):
            continue
        if not name.startswith("scala."):
            yield name, value
        try:
            waiting.extend(_elements(value, name))
        except Py4JError:
            continue  # no product: identifiers and modes


@lru_cache(maxsize=4096)
def _behind(spark: SparkSession, registry: str, name: str) -> str | None:
    """The class behind a function that comes with Spark; None for any other name."""
    analysis = spark._jvm.org.apache.spark.sql.catalyst
    found = getattr(analysis.analysis, registry).builtin().lookupFunction(analysis.FunctionIdentifier(name))
    return found.get().getClassName() if found.isDefined() else None


def _check_function(spark: SparkSession, parts: list[str], registry: str = "FunctionRegistry") -> None:
    name = ".".join(parts)
    if len(parts) != 1 or (kind := _behind(spark, registry, parts[0].lower())) is None and registry == "TableFunctionRegistry":
        raise PermissionError(f"only functions that come with Spark are run here, by their plain names, not {name!r}")
    if kind is None or _BEYOND.search(kind.rsplit(".", 1)[-1]):
        raise PermissionError(f"queries may not use {name!r} here")


def _check_relation(spark: SparkSession, parts: list[str], relation: JavaObject) -> None:
    """A name of several parts must be a table of the catalog: otherwise Spark takes the first for a format and the last for a path."""
    if relation.isStreaming() or not relation.options().isEmpty():
        raise PermissionError(f"queries may not read {'.'.join(parts)!r} as a stream or with options here")
    try:
        known = len(parts) == 1 or spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts))
    except AnalysisException:
        known = False  # more parts than the catalog has levels
    if not known:
        raise PermissionError(f"{'.'.join(parts)!r} is no registered table; files may not be read by path here")


def _names(value: JavaObject) -> list[str]:
    return list(_elements(value, value.getClass().getName()))


def check_read_only(spark: SparkSession, text: str) -> None:
    """Raise ``PermissionError`` unless the statement is a query that stays within the registered tables.

    Any whole write word is refused, also inside a literal or as the function ``replace(...)``: this part prefers refusing too
    much. The rest is judged on the plan that Spark's own parser makes of the statement, before anything of it is analysed or
    run, so that quotes, comments and spellings mean here what they mean to Spark: every node must be one of a query (which leaves out
    commands, scripts, procedures and names made from text), every function must come with Spark and stay within the data, and
    every table must be registered. Subqueries, named queries and window definitions are judged alike.
    """
    if _WRITES.search(text):
        raise PermissionError("this statement may write; only queries are run here")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    for name, part in _parts(plan):
        kind = name.rsplit(".", 1)[-1].rstrip("$")
        if name.startswith(_CATALYST + "analysis."):
            allowed = kind in _OPEN_NAMES
        elif name.startswith((_CATALYST + "expressions.", _CATALYST + "trees.")):
            allowed = not _BEYOND.search(kind)
        elif name.startswith(_CATALYST + "plans.logical."):
            allowed = kind in _NODES
        else:
            allowed = name.startswith(_CATALYST)  # join kinds, identifiers, rows of a literal table
        if not allowed:
            raise PermissionError(f"only queries are run here; this is or holds {kind}")
        if kind == "UnresolvedRelation":
            _check_relation(spark, _names(part.multipartIdentifier()), part)
        elif kind == "UnresolvedFunction":
            _check_function(spark, _names(part.nameParts()))
        elif kind == "UnresolvedGenerator":
            _check_function(spark, [part.name().funcName()])
        elif kind == "UnresolvedTableValuedFunction":
            _check_function(spark, _names(part.name()), "TableFunctionRegistry")


def sql_query(spark: SparkSession, text: str) -> DataFrame:
    """Run a query (see ``check_read_only``). Errors in the SQL itself surface as Spark's ``ParseException`` or ``AnalysisException``."""
    text = text.strip().rstrip(";")
    check_read_only(spark, text)
    return spark.sql(text)
