"""Statements: splitting a script, and telling reading ones from others by their parsed plan."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_TOKEN = re.compile(
    r"""
    (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`)
  | (?P<line>--[^\n]*)
  | (?P<block>/\*)
  | (?P<dollar>\$(?:[A-Za-z_]\w*)?\$)
  | (?P<end>;)
  | (?P<hash>\#[^\n]*)
    """,
    re.X | re.S,
)
_COMMENT_ENDS = re.compile(r"/\*|\*/")

#: Nodes of plans that only read. A plan with any other node is refused.
READING = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "CollectMetrics", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit",
    "GroupingSets", "InlineTable", "Intersect", "Join", "LateralJoin", "Limit", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Range",
    "RebalancePartitions", "Repartition", "RepartitionByExpression", "ResolvedInlineTable", "Sample", "Sort", "Subquery", "SubqueryAlias", "Tail", "Transpose", "Union", "UnresolvedCTERelationPlans",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedIdentifier", "UnresolvedOrderBy", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction",
    "UnresolvedWith", "Unpivot", "UnpivotTransformer", "Values", "View", "Window", "WithCTE", "WithWindowDefinition", "UnresolvedTVFAliases", "AsOfJoin", "UnresolvedTable", "UnresolvedTableOrView", "UnresolvedNamespace", "CurrentNamespace",
    "DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "DescribeFunction", "DescribeNamespace", "DescribeFunctionCommand", "ExplainCommand", "ShowColumns", "ShowCreateTable", "ShowCurrentNamespace", "ShowFunctions", "ShowNamespaces",
    "ShowPartitions", "ShowTableProperties", "ShowTables", "ShowTableExtended", "ShowTablesExtended", "ShowViews", "ShowCatalogsCommand", "ShowCurrentNamespaceCommand", "UnresolvedFunctionName", "PipeOperator", "UnresolvedPartitionSpec",
}
#: Functions that call code of the JVM's choosing.
FORBIDDEN_FUNCTIONS = re.compile(r"\b(java_method|reflect|try_reflect)\b", re.I)


def split_statements(script: str, *, hash_comments: bool = False) -> list[str]:
    """The statements of a script without their semicolons; those in quotes and comments do not count."""
    out, start, at = [], 0, 0
    while m := _TOKEN.search(script, at):
        at = m.end()
        if m["block"]:
            depth = 1
            while depth and (c := _COMMENT_ENDS.search(script, at)):
                depth += 1 if c[0] == "/*" else -1
                at = c.end()
            if depth:
                break
        elif m["dollar"]:
            end = script.find(m["dollar"], at)
            if end < 0:
                break
            at = end + len(m["dollar"])
        elif m["hash"] and not hash_comments:
            at = m.start() + 1
        elif m["end"]:
            out.append(script[start : m.start()].strip())
            start = at
    out.append(script[start:].strip())
    return [s for s in out if strip_comments(s, hash_comments=hash_comments).strip()]


def strip_comments(text: str, *, hash_comments: bool = False) -> str:
    """text with comments (also nested ones) outside of quotes as blanks."""
    out, at = [], 0
    while m := _TOKEN.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m["line"] or (m["hash"] and hash_comments):
            out.append(" ")
        elif m["block"]:
            depth = 1
            while depth and (c := _COMMENT_ENDS.search(text, at)):
                depth += 1 if c[0] == "/*" else -1
                at = c.end()
            if depth:
                at = len(text)
            out.append(" ")
        else:
            out.append(m[0])
    return "".join(out) + text[at:]


def _nodes(plan):
    """All nodes of a plan, those in subqueries of expressions too."""
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))
    inner = plan.innerChildren()
    for i in range(inner.size()):
        if hasattr(inner.apply(i), "children") and "plans.logical" in inner.apply(i).getClass().getName():
            yield from _nodes(inner.apply(i))
    queries = plan.subqueries()
    for i in range(queries.size()):
        yield from _nodes(queries.apply(i))


def refused(spark: SparkSession, sql: str) -> str | None:
    """None if the statement only reads; else why it is refused. Parsing runs nothing."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    bare = strip_comments(sql).strip().rstrip(";")
    if FORBIDDEN_FUNCTIONS.search(bare):
        return "function calls into the JVM are not allowed"
    try:
        plan = parser.parsePlan(bare)
    except Exception as e:
        return f"not a single statement: {str(e).splitlines()[0]}"
    for node in _nodes(plan):
        name = node.getClass().getSimpleName().rstrip("$")
        if name not in READING:
            return f"{name} does not only read"
    return None


def is_explain(sql: str) -> bool:
    return bool(re.match(r"\s*explain\b", strip_comments(sql), re.I))
