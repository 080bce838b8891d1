"""Decide whether a candidate's text may run at all.

Candidate text is untrusted. A text may only read the tables it was given: statements
that change something, other tables, files named in place of a table, shell scripts and
calls into the JVM are refused before anything runs.
"""

from __future__ import annotations

import json
import re
from contextlib import contextmanager
from typing import Iterable

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

REJECTED = "rejected"
PARSE_ERROR = "parse_error"

# The nodes of a parsed read-only query.
READING_NODES = frozenset(
    """
    Aggregate AsOfJoin Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect
    Join LateralJoin LateralSubquery LocalLimit LocalRelation Offset OneRowRelation PipeOperator
    Pivot Project Range Repartition RepartitionByExpression Sample Sort SubqueryAlias Union Unpivot
    UnresolvedHaving UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction
    UnresolvedWith Window WithWindowDefinition UnionLoop UnresolvedOrderBy UnresolvedTableSpec
    """.split()
)

# Functions that run JVM code, and the clause that builds names from expressions.
FORBIDDEN_FUNCTIONS = frozenset(("reflect", "java_method", "try_reflect"))
SUSPICIOUS = re.compile(r"\b(reflect|java_method|try_reflect|identifier)\b", re.IGNORECASE)

# Every subquery has one of these words; functions to look at are listed above.
QUERY_WORD = re.compile(
    r"\b(select|from|table|values|with|map|reduce|transform|"
    r"reflect|java_method|try_reflect|identifier|positional)\b",
    re.IGNORECASE,
)

# Text values without escapes, and what a plain condition does not have besides them.
SIMPLE_TEXT = re.compile(r"'[^'\\]*'")
NOT_PLAIN = re.compile(r"--|/\*|['\"`;\\]")

# Spark would read this as an alias and a cross join.
MISREAD_JOIN = re.compile(r"\bpositional\s+join\b", re.IGNORECASE)


@contextmanager
def candidate_settings(spark: SparkSession):
    """Double quotes mark names, files do not pass for tables; restored afterwards."""
    wanted = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.ansi.doubleQuotedIdentifiers": "true",
        "spark.sql.runSQLOnFiles": "false",
        "spark.sql.timeType.enabled": "true",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class TextGuard:
    """Checks texts against a fixed set of readable tables."""

    def __init__(self, spark: SparkSession, tables: Iterable[str]):
        self.spark = spark
        self.tables = frozenset(name.lower() for name in tables)

    def check(self, text: str) -> str | None:
        """NULL for a text that may run, else ``rejected`` or ``parse_error``."""
        if MISREAD_JOIN.search(text):
            return REJECTED
        session = getattr(self.spark, "_jsparkSession", None)
        if session is None:
            return REJECTED  # without Spark's parser nothing can be told
        try:
            plan = session.sessionState().sqlParser().parsePlan(text)
        except ParseException:
            return PARSE_ERROR
        search_calls = bool(SUSPICIOUS.search(text))
        return None if self._reads_only(plan, frozenset(), search_calls) else REJECTED

    def is_plain(self, predicate: str) -> bool:
        """Whether a condition that Spark can analyse in brackets needs no check of its own.

        It has no word of a query, and no comment or bracket could end the brackets around it.
        """
        bare = SIMPLE_TEXT.sub("", predicate)
        if QUERY_WORD.search(predicate) or NOT_PLAIN.search(bare):
            return False
        depth = 0
        for mark in re.findall(r"[()]", bare):
            depth += 1 if mark == "(" else -1
            if depth < 0:
                return False
        return depth == 0

    def check_predicate(self, predicate: str) -> str | None:
        """The same for a condition; it has to parse alone first."""
        session = getattr(self.spark, "_jsparkSession", None)
        if session is not None:
            try:
                session.sessionState().sqlParser().parseExpression(predicate)
            except ParseException:
                return PARSE_ERROR
            if not QUERY_WORD.search(predicate):
                return None
        return TextGuard(self.spark, self.tables | {"condition_probe"}).check(
            f"select 1 from condition_probe where (\n{predicate}\n)"
        )

    def filtered(self, text: str) -> tuple[str, object | None] | None:
        """Table and condition (None for all rows) of ``select * from table where condition``; None for any other text.

        One select and one from leave no room for a subquery, so such a text reads nothing but its table. The condition
        is Spark's own parsed expression.
        """
        session = getattr(self.spark, "_jsparkSession", None)
        words = [word.lower() for word in QUERY_WORD.findall(text)]
        if session is None or words != ["select", "from"] or MISREAD_JOIN.search(text):
            return None
        try:
            plan = session.sessionState().sqlParser().parsePlan(text)
        except ParseException:
            return None
        nodes = json.loads(plan.toJSON())
        kinds = [node["class"].rsplit(".", 1)[-1] for node in nodes]
        if kinds not in (["Project", "Filter", "UnresolvedRelation"], ["Project", "UnresolvedRelation"]):
            return None
        stars = nodes[0]["projectList"]
        if len(stars) != 1 or not stars[0][0]["class"].endswith(".UnresolvedStar") or len(stars[0][0]) > 2:
            return None
        name = nodes[-1]["multipartIdentifier"][1:-1].lower()
        if name not in self.tables:
            return None
        return name, plan.child().condition() if len(kinds) == 3 else None

    def _reads_only(self, node, known: frozenset, search_calls: bool) -> bool:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in READING_NODES:
            return False
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            name = parts[0].lower()
            return len(parts) == 1 and (name in known or name in self.tables)
        if kind == "UnresolvedWith":
            for relation in _items(node.cteRelations()):
                name, body = relation._1().lower(), relation._2()
                inside = known | {name} if node.allowRecursion() else known
                if not self._reads_only(body, inside, search_calls):
                    return False
                known = known | {name}
            return self._reads_only(node.child(), known, search_calls)
        if search_calls and not all(_calls_allowed(e) for e in _items(node.expressions())):
            return False
        below = _items(node.children()) + _items(node.innerChildren())
        return all(self._reads_only(child, known, search_calls) for child in below)


def _items(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _calls_allowed(expression) -> bool:
    kind = expression.getClass().getSimpleName()
    if kind.endswith("WithUnresolvedIdentifier"):
        return False
    if kind == "UnresolvedFunction":
        name = _items(expression.nameParts())[-1].lower()
        if name in FORBIDDEN_FUNCTIONS:
            return False
    return all(_calls_allowed(child) for child in _items(expression.children()))
