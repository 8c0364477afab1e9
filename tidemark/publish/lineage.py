"""OPS-02: lineage read from the plans themselves.

Every frame that a mart may read is tagged with its name (an alias, which
changes nothing else). Spark's analysed plan of the mart then says which tagged
frames it reads and, expression by expression, from which of their columns each
output column is computed; nothing runs and no file is opened. Columns that
only decide which rows there are (filters, join and grouping keys) are listed
under the column name ``*``.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_TAG = "lineage__"
_NO_RIGHT = ("LeftSemi", "LeftAnti")
#: Fields of a node whose columns decide about rows.
_ROW_FIELDS = {"Filter": ("condition",), "Join": ("condition",), "Aggregate": ("groupingExpressions",),
               "Deduplicate": ("keys",)}
ROWS = "*"


def tagged(name: str, df: DataFrame) -> DataFrame:
    return df.alias(f"{_TAG}{name}")


@dataclass
class Lineage:
    """What a frame is made from: names of tagged frames, and per output column
    (and ``*``) the pairs (tagged frame, column)."""
    sources: set[str] = field(default_factory=set)
    columns: dict[str, set[tuple[str, str]]] = field(default_factory=dict)

    def through(self, inner: Mapping[str, "Lineage"]) -> "Lineage":
        """The same with the frames of ``inner`` replaced by what those are made from."""
        sources = {s for name in self.sources for s in (inner[name].sources if name in inner else {name})}
        rows = {pair for name in self.sources & set(inner) for pair in inner[name].columns[ROWS]}
        columns = {col: {p for name, x in pairs for p in (inner[name].columns[x] if name in inner else {(name, x)})}
                   for col, pairs in self.columns.items()}
        columns[ROWS] |= rows
        return Lineage(sources, columns)


def read(df: DataFrame) -> Lineage:
    """The lineage of a frame down to its tagged frames."""
    walk = _Walk()
    outputs = walk.plan(json.loads(df._jdf.queryExecution().analyzed().toJSON()))
    columns: dict[str, set] = {ROWS: set(walk.rows)}
    for number, name in outputs:
        columns.setdefault(name, set()).update(walk.origin[number])
    return Lineage(walk.sources, columns)


def _kind(node: dict) -> str:
    return node["class"].rsplit(".", 1)[1]


def _expressions(value) -> Iterator[list[dict]]:
    """Expressions of a field of a node, each as its list of parts in prefix order."""
    if isinstance(value, list) and value:
        if isinstance(value[0], dict) and "class" in value[0]:
            yield value
        elif isinstance(value[0], list):
            for v in value:
                yield from _expressions(v)


class _Walk:
    def __init__(self):
        self.origin: dict[str, set[tuple[str, str]]] = defaultdict(set)  # expression id -> (frame, column)
        self.rows: set[tuple[str, str]] = set()
        self.sources: set[str] = set()

    def plan(self, nodes: list[dict]) -> list[tuple[str, str]]:
        """Output (id, name) of a plan given as its nodes in prefix order."""
        rest = iter(nodes)
        return self._node(rest)

    def _node(self, rest: Iterator[dict]) -> list[tuple[str, str]]:
        node = next(rest)
        kind = _kind(node)
        tag = str(node["identifier"].get("name", "")) if kind == "SubqueryAlias" else ""
        if tag.startswith(_TAG):  # what lies below a tag is its own lineage
            above = self.sources, self.rows
            self.sources, self.rows = set(), set()
            outputs = self._node(rest)
            self.sources, self.rows = above
            source = tag[len(_TAG):]
            self.sources.add(source)
            for number, name in outputs:
                self.origin[number] = {(source, name)}
            return outputs
        children = [self._node(rest) for _ in range(int(node["num-children"]))]
        made = {f: [self._expression(e) for e in _expressions(v)] for f, v in node.items()}
        for f in _ROW_FIELDS.get(kind, ()):
            self.rows.update(*[refs for _, refs in made.get(f, [])], set())
        named = {f: [out for out, _ in es if out] for f, es in made.items()}
        if kind == "Project":
            return named["projectList"]
        if kind == "Aggregate":
            return named["aggregateExpressions"]
        if kind == "Join":
            one_sided = any(k in str(node["joinType"]) for k in _NO_RIGHT)
            return children[0] if one_sided else [x for child in children for x in child]
        if kind == "Union":
            for same in zip(*children):
                self.origin[same[0][0]] = set().union(*(self.origin[number] for number, _ in same))
            return children[0]
        if kind == "Generate":
            for number, _ in named["generatorOutput"]:
                self.origin[number] = set().union(*(refs for _, refs in made["generator"]))
            return [x for child in children for x in child] + named["generatorOutput"]
        if children and "output" in named:  # computed elsewhere from all that comes in
            everything = set().union(*(self.origin[number] for child in children for number, _ in child))
            for number, _ in named["output"]:
                self.origin[number] = everything
            return named["output"]
        own = {number for child in children for number, _ in child}
        return [x for child in children for x in child] + [
            x for xs in named.values() for x in xs if x[0] not in own]

    def _expression(self, parts: list[dict]) -> tuple[tuple[str, str] | None, set[tuple[str, str]]]:
        """((id, name) of an expression that has them, columns it is made from)."""
        def span(at: int) -> tuple[set, int]:
            part, refs, end = parts[at], set(), at + 1
            if isinstance(part.get("plan"), list):  # a subquery
                for number, _ in self.plan(part["plan"]):
                    refs |= self.origin[number]
            for _ in range(int(part["num-children"])):
                inner, end = span(end)
                refs |= inner
            if "exprId" in part and "name" in part:
                if _kind(part) == "AttributeReference":
                    refs |= self.origin[part["exprId"]["id"]]
                else:
                    self.origin[part["exprId"]["id"]] = refs
            return refs, end

        refs, _ = span(0)
        top = parts[0]
        out = (top["exprId"]["id"], top["name"]) if "exprId" in top and "name" in top else None
        return out, refs


def column_rows(spark: SparkSession, found: Mapping[str, Lineage]) -> DataFrame:
    """(mart, column_name, source, source_column), a row per pair; a few per
    column of the marts. ``*`` stands for the rows as such."""
    rows = sorted({(mart, col, *pair) for mart, own in found.items() for col, pairs in own.columns.items() for pair in pairs})
    return spark.createDataFrame(rows, "mart string, column_name string, source string, source_column string")


def differences(found: Mapping[str, Lineage], declared: Mapping[str, list[str]]) -> list[str]:
    """Where declared dependencies and those of the plans differ."""
    out = []
    for mart, own in found.items():
        reads, says = own.sources, set(declared.get(mart, ()))
        out += [f"{mart} reads {s}, undeclared" for s in sorted(reads - says)]
        out += [f"{mart} declares {s}, unread" for s in sorted(says - reads)]
    return out
