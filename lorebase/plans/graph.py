"""Prompt graphs: a definition of nodes and edges run over a table of states.

Every row is one conversation's state. A node is a stage of the job: it renders its
prompt from state columns, asks the model port for all rows at once and merges the
structured answer back into the state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.answers import standard_schema, state_type, structured
from lorebase.functions.text import render

START, END = "START", "END"


@dataclass(frozen=True)
class Node:
    name: str
    input_variables: tuple[str, ...] = ()
    prompt: str = ""
    output: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    target: str


def prompt_value(column: Column, kind: T.DataType) -> Column:
    """A state value as prompt text: lists one item per line, null as nothing."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(column, lambda x: F.coalesce(x.cast("string"), F.lit("None")) if not isinstance(kind.elementType, (T.StructType, T.MapType)) else F.to_json(x))
        return F.coalesce(F.array_join(items, "\n"), F.lit(""))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.to_json(column), F.lit(""))
    return F.coalesce(column.cast("string"), F.lit(""))


class PromptGraph:
    """Compile once, run over any number of states."""

    def __init__(self, nodes: list[Node], edges: list[Edge], state: dict | None, start: str = START, end: str = END) -> None:
        self.nodes = {n.name: n for n in nodes}
        self.edges, self.state, self.start, self.end = edges, state, start, end
        self._plan: list[Callable[[DataFrame], DataFrame]] | None = None

    @classmethod
    def from_definition(cls, definition: dict) -> PromptGraph:
        nodes = [
            Node(n["name"], tuple(n.get("input_variables", ())), n.get("prompt", ""), n.get("output") or {})
            for n in definition.get("nodes", ())
        ]
        edges = [Edge(e.get("from", START), e.get("to", END)) for e in definition.get("edges", ())]
        return cls(nodes, edges, definition.get("state"), definition.get("start", START), definition.get("end", END))

    def order(self) -> list[str]:
        """Nodes reachable from the start, each after all of its reachable predecessors."""
        following: dict[str, list[str]] = {}
        for edge in self.edges:
            for end in (edge.source, edge.target):
                if end not in self.nodes and end not in (START, END):
                    raise ValueError(f"unknown node: {end}")
            following.setdefault(edge.source, []).append(edge.target)
        done: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str) -> None:
            if state.get(name) == 1:
                raise ValueError(f"cycle through node: {name}")
            if state.get(name) == 2 or name == END:
                return
            state[name] = 1
            for target in reversed(following.get(name, [])):
                visit(target)
            state[name] = 2
            if name != START:
                done.append(name)

        visit(START)
        return done[::-1]

    def state_fields(self) -> T.StructType:
        return state_type(self.state or {})

    def compile(self, model, special: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> PromptGraph:
        """``model`` maps a prompt column to an answer column; ``special`` nodes map states to states."""
        if not self.state:
            raise ValueError("a graph needs a state schema")
        special = special or {}
        self._plan = [special[n] if n in special else self._stage(self.nodes[n], model) for n in self.order()]
        return self

    def _stage(self, node: Node, model) -> Callable[[DataFrame], DataFrame]:
        schema = standard_schema(node.output) if node.output else None

        def stage(states: DataFrame) -> DataFrame:
            kinds = {f.name: f.dataType for f in states.schema.fields}
            values = {
                v: prompt_value(F.col(v), kinds[v]) if v in kinds else F.lit("") for v in node.input_variables
            }
            if schema:
                values["format_instructions"] = F.lit(format_instructions(schema))
            raw = states.withColumn("_raw", model(render(node.prompt, **values)))
            if not schema:
                return raw.withColumn("result", F.col("_raw")).drop("_raw")
            fields = state_type(schema)
            record = F.from_json(structured(schema)(F.col("_raw")), fields)
            checked = raw.withColumn("_record", record).withColumn(
                "_record",
                F.when(F.col("_record").isNotNull() | F.col("_raw").isNull(), F.col("_record"))
                .otherwise(F.raise_error(F.lit(f"node {node.name}: no structured answer"))),
            )
            merged = {f.name: F.col(f"_record.{f.name}") for f in fields}
            return checked.withColumns(merged).drop("_raw", "_record")

        return stage

    def initial(self, states: DataFrame) -> DataFrame:
        """Adds the state fields that the input lacks: empty lists, other fields null."""
        missing = {}
        for f in self.state_fields():
            if f.name not in states.columns:
                empty = F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)
                missing[f.name] = empty
        return states.withColumns(missing) if missing else states

    def run(self, states: DataFrame) -> DataFrame:
        if self._plan is None:
            raise RuntimeError("graph not compiled: call compile() first")
        for stage in self._plan:
            states = stage(states) if states is not None else states
        return states

    def updates(self, states: DataFrame):
        """The states after every node, in order, for callers that show progress."""
        if self._plan is None:
            raise RuntimeError("graph not compiled: call compile() first")
        for name, stage in zip(self.order(), self._plan):
            states = stage(states)
            yield name, states


def format_instructions(schema: dict) -> str:
    import json

    return "Answer with a JSON object that conforms to this JSON Schema:\n" + json.dumps(
        {"properties": schema.get("properties", {}), "required": schema.get("required", [])}
    )
