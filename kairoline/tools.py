"""Tools for agents: named functions with a JSON schema of their arguments, and an editor's commands as such tools.

``Registry`` holds and calls them; ``judge`` checks a whole table of calls in JSON at once.
"""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.timeline import EditError

# Words that the names of a host's tools begin with, and the tiers of what they may touch.
NAMESPACES = ("app", "project", "system", "media", "analysis", "python", "job")
TIERS = ("read_only", "workspace", "system")
_NAME = re.compile(rf"({'|'.join(NAMESPACES)})_[a-z0-9_]+")
_KINDS = {"int": "integer", "float": "number", "str": "string", "bool": "boolean", "list": "array", "dict": "object", "tuple": "array"}
_ACCEPTED = {"integer": (int,), "number": (int, float), "string": (str,), "boolean": (bool,), "array": (list, tuple), "object": (dict,)}


class ToolError(ValueError):
    """A call that is refused, with the reason."""


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    call: Callable
    tier: str = "workspace"
    parameters: dict = field(default_factory=lambda: {"type": "object", "properties": {}, "required": []})


def schema_of(function: Callable) -> dict:
    """JSON schema of a function's arguments, from its signature: those without a default are required."""
    properties, required, more = {}, [], False
    for name, p in inspect.signature(function).parameters.items():
        if name == "self":
            continue
        if p.kind is p.VAR_KEYWORD:
            more = True
            continue
        kind = str(p.annotation).split("[")[0].split(" |")[0]
        properties[name] = {"type": _KINDS[kind]} if kind in _KINDS else {}
        if p.default is p.empty:
            required.append(name)
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": more}


def problem(parameters: dict, arguments) -> str | None:
    """Why arguments don't fit a schema of this form; None if they do."""
    if not isinstance(arguments, dict):
        return "arguments must be an object"
    for name in parameters.get("required", ()):
        if name not in arguments:
            return f"missing argument: {name}"
    for name, value in arguments.items():
        own = parameters["properties"].get(name)
        if own is None:
            if not parameters.get("additionalProperties", True):
                return f"unknown argument: {name}"
            continue
        wanted = own.get("type")
        if wanted and value is not None and (not isinstance(value, _ACCEPTED[wanted]) or isinstance(value, bool) != (wanted == "boolean")):
            return f"{name} must be of type {wanted}"
    return None


class Registry:
    def __init__(self, confirm: Callable[[str, dict], bool] | None = None):
        """confirm: asked before tools of the tier ``system`` run; without it they don't."""
        self.tools: dict[str, Tool] = {}
        self.confirm = confirm

    def add(self, tool: Tool) -> None:
        """A host's tool, under a name that begins with a known word."""
        if not _NAME.fullmatch(tool.name):
            raise ToolError(f"not a name for a tool: {tool.name}")
        if tool.tier not in TIERS:
            raise ToolError(f"unknown tier: {tool.tier}")
        self._put(tool)

    def add_edits(self, project) -> None:
        """A project's commands under their own names."""
        for name in project.COMMANDS:
            method = getattr(project, name)
            self._put(Tool(name, inspect.getdoc(method) or name.replace("_", " "), method, "workspace", schema_of(method)))

    def _put(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ToolError(f"there is such a tool: {tool.name}")
        self.tools[tool.name] = tool

    def call(self, name: str, arguments: str | dict):
        tool = self.tools.get(name)
        if tool is None:
            raise ToolError(f"unknown tool: {name}")
        try:
            given = json.loads(arguments) if isinstance(arguments, str) else arguments
        except json.JSONDecodeError as bad:
            raise ToolError(f"broken JSON: {bad}") from bad
        if wrong := problem(tool.parameters, given):
            raise ToolError(wrong)
        if tool.tier == "system" and not (self.confirm and self.confirm(name, given)):
            raise ToolError(f"{name} needs to be confirmed")
        try:
            return tool.call(**given)
        except EditError as bad:
            raise ToolError(f"rejected: {bad}") from bad

    def table(self, spark: SparkSession) -> DataFrame:
        """name, tier, description, and parameters as JSON."""
        return spark.createDataFrame([(t.name, t.tier, t.description, json.dumps(t.parameters)) for t in self.tools.values()], "name string, tier string, description string, parameters string")


def judge(calls: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """calls (with tool, and args in JSON) with the reason why one is refused, null if none. required: the arguments that
    each tool can't do without."""
    given = F.from_json("args", "map<string,string>")
    missing = F.lit(None).cast("string")
    for tool, names in required.items():
        for name in reversed(names):
            missing = F.when((F.col("tool") == tool) & ~F.coalesce(F.map_contains_key(given, name), F.lit(False)), f"missing argument: {name}").otherwise(missing)
    broken = given.isNull() | ~F.coalesce(F.startswith(F.ltrim("args"), F.lit("{")), F.lit(False))
    reason = F.when(~F.coalesce(F.col("tool").isin(*required), F.lit(False)), "unknown tool").when(broken, "arguments must be an object").otherwise(missing)
    return calls.withColumn("reason", reason)
