"""The blueprint's format: which keys there are, what they take, and what they are if left out."""

from __future__ import annotations

import json
import keyword
import re
from typing import Annotated, Any, Literal, Union

from pydantic import BaseModel, ConfigDict, Field, create_model

from ..quality.contracts import DataframeContract, Expectation

# Names, defaults and allowed values are those that blueprints are written in.
#   key: type [>= least] [= default]    a key without a default is required
#   type?                               may be null, and is if left out
#   "a"|"b"                             one of these texts
#   text/number                         either
#   [type], [type]+                     a list, a list of one at least
#   {type}                              a mapping from names
#   name of a section                   that section; left out, one of its defaults
#   section < other                     has the other's keys too
FORMAT = """
blueprint
  apiVersion: text = "weirflow/v1"
  kind: "Pipeline" = "Pipeline"
  metadata: {any} = {}
  settings: settings
  parameters: {parameter} = {}
  partition: partition?
  defaults: defaults
  templates: {{any}} = {}
  orchestration: orchestration
  vars: {any} = {}
  resources: {resource} = {}
  schemas: {contract} = {}
  tasks: {extract|transform|load}

settings
  timezone: text = "UTC"
  engine: "spark"|"pandas" = "spark"

parameter
  type: "string"|"integer"|"float"|"boolean"|"date"|"datetime" = "string"
  required: flag = false
  default: any = null
  allowed: [any]?
  description: text?

partition
  field: text
  granularity: "hour"|"day"|"week"|"month" = "day"
  bounds: bounds
  backfill: backfill

bounds
  start: text?
  end: text?
  lookback: text?

backfill
  enabled: flag = false
  max_partitions: integer >= 1 = 365

resource
  name: text?
  adapter: text
  params: {any} = {}
  allow: ["read"|"write"] = ["read", "write"]

orchestration
  max_parallelism: integer >= 1 = 1
  fail_fast: flag = true
  checkpoint: checkpoint
  watermark_store: watermark_store?
  notifications: notifications
  sla: sla

checkpoint
  enabled: flag = false
  store: text?
  reuse: flag = true

watermark_store
  resource: text
  table: text = "weirflow_watermarks"

notifications
  on_failure: [channel] = []
  on_sla: [channel] = []

channel
  type: text = "log"
  target: text?

sla
  max_runtime: text?
  warn_after: text?

retry
  attempts: integer >= 1 = 1
  delay: text/number = 0.0
  backoff: number >= 1 = 1.0
  timeout: text/number?

defaults
  retry: retry?
  on_failure: "fail"|"skip"|"continue"|"fallback" = "fail"
  checkpoint: flag = true
  validate: "off"|"warn"|"strict" = "strict"

task < defaults
  name: text?
  depends_on: [text] = []

extract < task
  stage: "extract"
  resource: text
  incremental: incremental?
  steps: [extract_step]+

incremental
  strategy: "full"|"watermark"|"cdc" = "full"
  cursor: text?
  lookback: text?
  initial: any = null

extract_step
  collection: text?
  output: text
  contract: text?

transform < task
  stage: "transform"
  input: text?
  output: text
  input_contract: text?
  output_contract: text?
  expectations: [expectation] = []
  steps: [transform_step]+

transform_step
  id: text?
  description: text?
  action: text
  with: any = {}
  on_error: "fail"|"skip"|"quarantine" = "fail"

load < task
  stage: "load"
  resource: text
  steps: [load_step]+

load_step
  input: text
  collection: text?
  mode: "replace"|"append"|"upsert"|"scd2"|"delete" = "replace"
  key: text/[text]?
  input_contract: text?
  write: write
  scd: scd?

write
  partition_by: [text] = []
  chunksize: integer? >= 1 = 10000

scd
  track: [text]+
  effective_from: text = "valid_from"
  effective_to: text = "valid_to"
  current_flag: text = "is_current"
"""
# End of the fixed values.

_PLAIN: dict[str, Any] = {"text": str, "integer": int, "number": float, "flag": bool, "any": Any, "contract": DataframeContract, "expectation": Expectation}
_KEY = re.compile(r"  (?P<name>\w+): (?P<kind>.*?)(?: >= (?P<least>\d+))?(?: = (?P<default>.*))?")


class Section(BaseModel):
    """A part of a blueprint: unknown keys are errors. Keys that are words of the language, or of
    this class, are attributes with an underscore behind them."""

    model_config = ConfigDict(extra="forbid", populate_by_name=True)


class _Reader:
    """Makes a class of each section, those that it names first."""

    def __init__(self, text: str):
        self.lines: dict[str, tuple[str, list[str]]] = {}
        for block in text.strip().split("\n\n"):
            head, *keys = block.split("\n")
            name, _, parent = head.partition(" < ")
            self.lines[name] = parent, keys
        self.made: dict[str, type[Section]] = {}

    def section(self, name: str) -> type[Section]:
        if name not in self.made:
            parent, keys = self.lines[name]
            title = "".join(part.capitalize() for part in name.split("_"))
            base = self.section(parent) if parent else Section
            self.made[name] = create_model(title, __base__=base, __module__=__name__, **dict(map(self.key, keys)))
        return self.made[name]

    def kind(self, text: str) -> Any:
        if text.endswith("?"):
            return self.kind(text[:-1]) | None
        if text[0] == "[":
            return Annotated[list[self.kind(text[1:-2])], Field(min_length=1)] if text[-1] == "+" else list[self.kind(text[1:-1])]
        if text[0] == "{":
            return dict[str, self.kind(text[1:-1])]
        if "/" in text:
            return Union[tuple(map(self.kind, text.split("/")))]  # noqa: UP007
        if text[0] == '"':
            return Literal[tuple(map(json.loads, text.split("|")))]
        if "|" in text:  # sections that their stage tells apart
            return Annotated[Union[tuple(map(self.kind, text.split("|")))], Field(discriminator="stage")]  # noqa: UP007
        return _PLAIN.get(text) or self.section(text)

    def key(self, line: str) -> tuple[str, tuple[Any, Any]]:
        found = _KEY.fullmatch(line)
        name, text = found["name"], found["kind"]
        more: dict[str, Any] = {"ge": int(found["least"])} if found["least"] else {}
        if keyword.iskeyword(name) or hasattr(BaseModel, name):
            more["alias"], name = name, f"{name}_"
        kind = self.kind(text)
        if found["default"] is not None:
            return name, (kind, Field(default_factory=lambda: json.loads(found["default"]), **more))
        if text.endswith("?"):
            return name, (kind, Field(default=None, **more))
        if isinstance(kind, type) and issubclass(kind, Section) and text not in _PLAIN:
            return name, (kind, Field(default_factory=kind, **more))
        return name, (kind, Field(**more))


SECTIONS = _Reader(FORMAT)
Document = SECTIONS.section("blueprint")
"""The blueprint's whole document, after imports, templates and tokens."""
Resource = SECTIONS.section("resource")
Retry = SECTIONS.section("retry")
Scd = SECTIONS.section("scd")
