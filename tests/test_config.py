import json

import pytest
import yaml

from weirflow import load_config
from weirflow.config.loader import deep_merge
from weirflow.durations import parse_duration
from weirflow.errors import ConfigError, DependencyError, InterpolationError, RegistryError, SecretError
from weirflow.plans import dag
from weirflow.registry import Registry
from weirflow.secret_providers import EnvSecretProvider, MappingSecretProvider, RedactingFilter


def plan(**more):
    return {
        "resources": {"src": {"adapter": "file", "params": {"format": "csv", "path": "/tmp/x.csv"}}},
        "tasks": {
            "ext": {"stage": "extract", "resource": "src", "steps": [{"output": "raw"}]},
            "keep": {"stage": "transform", "input": "raw", "output": "kept", "steps": [{"action": "filter", "with": {"v": {"op": ">=", "value": 20}}}]},
        },
        **more,
    }


def test_interpolation_keeps_types(monkeypatch):
    monkeypatch.setenv("WF_HOST", "db1")
    config = load_config(plan(vars={"n": 5, "deep": {"x": [1, 2]}, "again": "${var:n}", "text": "n=${var:n}"}, metadata={"a": "${var:n}", "b": "${var:deep.x}", "c": "${env:WF_HOST}/${var:n}", "d": "${param:p}", "e": "${env:WF_NONE:-other}", "f": "${var:again}", "g": "${secret:k}", "h": "${pipe:v|max}"}), params={"p": 1.5}, secret_provider=MappingSecretProvider({"k": "s3cret"}))
    assert config.metadata == {"a": 5, "b": [1, 2], "c": "db1/5", "d": 1.5, "e": "other", "f": 5, "g": "s3cret", "h": "${pipe:v|max}"}
    assert config.vars["text"] == "n=5" and config.secrets == {"s3cret"} and config.params == {"p": 1.5}


def test_missing_references():
    for token, error in (("${var:nope}", InterpolationError), ("${env:WF_SURELY_NOT}", InterpolationError), ("${secret:nope}", SecretError), ("${param:nope}", InterpolationError)):
        with pytest.raises(error):
            load_config(plan(metadata={"a": token}), secret_provider=MappingSecretProvider({}))
    assert load_config(plan(metadata={"a": "${var:nope}"}), strict=False).metadata["a"] == "${var:nope}"
    with pytest.raises(InterpolationError, match="each other"):
        load_config(plan(vars={"a": "${var:b}", "b": "${var:a}"}))


def test_parameters():
    spec = {"n": {"type": "integer", "default": 3}, "env": {"allowed": ["dev", "prod"], "default": "dev"}, "flag": {"type": "boolean", "default": "yes"}, "day": {"type": "date"}}
    config = load_config(plan(parameters=spec), params={"n": "7", "other": [1]})
    assert config.params == {"n": 7, "env": "dev", "flag": True, "other": [1]}
    for params in ({"env": "test"}, {"n": "x"}):
        with pytest.raises(ConfigError):
            load_config(plan(parameters=spec), params=params)
    with pytest.raises(ConfigError, match="required"):
        load_config(plan(parameters={"p": {"required": True}}))


def test_imports_merge(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "base.yaml").write_text(yaml.safe_dump({"imports": ["more.json"], "metadata": {"id": "base", "owner": "x"}, "resources": plan()["resources"]}))
    (tmp_path / "sub" / "more.json").write_text(json.dumps({"metadata": {"tags": ["a"]}}))
    (tmp_path / "main.yaml").write_text(yaml.safe_dump({"imports": ["sub/base.yaml"], "metadata": {"id": "main", "tags": ["b"]}, "tasks": plan()["tasks"]}))
    config = load_config(tmp_path / "main.yaml")
    assert config.metadata == {"id": "main", "owner": "x", "tags": ["a", "b"]}
    (tmp_path / "sub" / "more.json").write_text(json.dumps({"imports": ["base.yaml"]}))
    with pytest.raises(ConfigError, match="circle"):
        load_config(tmp_path / "main.yaml")
    assert deep_merge({"a": {"x": 1}, "b": [1]}, {"a": {"y": 2}, "b": [2], "c": 3}) == {"a": {"x": 1, "y": 2}, "b": [1, 2], "c": 3}


def test_templates_and_defaults():
    doc = plan(templates={"t": {"retry": {"attempts": 3}, "stage": "extract", "resource": "src"}, "u": {"extends": "t", "on_failure": "skip"}}, defaults={"retry": {"attempts": 2}, "validate": "warn"})
    doc["tasks"]["ext"] = {"extends": "u", "steps": [{"output": "raw"}]}
    config = load_config(doc)
    assert config.tasks["ext"].retry.attempts == 3 and config.tasks["ext"].on_failure == "skip" and config.tasks["ext"].validate_ == "warn"
    assert config.tasks["keep"].retry.attempts == 2
    doc["tasks"]["ext"]["extends"] = "zzz"
    with pytest.raises(ConfigError, match="zzz"):
        load_config(doc)


def _with(**tasks):
    doc = plan()
    doc["tasks"] |= tasks
    return doc


@pytest.mark.parametrize(
    ("doc", "message"),
    [
        (_with(ext2={"stage": "extract", "resource": "src", "steps": [{"output": "raw"}]}), "made by both"),
        (_with(t={"stage": "transform", "input": "nope", "output": "o", "steps": [{"action": "sort", "with": {"a": "asc"}}]}), "no task makes"),
        (_with(t={"stage": "extract", "resource": "nope", "steps": [{"output": "o"}]}), "unknown resource"),
        (_with(t={"stage": "extract", "resource": "src", "depends_on": ["nope"], "steps": [{"output": "o"}]}), "unknown tasks"),
        (_with(t={"stage": "extract", "resource": "src", "steps": [{"output": "o", "contract": "nope"}]}), "unknown schemas"),
        (_with(t={"stage": "transform", "output": "o", "steps": [{"action": "union", "with": {}}]}), "list of frames"),
        (_with(t={"stage": "transform", "output": "o", "steps": [{"action": "compare_diff", "with": {"source": "raw", "target": "gone", "key": "k"}}]}), "gone"),
        (_with(t={"stage": "load", "resource": "src", "steps": [{"input": "raw", "mode": "upsert"}]}), "needs a key"),
        (_with(t={"stage": "load", "resource": "src", "steps": [{"input": "raw", "mode": "scd2", "key": "k"}]}), "scd block"),
        (_with(t={"stage": "load", "resource": "src", "steps": [{"input": "raw", "mode": "append", "write": {"partition_by": ["a"]}}]}), "mode replace only"),
        (_with(t={"stage": "extract", "resource": "src", "incremental": {"strategy": "watermark"}, "steps": [{"output": "o"}]}), "needs a cursor"),
        (_with(t={"stage": "load", "resource": "src", "steps": [], "extra": 1}), "extra"),
        (plan(orchestration={"watermark_store": {"resource": "nope"}}), "watermark store"),
    ],
)
def test_bad_blueprints(doc, message):
    with pytest.raises(ConfigError, match=message):
        load_config(doc)


def test_files_that_cannot_be_read(tmp_path):
    (tmp_path / "a.yaml").write_text("- 1\n- 2\n")
    (tmp_path / "b.json").write_text("{")
    for name in ("a.yaml", "b.json", "c.yaml"):
        with pytest.raises(ConfigError):
            load_config(tmp_path / name)


def test_order_and_cycles():
    doc = _with(last={"stage": "transform", "output": "o", "steps": [{"action": "join", "with": {"left": "kept", "right": "raw", "on": "v"}}]})
    assert dag.order(load_config(doc)) == ["ext", "keep", "last"]
    doc["tasks"]["ext"]["depends_on"] = ["last"]
    with pytest.raises(DependencyError, match="wait for each other"):
        dag.order(load_config(doc))


def test_rejected_frames_can_be_consumed():
    doc = _with(q={"stage": "transform", "input": "raw", "output": "q", "steps": [{"action": "cast", "with": {"v": "integer"}, "on_error": "quarantine"}]}, r={"stage": "transform", "input": "q__rejected", "output": "r", "steps": [{"action": "drop", "with": ["x"]}]})
    assert dag.order(load_config(doc)).index("r") > dag.order(load_config(doc)).index("q")


def test_only_frames_whose_order_matters_are_numbered():
    doc = _with(d={"stage": "transform", "input": "kept", "output": "d", "steps": [{"action": "dedupe", "with": {"on": "k"}}]}, e={"stage": "extract", "resource": "src", "steps": [{"output": "other"}]}, s={"stage": "transform", "input": "other", "output": "s", "steps": [{"action": "sort", "with": {"k": "asc"}}]})
    assert dag.ordered_frames(load_config(doc)) == {"raw", "kept"}


def test_durations():
    assert [parse_duration(x).total_seconds() for x in ("30s", "10m", "2h", "7d", "1w", 5, "1.5")] == [30, 600, 7200, 604800, 604800, 5, 1.5]
    for bad in ("x", "5y", True, ""):
        with pytest.raises(ConfigError):
            parse_duration(bad)


def test_secrets(monkeypatch):
    monkeypatch.setenv("DB_PASS_WORD", "x1")
    assert EnvSecretProvider().get("db/pass-word") == "x1" and EnvSecretProvider({"p": "DB_PASS_WORD"}).get("p") == "x1"
    for provider in (EnvSecretProvider(), MappingSecretProvider({})):
        with pytest.raises(SecretError):
            provider.get("surely/not/there")
    import logging

    record = logging.LogRecord("weirflow", 20, "f", 1, "the key is %s", ("x1",), None)
    RedactingFilter({"x1"}).filter(record)
    assert record.getMessage() == "the key is ***"


def test_registries():
    r = Registry("things")
    r.add("a", "b")(int)
    assert r.get("b") is int and r.names() == ["a", "b"]
    with pytest.raises(RegistryError, match="already"):
        r.add("a")(str)
    r.add("a", replace=True)(str)
    assert r.get("a") is str
    with pytest.raises(RegistryError, match="unknown things"):
        r.get("zzz")


def test_command_line(tmp_path, capsys):
    from weirflow.cli import main

    doc = plan(parameters={"low": {"type": "integer", "required": True}})
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(doc))
    assert main(["validate", str(tmp_path / "p.yaml"), "--param", "low=3"]) == 0 and "ext -> keep" in capsys.readouterr().out
    assert main(["validate", str(tmp_path / "p.yaml")]) == 1 and main(["validate", str(tmp_path / "p.yaml"), "--param", "x"]) == 1
    assert main(["schema"]) == 0 and "properties" in capsys.readouterr().out
