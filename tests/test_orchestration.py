import logging

import pytest

from weirflow import Orchestrator, load_config, register_notifier, register_transform, run_pipeline
from weirflow.errors import ContractError, ExpectationError, TransformError, WeirflowError
from weirflow.operators import Transform
from weirflow.sources import create_adapter


@pytest.fixture
def plan(tmp_path):
    (tmp_path / "in.csv").write_text("k,v\n1,10\n2,20\n3,30\n")

    def make(steps=None, load=None, **more):
        doc = {
            "metadata": {"id": "p"},
            "resources": {"src": {"adapter": "file", "params": {"format": "csv", "path": str(tmp_path / "in.csv")}}, "dst": {"adapter": "db", "params": {"engine": "sqlite", "path": str(tmp_path / "out.db")}}},
            "tasks": {
                "ext": {"stage": "extract", "resource": "src", "steps": [{"output": "raw"}]},
                "keep": {"stage": "transform", "input": "raw", "output": "kept", "steps": steps or [{"action": "filter", "with": {"v": {"op": ">=", "value": 20}}}]},
                "put": {"stage": "load", "resource": "dst", "steps": [load or {"input": "kept", "collection": "fact"}]},
            },
        }
        for key, value in more.items():
            doc["tasks"][key] = {**doc["tasks"].get(key, {}), **value} if key in doc["tasks"] or "stage" in value else value
            if key in ("orchestration", "schemas", "settings", "partition", "defaults"):
                doc[key] = doc["tasks"].pop(key)
        return doc

    return make


@pytest.fixture
def keys(spark):
    def read(config, table="fact"):
        return sorted(r["k"] for r in create_adapter(config.resources["dst"], spark).read(table).collect())

    return read


def go(spark, doc, **more):
    config = load_config(doc, **more)
    return config, run_pipeline(config, spark)


def test_end_to_end(spark, plan, keys):
    config, ctx = go(spark, plan())
    assert keys(config) == [2, 3] and ctx.load_results[0].inserted == 2
    config, _ = go(spark, plan())
    assert keys(config) == [2, 3]  # running twice gives the same table


def test_tasks_at_once(spark, plan, keys):
    config, _ = go(spark, plan(orchestration={"max_parallelism": 4}, more={"stage": "transform", "input": "raw", "output": "more", "steps": [{"action": "sort", "with": {"v": "desc"}}]}))
    assert keys(config) == [2, 3]


def test_failing_tasks(spark, plan, keys, caplog):
    bad = [{"action": "derive", "with": {"target": "x", "expr": {"col": "nope"}}}]
    with pytest.raises(WeirflowError, match="task keep, step 1 .derive.*nope"):
        go(spark, plan(bad))
    doc = plan(bad, {"input": "raw", "collection": "fact"}, keep={"on_failure": "skip"})
    config, _ = go(spark, doc)
    assert keys(config) == [1, 2, 3]


def test_steps_that_are_skipped(spark, plan, keys):
    steps = [{"action": "cast", "with": {"t": "integer"}, "on_error": "skip"}, {"action": "derive", "with": {"target": "t", "expr": {"lit": "x"}}}, {"action": "cast", "with": {"t": "integer"}, "on_error": "skip"}]
    config, ctx = go(spark, plan(steps))
    assert ctx.state.get("kept").columns == ["k", "v", "t"] and ctx.state.get("kept").first()["t"] == "x"


def test_quarantine(spark, plan, tmp_path):
    (tmp_path / "in.csv").write_text("k,v,w\n1,10,5\n2,bad,6\n3,30,odd\n")
    steps = [{"action": "cast", "with": {c: "integer"}, "on_error": "quarantine"} for c in ("v", "w")]
    _, ctx = go(spark, plan(steps, {"input": "kept__rejected", "collection": "bad"}))
    assert [r["k"] for r in ctx.state.get("kept").collect()] == [1] and sorted(r["k"] for r in ctx.state.get("kept__rejected").collect()) == [2, 3]
    with pytest.raises(TransformError, match="can't quarantine"):
        go(spark, plan([{"action": "sort", "with": {"k": "asc"}, "on_error": "quarantine"}]))


def test_strict_casts_fail_at_the_load(spark, plan, tmp_path):
    (tmp_path / "in.csv").write_text("k,v\n1,10\n2,bad\n")
    with pytest.raises(WeirflowError, match="can't become bigint: bad"):
        go(spark, plan([{"action": "cast", "with": {"v": "integer"}}]))


def test_contracts_and_expectations(spark, plan):
    schemas = {"c": {"columns": {"v": {"checks": [{"<": 30}]}}}}
    with pytest.raises(ContractError, match="contract c: v: 1 values"):
        go(spark, plan(schemas=schemas, keep={"output_contract": "c"}))
    go(spark, plan(schemas=schemas, keep={"output_contract": "c", "validate": "warn"}))
    go(spark, plan(schemas=schemas, keep={"output_contract": "c", "validate": "off"}))
    with pytest.raises(ContractError):
        go(spark, plan(schemas=schemas, put={"steps": [{"input": "kept", "collection": "fact", "input_contract": "c"}]}))
    with pytest.raises(ExpectationError):
        go(spark, plan(keep={"expectations": [{"name": "few", "assert": {"row_count": {"<": 2}}}]}))


def test_retry(spark, plan, keys):
    tries = []

    @register_transform("flaky", replace=True)
    class Flaky(Transform):
        def apply(self, df, ctx=None):
            tries.append(1)
            if len(tries) < 3:
                raise TransformError("not yet")
            return df

    config, _ = go(spark, plan([{"action": "flaky"}], keep={"retry": {"attempts": 3, "delay": "0s", "backoff": 2}}))
    assert len(tries) == 3 and keys(config) == [1, 2, 3]
    tries.clear()
    with pytest.raises(TransformError, match="after 2 attempts"):
        go(spark, plan([{"action": "flaky"}], keep={"retry": {"attempts": 2}}))


def test_watermarks_move_only_with_success(spark, plan, tmp_path):
    marks = {"watermark_store": {"resource": "dst", "table": "marks"}}
    ext = {"incremental": {"strategy": "watermark", "cursor": "k", "initial": 1}}
    with pytest.raises(WeirflowError):
        go(spark, plan(orchestration=marks, ext=ext, put={"steps": [{"input": "kept", "collection": "fact", "mode": "upsert", "key": "zzz"}]}))
    config, ctx = go(spark, plan(orchestration=marks, ext=ext))
    assert sorted(r["k"] for r in ctx.state.get("raw").collect()) == [2, 3]
    (tmp_path / "in.csv").write_text("k,v\n3,30\n4,40\n")
    _, ctx = go(spark, plan(orchestration=marks, ext=ext))
    assert [r["k"] for r in ctx.state.get("raw").collect()] == [4]
    store = create_adapter(config.resources["dst"], spark).read("marks").first()
    assert (store["pipeline"], store["task"], store["cursor_name"], store["value"], store["kind"]) == ("p", "ext", "k", "4", "integer")


def test_checkpoints_are_reused_until_something_changes(spark, plan, tmp_path):
    runs = []

    @register_transform("counted", replace=True)
    class Counted(Transform):
        x: int = 0

        def apply(self, df, ctx=None):
            runs.append(self.x)
            return df

    o = {"checkpoint": {"enabled": True, "store": str(tmp_path / "ckpt")}}
    for x in (1, 1, 2):
        go(spark, plan([{"action": "counted", "with": {"x": x}}], orchestration=o))
    assert runs == [1, 2]
    (tmp_path / "in.csv").write_text("k,v\n1,10\n")
    go(spark, plan([{"action": "counted", "with": {"x": 2}}], orchestration=o))
    assert runs == [1, 2, 2]


def test_notifications_and_time_limits(spark, plan, caplog):
    heard = []

    @register_notifier("ear", replace=True)
    class Ear:
        def notify(self, event, message, target=None):
            heard.append((event, target))

    notes = {"on_failure": [{"type": "ear", "target": "ops"}, {"type": "unheard-of"}], "on_sla": [{"type": "ear", "target": "sla"}]}
    go(spark, plan(orchestration={"notifications": notes, "sla": {"max_runtime": "0.001s"}}))
    assert heard == [("sla", "sla")]
    with pytest.raises(WeirflowError):
        go(spark, plan([{"action": "nope"}], orchestration={"notifications": notes}))
    assert heard[-1] == ("failure", "ops")


def test_secrets_are_hidden_in_logs(spark, plan, caplog):
    from weirflow.secret_providers import MappingSecretProvider

    steps = [{"action": "derive", "with": {"target": "x", "expr": {"col": "${secret:s}"}}}]
    with caplog.at_level(logging.INFO, "weirflow"), pytest.raises(WeirflowError):
        go(spark, plan(steps), secret_provider=MappingSecretProvider({"s": "hush-hush"}))
    assert "hush-hush" not in caplog.text and "***" in caplog.text


def test_partition_values_date_history(spark, plan):
    load = {"input": "kept", "collection": "h", "mode": "scd2", "key": "k", "scd": {"track": ["v"]}}
    config, _ = go(spark, plan(load=load, partition={"field": "day", "bounds": {"start": "2024-07-01"}}))
    row = create_adapter(config.resources["dst"], spark).read("h").first()
    assert str(row["valid_from"]) == "2024-07-01 00:00:00" and row["is_current"] is True


def test_shuffled_frames_that_are_read_twice_are_kept(spark, plan):
    again = {"stage": "transform", "input": "kept", "output": "a", "steps": [{"action": "drop", "with": ["v"]}]}
    assert Orchestrator(load_config(plan(a=again)), spark).run().persisted == []
    doc = plan([{"action": "dedupe", "with": {"on": "k"}}], a={"stage": "transform", "input": "kept", "output": "a", "steps": [{"action": "drop", "with": ["v"]}]})
    config = load_config(doc)
    runner = Orchestrator(config, spark)
    ctx = runner.run()
    assert len(ctx.persisted) == 1
    runner.release(ctx)
    assert ctx.persisted == []


def test_demo_scenario(spark, tmp_path):
    """Seven untidy orders with customers and products, to margins of the completed ones."""
    (tmp_path / "orders.csv").write_text(
        "order_id,cust_id,product_id,status_code,amount,qty,order_date\n"
        'ORD-1001,1,10,C,"$1,200.50",2,2024-01-05\nORD-1002,2,11,P,$80.00,1,2024-01-06\nORD-1003,1,12,C,$300.00,3,2024-01-07\nORD-1003,1,12,C,$300.00,3,2024-01-07\n'
        "ORD-1004,3,10,X,$50.00,1,2024-01-08\nORD-1005,2,12,C,$99.90,1,2024-01-09\nORD-1006,9,11,C,$10.00,1,2024-01-10\n"
    )
    (tmp_path / "customers.json").write_text('[{"cust_id": 1, "cust_name": "  ann LEE "}, {"cust_id": 2, "cust_name": "BOB"}, {"cust_id": 3, "cust_name": "cy"}]')
    (tmp_path / "products.tsv").write_text("product_id\tunit_cost\n10\t500.0\n11\t5.0\n12\t60.0\n")
    file = lambda kind, name: {"adapter": "file", "params": {"format": kind, "path": str(tmp_path / name)}}
    doc = {
        "resources": {"o": file("csv", "orders.csv"), "c": file("json", "customers.json"), "p": file("tsv", "products.tsv"), "out": {"adapter": "db", "params": {"engine": "managed", "path": str(tmp_path / "wh")}}},
        "tasks": {
            "eo": {"stage": "extract", "resource": "o", "steps": [{"output": "orders"}]},
            "ec": {"stage": "extract", "resource": "c", "steps": [{"output": "customers"}]},
            "ep": {"stage": "extract", "resource": "p", "steps": [{"output": "products"}]},
            "names": {"stage": "transform", "input": "customers", "output": "names", "steps": [{"action": "normalize", "with": {"cust_name": ["strip", "title"]}}]},
            "clean": {
                "stage": "transform",
                "input": "orders",
                "output": "clean",
                "steps": [
                    {"action": "dedupe", "with": {"on": "order_id"}},
                    {"action": "label", "with": {"status_code": "status"}},
                    {"action": "replace", "with": {"amount": [{"regex": r"[$,]"}], "order_id": {"regex": "^ORD-"}}},
                    {"action": "cast", "with": {"amount": "float", "order_id": "integer", "order_date": "date"}},
                    {"action": "map", "with": {"status": {"C": "completed", "P": "pending", "X": "cancelled"}}},
                    {"action": "filter", "with": {"status": {"op": "==", "value": "completed"}}},
                ],
            },
            "final": {
                "stage": "transform",
                "output": "final",
                "steps": [
                    {"action": "join", "with": {"left": "clean", "right": "names", "on": "cust_id", "how": "left", "relationship": "m:1"}},
                    {"action": "merge", "with": {"left": "${pipe}", "right": "products", "on": "product_id", "how": "inner"}},
                    {"action": "derive", "with": {"target": "margin", "expr": {"round": [{"-": [{"col": "amount"}, {"*": [{"col": "qty"}, {"col": "unit_cost"}]}]}, 2]}}},
                    {"action": "fillna", "with": {"cust_name": "unknown"}},
                    {"action": "select", "with": ["order_id", "cust_name", "margin"]},
                ],
            },
            "put": {"stage": "load", "resource": "out", "steps": [{"input": "final", "collection": "margins", "mode": "upsert", "key": "order_id"}]},
        },
    }
    config, _ = go(spark, doc)
    rows = sorted(tuple(r) for r in create_adapter(config.resources["out"], spark).read("margins").collect())
    assert rows == [(1001, "Ann Lee", 200.5), (1003, "Ann Lee", 120.0), (1005, "Bob", 39.9), (1006, "unknown", 5.0)]


def test_streamed_files_are_loaded_once(spark, tmp_path):
    from weirflow.config.format import Resource
    from weirflow.streaming import ingest_new_files

    inbox = tmp_path / "inbox"
    target = create_adapter(Resource(name="t", adapter="db", params={"engine": "managed", "path": str(tmp_path / "m")}), spark)
    total = lambda: sorted(r["id"] for r in target.read("t").collect())
    for low in (0, 5):
        spark.range(low, low + 5).write.mode("append").parquet(str(inbox))
        n = ingest_new_files(spark, str(inbox), "id long", target, "t", str(tmp_path / "state"), steps=[("filter", {"id": {"op": "!=", "value": 3}})])
        assert n == 5
    assert total() == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    with pytest.raises(TransformError, match="single rows"):
        ingest_new_files(spark, str(inbox), "id long", target, "t", str(tmp_path / "s2"), steps=[("dedupe", {"on": "id"})])


def test_a_batch_is_published_once(spark, tmp_path, monkeypatch):
    """A stream that fails after the manifest and before its own commit tries the batch again."""
    from weirflow.config.format import Resource
    from weirflow.streaming import ingest_new_files

    target = create_adapter(Resource(name="t", adapter="db", params={"engine": "managed", "path": str(tmp_path / "m")}), spark)
    spark.range(5).write.parquet(str(tmp_path / "inbox"))
    load = lambda: ingest_new_files(spark, str(tmp_path / "inbox"), "id long", target, "t", str(tmp_path / "state"))
    real = target.write_once

    def crash(*args):
        real(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(target, "write_once", crash)
    with pytest.raises(Exception, match="lost"):
        load()
    monkeypatch.setattr(target, "write_once", real)
    assert load() == 0 and target.read("t").count() == 5
    spark.range(5, 7).write.mode("append").parquet(str(tmp_path / "inbox"))
    assert load() == 2 and target.read("t").count() == 7


def test_rows_above_the_mark_are_the_next_runs(spark, plan, tmp_path, monkeypatch):
    """Rows that come between marking and loading, as when a lost executor's part is read again."""
    from weirflow.plans import runner

    monkeypatch.setattr(runner, "_keep", lambda frame, ctx: frame)
    marks = {"watermark_store": {"resource": "dst", "table": "marks"}}
    doc = plan(orchestration=marks, ext={"incremental": {"strategy": "watermark", "cursor": "k", "initial": 0}})
    del doc["tasks"]["put"]
    _, ctx = go(spark, doc)
    spark.catalog.refreshByPath(str(tmp_path / "in.csv"))
    (tmp_path / "in.csv").write_text("k,v\n1,10\n2,20\n3,30\n9,90\n")
    spark.catalog.refreshByPath(str(tmp_path / "in.csv"))
    assert sorted(r["k"] for r in ctx.state.get("raw").collect()) == [1, 2, 3]


def test_fingerprints_follow_every_file(spark, tmp_path):
    import os

    from weirflow.plans.runner import _fingerprint

    spark.range(60).repartition(40).write.parquet(str(tmp_path / "a b{1}"))
    read = lambda: _fingerprint(spark.read.parquet(str(tmp_path / "a b\\{1\\}")))
    first = read()
    files = sorted((tmp_path / "a b{1}").glob("part-*.parquet"))
    assert read() == first and first.startswith(f"{len(files)}-")
    os.utime(files[-1], (1, 1))
    assert read() != first
    assert _fingerprint(spark.range(3)).startswith("unknown")


def test_one_writer_publishes_a_manifest(spark, tmp_path):
    from weirflow.config.format import Resource
    from weirflow.errors import AdapterError

    table = create_adapter(Resource(name="t", adapter="db", params={"engine": "managed", "path": str(tmp_path / "m")}), spark)
    table.write(spark.range(3).toDF("id"), "t")
    number, tables = table._manifest()
    table._commit(number + 1, tables)
    with pytest.raises(AdapterError, match="published first"):
        table._commit(number + 1, tables)
    (tmp_path / "m" / "_manifests" / f"{number + 2:012d}.json").write_text('{"t": ')
    assert table.read("t").count() == 3  # a manifest that isn't whole isn't published
    with pytest.raises(AdapterError, match="isn't whole"):
        table.write(spark.range(3).toDF("id"), "t")


def test_command_line_runs_a_file(spark, plan, keys, tmp_path, capsys):
    import yaml

    from weirflow.cli import main

    doc = plan([{"action": "filter", "with": {"v": {"op": ">=", "value": "${param:low}"}}}])
    doc["parameters"] = {"low": {"type": "integer", "default": 30}}
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(doc))
    assert main(["run", str(tmp_path / "p.yaml"), "--param", "low=20"]) == 0 and "inserted=2" in capsys.readouterr().out
    assert keys(load_config(doc)) == [2, 3]
    assert main(["run", str(tmp_path / "p.yaml")]) == 0 and keys(load_config(doc)) == [3]
    doc["tasks"]["put"]["steps"][0] |= {"mode": "upsert", "key": "zzz"}
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(doc))
    assert main(["-v", "run", str(tmp_path / "p.yaml")]) == 1 and "AdapterError" in capsys.readouterr().err
