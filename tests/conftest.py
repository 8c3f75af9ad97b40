import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the workers

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("a long, b string", (1, "x"), ...) as one ordered partition."""

    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema).coalesce(1)

    return make


@pytest.fixture
def run(spark):
    """run(action, params, df, **frames) -> rows as tuples."""
    from weirflow import ExecutionContext, build_transform

    def apply(action, params, df=None, rows=True, **frames):
        ctx = ExecutionContext(spark=spark)
        for name, f in frames.items():
            ctx.state.set(name, f)
        out = build_transform(action, params).run(df, ctx)
        return [tuple(r) for r in out.collect()] if rows else out

    return apply
