"""Queries with Python workers that cannot import the package."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import corpus_pipeline
from tripspark.llm import registry
from tripspark.session import local_session

spark = local_session("2", 2, "without-package")

def imports(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("tripspark") is not None])], names=["there"])

assert not spark.range(1, numPartitions=1).mapInArrow(imports, "there boolean").first().there
for name in ("op5_pieces", "op10_language", "op12_alignment"):
    print(name, registry.QUERIES[name](spark, {data!r}).count())
print("pipeline", corpus_pipeline.run(spark, {data!r}).count() > 0)
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not mounted")
def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=ROOT, data="/root/testdata/sf0.001")
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert got.returncode == 0, got.stderr[-3000:]
    assert got.stdout.split("\n")[:4] == ["op5_pieces 200", "op10_language 200", "op12_alignment 200", "pipeline True"]
