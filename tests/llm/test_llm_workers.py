"""Python workers have no copy of the package: queries run where neither PYTHONPATH nor the working folder leads to it."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from lumenframe.session import local_session
from lumenframe.llm.queries import QUERIES
spark = local_session("4", "workers")
def importable(batches):
    import importlib.util
    for batch in batches:
        yield batch.slice(0, 0) if importlib.util.find_spec("lumenframe") is None else batch
assert spark.range(1).mapInArrow(importable, "id long").count() == 0, "the workers have the package"
for name in QUERIES:
    if name.split("_")[0] in {names!r}:
        print(name, QUERIES[name](spark, {sf!r}).count(), flush=True)
"""


def test_queries_without_the_package_on_workers(sf, tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    names = {f"op{i}" for i in (2, 3, 4, 5, 9, 10, 11, 12, 13)}  # those with Python workers
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_PYTHON")} | {"PYSPARK_PYTHON": sys.executable}
    script = SCRIPT.format(repo=repo, names=names, sf=sf)
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    assert len(out.stdout.split("\n")) >= len(names)
