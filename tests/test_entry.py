import json
import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["nation", "revenue", "quantity", "lines"] and 0 < df.count() <= 10


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy of the repository from which the subpackage and its pipeline are missing."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    package = tmp_path / "tessera"
    package.mkdir()
    for f in (ROOT / "tessera").iterdir():
        if f.name not in ("llm", "__pycache__"):
            os.symlink(f, package / f.name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    many, sql, llm = out.stdout.split()
    assert int(many) > 200 and int(sql) > 200 and llm == "False"
    (tmp_path / "tests").mkdir()
    for f in (ROOT / "tests").glob("*.py"):
        if f.name != "test_entry.py":
            os.symlink(f, tmp_path / "tests" / f.name)
    some = ["tests/test_filters.py", "tests/test_expressions.py", "tests/test_catalogue.py::test_same_as_sql[agg_count]"]
    out = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", *some], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stdout[-3000:]


def test_a_missing_package_is_seen(tmp_path):
    """Only the subpackage and its pipeline may be missing, not what they import."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_package\n")
    os.symlink(ROOT / "tessera", tmp_path / "tessera")
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "no_such_package" in out.stderr


def test_bench_prints_one_line():
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2"}
    out = subprocess.run([sys.executable, str(ROOT / "bench.py"), "agg_count"], env=env, capture_output=True, text=True, timeout=300)
    found = json.loads(out.stdout.strip().splitlines()[-1])
    assert found["unit"] == "sec" and list(found["queries"]) == ["agg_count"] and found["sf"] == "0.001"
