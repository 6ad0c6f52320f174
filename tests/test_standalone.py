import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_imports_without_the_llm_parts(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "marlstone", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "marlstone").mkdir()
    for p in (ROOT / "marlstone").iterdir():
        if p.name != "llm":
            (tmp_path / "marlstone" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and 'pipeline' not in n and not any(k.startswith('op') and k[2].isdigit() for k in n); print(len(n))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_query_and_the_flagship_run_without_the_llm_parts(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "marlstone", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "marlstone").mkdir()
    for p in (ROOT / "marlstone").iterdir():
        if p.name != "llm":
            (tmp_path / "marlstone" / p.name).symlink_to(p)
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(s).count() > 0
assert e.queries()["rolling_zscore"](s, "/root/testdata/sf0.001").count() > 0
"""
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_llm_parts():
    for p in (ROOT / "marlstone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "marlstone").parts:
            assert "marlstone.llm" not in p.read_text()
