"""The optional part can be left out, and all test modules are collected together."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, *args):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, *args], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def names(folder):
    done = run(folder, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())")
    assert done.returncode == 0, done.stderr
    return [set(line.split()) for line in done.stdout.splitlines()]


def test_everything_is_collected():
    done = run(ROOT, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout[-2000:]


def test_without_the_optional_part(tmp_path):
    bare = tmp_path / "repo"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    queries, checks = names(bare)
    whole, whole_checks = names(ROOT)
    extra = whole - queries
    assert extra and all(q == "pipeline" or q.startswith("op") and q[2].isdigit() for q in extra)
    assert checks <= queries and whole_checks <= whole and len(queries) > 200
    done = run(bare, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout[-2000:]
