import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_has_names_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10


def test_library_stands_without_the_text_operators(tmp_path):
    """A copy without the optional folders still imports and lists its queries."""
    (tmp_path / "strandline").symlink_to("nowhere")
    (tmp_path / "strandline").unlink()
    (tmp_path / "strandline").mkdir()
    for p in (ROOT / "strandline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "strandline" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'eval_pipe_report' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q)"
    env = {"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)
    (tmp_path / "tests").mkdir()
    for p in (ROOT / "tests").glob("*.py"):
        (tmp_path / "tests" / p.name).write_text(p.read_text())
    subprocess.run([sys.executable, "-B", "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, check=True, env=env)
