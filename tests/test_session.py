import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_subpackage(tmp_path):
    """The queries of the engine remain when issq/llm and the pipeline go."""
    import shutil

    shutil.copytree(ROOT / "issq", tmp_path / "issq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": "", "PATH": "/usr/bin:/bin"}).returncode == 0


def test_a_broken_subpackage_is_not_hidden(tmp_path):
    """Only a subpackage that is not there is passed over."""
    import shutil

    shutil.copytree(ROOT / "issq", tmp_path / "issq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "issq" / "llm").mkdir()
    (tmp_path / "issq" / "llm" / "registry.py").write_text("import no_such_module_at_all\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PYTHONPATH": "", "PATH": "/usr/bin:/bin"}, capture_output=True)
    assert got.returncode != 0 and b"no_such_module_at_all" in got.stderr
