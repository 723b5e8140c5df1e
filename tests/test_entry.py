"""The driver's contract, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def names(folder: Path) -> list[list[str]]:
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout
    return [line.split() for line in out.strip().split("\n")]


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "lexiloom", tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found, sql = names(tmp_path)
    assert "minimum_cover" in found and set(sql) <= set(found) and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "lexiloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(encoding="utf-8"), f


def test_entry_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).columns == ["doc_id", "n_atoms", "n_words", "cost"]
        assert __spark_entry__.entry(spark).count() > 0
