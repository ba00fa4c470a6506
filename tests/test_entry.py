import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def said(folder: Path) -> list[str]:
    out = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    return out.stdout.split()


def copied(tmp_path: Path, *without: str) -> Path:
    to = tmp_path / "copy"
    shutil.copytree(ROOT / "corpusloom", to / "corpusloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)
    for name in without:
        p = to / name
        if p.is_dir():
            shutil.rmtree(p)
        else:
            p.unlink(missing_ok=True)
    return to


def test_queries_without_a_session(tmp_path):
    n, sql, _, subset = said(copied(tmp_path))
    assert int(n) > 50 and int(sql) > 50 and subset == "True"


def test_without_the_training_data_operators(tmp_path):
    n, _, training, subset = said(copied(tmp_path, "corpusloom/llm", "corpus_pipeline.py"))
    assert int(n) > 50 and training == "0" and subset == "True"


def test_nothing_else_imports_them():
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "corpusloom.llm" not in p.read_text()
