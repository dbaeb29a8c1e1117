"""The library without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_queries_without_the_training_data_operators(tmp_path):
    for name in ("marlstone", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    for gone in (False, True):
        if gone:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_them():
    for path in [*ROOT.glob("marlstone/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path != Path(__file__):
            assert "import llm" not in path.read_text() and ".llm" not in path.read_text(), path
