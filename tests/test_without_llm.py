"""The rest stands without the subpackage: a copy without its folders, then without the pipeline too."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LOOK = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"


def test_entry_without_llm(tmp_path):
    for part in ("tidegate", "tests"):
        shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
