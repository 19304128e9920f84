"""The rest of the library stands without the training-data subpackage."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tidemark.llm" not in path.read_text(), path


def test_entry_imports_without_it(tmp_path):
    (tmp_path / "tidemark").mkdir()
    for name in ("functions", "operators", "plans", "sources", "streaming", "__init__.py"):
        (tmp_path / "tidemark" / name).symlink_to(ROOT / "tidemark" / name)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = f"import sys; sys.path[:] = ['{tmp_path}'] + [p for p in sys.path if p not in ('', '{ROOT}')]; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
