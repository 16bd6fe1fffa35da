"""The entry module works with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_parts(tmp_path):
    for name in ("lodestone", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_optional_parts():
    for p in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "lodestone").parts:
            assert "lodestone.llm" not in p.read_text(), p


def entry_where_a_module_is_missing(tmp_path, module, claim):
    (tmp_path / f"{module}.py").write_text("raise ImportError('not here')\n")
    code = f"import __spark_entry__ as e; q = e.queries(); assert len(q) > 300 and set(e.oracle_sql()) <= set(q) and {claim}"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}", "PYTHONDONTWRITEBYTECODE": "1"})


def test_entry_where_the_optional_parts_cannot_be_imported(tmp_path):
    entry_where_a_module_is_missing(tmp_path, "zstandard", "'pipeline' not in q and not any(n.startswith('op1_') for n in q)")


def test_a_machine_without_tokenizer_files_keeps_the_queries_that_need_none(tmp_path):
    entry_where_a_module_is_missing(tmp_path, "public_tokenizers", "(any(n.startswith('op') for n in q) == ('pipeline' in q))")
