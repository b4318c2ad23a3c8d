"""The entry module works without the optional operator subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_subpackage():
    code = (
        "import sys; sys.modules['quire.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = set(e.queries())\n"
        "assert len(names) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in names), names\n"
        "assert set(e.oracle_sql()) <= names"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "quire")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "quire.llm" not in f.read(), name
