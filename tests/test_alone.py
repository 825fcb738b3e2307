"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_stands_alone(tmp_path):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(tree / "caselight" / "llm", ignore_errors=True)
    shutil.rmtree(tree / "tests" / "llm", ignore_errors=True)
    told = ("import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; "
            "assert not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names; print(len(names))")
    for left in (True, False):  # with and without the pipeline's file
        if not left:
            (tree / "corpus_pipeline.py").unlink(missing_ok=True)
        out = subprocess.run([sys.executable, "-c", told], cwd=tree, capture_output=True, text=True)
        assert out.returncode == 0 and int(out.stdout) > 70, out.stderr


def test_nothing_else_imports_the_subpackage():
    for folder in ("caselight", "registry", "tools"):
        for where, _, names in os.walk(os.path.join(ROOT, folder)):
            if os.path.join("caselight", "llm") in where:
                continue
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(where, name)) as file:
                        assert "caselight.llm" not in file.read(), name
