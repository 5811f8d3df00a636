import importlib

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_nothing_outside_the_llm_folder_needs_it():
    import ast
    from pathlib import Path

    root = Path(importlib.import_module("chronotext").__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("chronotext.llm") for n in names), path


def test_queries_and_sql_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0 and len(said.stdout.split()) == 2, said.stderr
