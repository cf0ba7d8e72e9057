"""The entry points, and that the core stands without the language-model subpackage."""

from __future__ import annotations

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "quillon").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("quillon.llm") for n in names), path


def test_no_forbidden_shortcuts():
    for path in (ROOT / "quillon").rglob("*.py"):
        text = path.read_text()
        assert ".localCheckpoint(" not in text, path
