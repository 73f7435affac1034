import pytest

import __spark_entry__
from lodestone.llm import queries

from ..conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name]) > 0


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_nothing_else_imports_this_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "lodestone"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                names += [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in x.split(".") for x in names), path
