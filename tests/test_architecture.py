import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""


def test_nothing_else_needs_the_llm_folder():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert not any(".llm" in name or name == "corpus_pipeline" for name in imports(path)), path


def test_layers():
    order = {"functions": 0, "operators": 1, "sources": 2, "streaming": 2, "plans": 3}
    for layer, rank in order.items():
        for path in (ROOT / "tessera" / layer).glob("*.py"):
            for name in imports(path):
                parts = name.split(".")
                if parts[0] == "tessera" and len(parts) > 1 and parts[1] in order:
                    assert order[parts[1]] <= rank, (path, name)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    got = entry.entry(spark)
    assert got.columns == ["doc_id", "item_id", "held", "own", "containment", "band"] and got.count() >= 0
