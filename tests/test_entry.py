"""The driver contract."""

import __spark_entry__ as e


def test_entry_has_rows_and_a_stable_schema(spark):
    first, again = e.entry(spark), e.entry(spark)
    assert first.schema == again.schema
    assert first.count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80


def test_no_operator_imports_the_optional_part():
    import pathlib

    import packetloom

    root = pathlib.Path(packetloom.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "packetloom.llm" not in path.read_text()
