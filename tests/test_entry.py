import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_needs_no_session():
    """The driver may import the queries before it makes a session."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent, timeout=60)
