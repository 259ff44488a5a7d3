import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["effect", "n", "n_positive", "rate"] and df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_no_local_checkpoint_or_python_row_udf():
    import pathlib

    source = "".join(p.read_text() for p in pathlib.Path(entry.__file__).parent.joinpath("trivalent").rglob("*.py"))
    assert "localCheckpoint" not in source and "F.udf" not in source
