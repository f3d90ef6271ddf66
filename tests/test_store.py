"""The version of a table changes with any file below it."""

from weftgraph.sources import store


def test_version_sees_files_of_any_depth(spark, tmp_path):
    table = tmp_path / "t.parquet"
    (table / "a=1" / "b=2").mkdir(parents=True)
    deep = table / "a=1" / "b=2" / "part"
    deep.write_text("one")
    first = store.version(spark, [str(table)])
    assert store.version(spark, [str(table)]) == first
    deep.write_text("three")
    assert store.version(spark, [str(table)]) != first
    single = tmp_path / "one.parquet"
    single.write_text("x")
    assert store.version(spark, [str(single)]) == store.version(spark, [str(single)])
