"""Compaction of the result store while others write to it."""

from variorum.session import scratch_folder
from variorum.sources import results


def rows(spark, *held):
    return spark.createDataFrame(list(held), "doc_id string, page_id string, text string")


def stored(spark, path):
    return {(r.doc_id, r.page_id): r.text for r in results.read_stored(spark, path).collect()}


def test_compaction_keeps_what_is_written_meanwhile(spark, monkeypatch):
    path = scratch_folder(spark, "store")
    results.write_results(rows(spark, ("d", "1", "old"), ("d", "2", "stays")), path)
    results.write_results(rows(spark, ("d", "1", "newer")), path)
    read = results.read_runs

    def late(*given):
        found = read(*given)
        results.write_results(rows(spark, ("d", "1", "newest")), path)
        return found

    monkeypatch.setattr(results, "read_runs", late)
    results.compact_results(spark, path)
    monkeypatch.setattr(results, "read_runs", read)
    assert stored(spark, path) == {("d", "1"): "newest", ("d", "2"): "stays"}
    results.compact_results(spark, path)
    assert stored(spark, path) == {("d", "1"): "newest", ("d", "2"): "stays"}


def test_compaction_leaves_unfinished_runs(spark):
    path = scratch_folder(spark, "store")
    for text in ("a", "b", "c", "d"):
        results.write_results(rows(spark, ("d", "1", text)), path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop(path)))
    fs.delete(hadoop(f"{path}/{names[2]}/_SUCCESS"), False)
    results.compact_results(spark, path)
    left = sorted(s.getPath().getName() for s in fs.listStatus(hadoop(path)))
    assert left[1:] == names[2:] and len(left) == 3
    assert stored(spark, path) == {("d", "1"): "d"}
