import os

from loomgraph.sources.files import symbols_of
from loomgraph.streaming.incremental import current, file_stream, keep_parsed


def test_changed_file_supersedes(spark, tmp_path):
    tree, table, mark = tmp_path / "src", str(tmp_path / "t"), str(tmp_path / "c")
    (tree / "1").mkdir(parents=True)
    (tree / "2").mkdir()

    def run():
        keep_parsed(file_stream(spark, str(tree)), table, mark).awaitTermination()
        return sorted(r.name for r in symbols_of(current(spark, table)).collect())

    (tree / "1" / "A.kt").write_text("class A")
    (tree / "1" / "B.kt").write_text("class B")
    assert run() == ["A", "B"]
    (tree / "2" / "A.kt").write_text("class A { fun m() {} }")
    later = os.stat(tree / "2" / "A.kt").st_mtime + 5
    os.utime(tree / "2" / "A.kt", (later, later))
    assert run() == ["A", "A.m", "B"]
