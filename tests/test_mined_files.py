"""Files of a project are opened once, and only if they are new."""

from pyspark.sql import functions as F

from loquat.operators import sessions
from loquat.service.memory import Memory
from loquat.sources import files


def test_a_file_that_was_mined_is_not_opened_again(spark, tmp_path):
    folder = tmp_path / "p"
    for name, text in {"a#b 50%.md": "first note", "sub/é.md": "second note", "_x=1.md": "third note", "sub/blank.md": " \n", ".git/c.md": "no", "node_modules/d.md": "no", "node_modules/.e/f.md": "no", ".gitignore": "left.md", "sub/left.md": "no", "g.bin": "no"}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    m = Memory(spark, str(tmp_path / "store"))
    assert {k: v for k, v in m.mine(str(folder)).items() if k != "topics"} == {"files": 3, "added": 3, "skipped": 0}
    assert {(r.source_file, r.content) for r in m.chunks().collect()} == {("a#b 50%.md", "first note"), ("sub/é.md", "second note"), ("_x=1.md", "third note")}
    (folder / "sub/é.md").unlink()
    (folder / "sub/é.md").symlink_to("/proc/self/mem")  # reading it fails
    (folder / "new.md").write_text("fourth note")
    assert {k: v for k, v in m.mine(str(folder)).items() if k != "topics"} == {"files": 1, "added": 1, "skipped": 3}
    assert {r.path for r in files.names(spark, str(folder), include=["node_modules"]).where("path LIKE '%d.md'").collect()} == {"node_modules/d.md"}


def test_many_files_are_a_few_tasks(spark, tmp_path):
    n = 3000
    rows = spark.range(n).select(F.concat("id", F.lit(".md")).alias("file_name"), F.lit("text").alias("content"), "id", F.lit(0).alias("session"))
    done = sessions.write(rows, str(tmp_path / "f"))
    assert done.count() == n and done.agg(F.sum("bytes")).first()[0] == 4 * n
    read = files.project(spark, str(tmp_path / "f"))
    assert read.rdd.getNumPartitions() <= 4 and read.select("path").distinct().count() == n
