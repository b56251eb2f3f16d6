"""Documents as text files: few folders, whole texts, ids as they are."""

from urllib.parse import unquote

from pyspark.sql import functions as F

from ledgerloom.sources import files

SECTION = "doc_id string, idx int, content string"


def read(spark, path):
    rows = files.text_sections(spark, f"{path}/*").select(F.regexp_extract("file_path", r"doc_id=([^/]*?)(\.md$|/)", 1).alias("id"), "content").collect()
    return sorted((unquote(unquote(r.id)), r.content) for r in rows)


def test_documents_share_folders(spark, tmp_path):
    path = tmp_path / "md"
    rows = [(str(d), i, f"{d} {i}\r\n\u00fc") for d in range(300) for i in (2, 0, 1)]
    files.write_markdown(spark.createDataFrame(rows, SECTION), str(path))
    assert sum(p.is_dir() for p in path.rglob("*")) <= 128 and sum(p.is_file() and p.suffix in (".md", ".txt") for p in path.rglob("*")) == 300
    assert read(spark, path) == sorted((str(d), "\n\n".join(f"{d} {i}\r\n\u00fc" for i in range(3)) + "\n") for d in range(300))


def test_odd_ids_and_older_files(spark, tmp_path):
    path = tmp_path / "md"
    ids = ["_x", ".y", "a/b", "a=b", "%41", "-5", "\u00e9 #?*", "__HIVE"]
    for texts in (["old", *ids], ids):
        files.write_markdown(spark.createDataFrame([(i, 0, f"text of {i}") for i in texts], SECTION), path.as_uri())
    assert read(spark, path) == sorted((i, f"text of {i}\n") for i in ids)
    files.write_markdown(spark.createDataFrame([(None, 1, "b"), (None, 0, "a")], SECTION), str(path))
    assert read(spark, path) == [("__HIVE_DEFAULT_PARTITION__", "a\n\nb\n")]
    files.write_markdown(spark.createDataFrame([], SECTION), str(path))
    assert read(spark, path) == []


def test_bytes_that_are_no_text_are_kept(spark, tmp_path):
    df = spark.sql("SELECT 1L AS doc_id, 0 AS idx, CAST(X'41FF42' AS STRING) AS content")
    files.write_markdown(df, str(tmp_path / "md"))
    (found,) = (tmp_path / "md").rglob("*.md")
    assert found.read_bytes() == b"A\xffB\n"


def test_stores_that_only_spark_opens(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.markdown.link./out", tmp_path.as_uri())
    files.write_markdown(spark.createDataFrame([("1", 1, "b"), ("1", 0, "a"), ("2", 0, "c")], SECTION), "viewfs://markdown/out/md")
    assert read(spark, "viewfs://markdown/out/md") == [("1", "a\n\nb\n"), ("2", "c\n")]


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    for i in range(2000):
        (tmp_path / f"{i}.md").write_text(f"text {i}")
    got = files.text_sections(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    found = sorted((r.file_path.rsplit("/", 1)[1], r.content) for r in got.collect())
    assert found == sorted((f"{i}.md", f"text {i}") for i in range(2000))
