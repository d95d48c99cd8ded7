"""Files as a data source, and addresses that fail at first."""

import os
import threading
import time
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from corpusmill.sources import datasource, loaders


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "sub").mkdir()
    for i, (name, text) in enumerate({"a.md": "# A", "sub/b.csv": "1,2", "c.bin": "no", "d.json": '{"k":"v"}', "e.txt": " té ", "_hidden.txt": "x", "sub/z.TXT": ""}.items()):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, ns=(i * 10**9, i * 10**9))
    return tmp_path


def names(df):
    return [r["source_path"].rsplit("/", 1)[1] for r in df.collect()]


def test_files(spark, folder):
    df = spark.read.format("text_files").option("partition_bytes", 5).load(str(folder))
    rows = {r["source_path"].rsplit("/", 1)[1]: (r["mime_type"], r["content"], r["length"], r["modified"].timestamp()) for r in df.collect()}
    assert rows["e.txt"] == ("text/plain", " té ", 5, 4.0) and rows["z.TXT"] == ("text/plain", "", 0, 6.0) and rows["c.bin"][0] == "unknown"
    assert set(rows) == {"a.md", "b.csv", "c.bin", "d.json", "e.txt", "z.TXT"} and df.rdd.getNumPartitions() > 2
    assert spark.read.format("text_files").load(f"file://{folder}").count() == 6
    (folder / "none").mkdir()
    assert spark.read.format("text_files").load(str(folder / "none")).isEmpty()
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("text_files").load().collect()


def test_pushed_filters_open_no_other_file(spark, folder):
    df = spark.read.format("text_files").load(str(folder))
    assert names(df.where("mime_type = 'text/csv'")) == ["b.csv"]
    assert sorted(names(df.where(F.col("mime_type").isin("text/csv", "text/plain") & F.col("source_path").startswith(f"{folder}/sub")))) == ["b.csv", "z.TXT"]
    assert names(df.where(F.col("source_path") == f"{folder}/e.txt").where("length > 2")) == ["e.txt"]
    # the source keeps the condition to itself, and its partitions hold no other file
    plan = df.where("mime_type = 'text/csv'")._jdf.queryExecution().executedPlan().toString()
    assert "text/csv" not in plan
    reader, longer = datasource._Reader(str(folder), 1 << 20), GreaterThan(("length",), 1)
    assert list(reader.pushFilters([EqualTo(("mime_type",), "text/csv"), longer])) == [longer]
    assert [f.path for p in reader.partitions() for f in p.files] == [f"{folder}/sub/b.csv"]


def test_stream_of_files(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")

    def run():
        q = spark.readStream.format("text_files").load(str(folder)).select("source_path", "content").writeStream.format("parquet").option("path", str(out / "data"))
        q.option("checkpointLocation", str(out / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(names(spark.read.parquet(str(out / "data"))))

    first = run()
    assert first == ["a.md", "b.csv", "c.bin", "d.json", "e.txt", "z.TXT"] and run() == first
    (folder / "new.txt").write_text("n")
    assert run() == sorted([*first, "new.txt"])


def test_addresses_are_asked_again():
    calls, waits = [], []

    def get(url):
        calls.append(url)
        if url == "refused":
            raise HTTPError(url, 404, "no", {}, None)
        if len(calls) < 3:
            raise HTTPError(url, 503, "later", {}, None)
        return "text", "text/plain"

    assert loaders.persistent(get, 3, 0.5, waits.append)("u") == ("text", "text/plain") and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        loaders.persistent(get, 3, 0.5, waits.append)("refused")
    assert calls == ["u", "u", "u", "refused"]


def test_addresses_are_fetched_side_by_side(spark):
    def get(url):
        time.sleep(0.3)
        return f"{url} {threading.active_count() > 2}", "text/plain"

    df = spark.createDataFrame([(f"u{i}",) for i in range(12)], "url string").coalesce(1)
    rows = loaders.load_urls(df, get=get, at_once=6).collect()
    assert [r["url"] for r in rows] == [f"u{i}" for i in range(12)] and all(r["content"].startswith(r["url"]) for r in rows) and any("True" in r["content"] for r in rows)
