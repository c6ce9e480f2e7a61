import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemill.sources import captures

SINCE = dt.datetime(2024, 1, 1)


def event(i, kind="WatchEvent"):
    return {"id": str(i), "type": kind, "created_at": "2024-08-06T10:00:00Z", "repo": {"name": f"o/r{i}"}, "payload": {}}


def put(root, source, capture, lines, folder=False):
    os.makedirs(root / source, exist_ok=True)
    if folder:
        os.makedirs(root / source / capture)
        for k, line in enumerate(lines):
            (root / source / capture / f"part-{k}").write_text(line + "\n")
        (root / source / capture / "_SUCCESS").touch()
    else:
        (root / source / capture).write_text("\n".join(lines))


def rows(df):
    return sorted((r.source, r.capture, r.file, r.at, r.body) for r in df.collect())


@pytest.fixture
def root(tmp_path):
    put(tmp_path, "a", "2024-08-06T10", ["x", "", "é 日本", "y\r"])
    put(tmp_path, "a", "2024-08-06T11", ["1", "2"], folder=True)
    put(tmp_path, "b", "2024-08-06T09", ["last line without an end"])
    put(tmp_path, "b", "_unfinished", ["no"])
    os.makedirs(tmp_path / "b" / "2024-08-06T12")
    (tmp_path / "b" / "2024-08-06T12" / "part-0").write_text("no success yet\n")
    return tmp_path


def test_batches(spark, root):
    got = rows(captures.captured(spark, str(root)))
    assert [(s, c, b) for s, c, _, _, b in got] == [("a", "2024-08-06T10", "x"), ("a", "2024-08-06T10", "é 日本"), ("a", "2024-08-06T10", "y"), ("a", "2024-08-06T11", "1"), ("a", "2024-08-06T11", "2"), ("b", "2024-08-06T09", "last line without an end")]
    assert {r.source for r in captures.captured(spark, f"file://{root}", "b").collect()} == {"b"}
    assert captures.captured(spark, str(root / "nowhere")).collect() == []
    captures.register(spark)
    for n in (1, 3, 7):
        assert rows(spark.read.format("captures").option("path", str(root)).option("splitBytes", n).load()) == got


def test_a_stream_goes_on_after_its_checkpoint(spark, root, tmp_path_factory):
    to = tmp_path_factory.mktemp("stream")

    def run():
        q = captures.captured(spark, str(root), stream=True).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/check").trigger(once=True).start()
        q.awaitTermination()
        return rows(spark.read.parquet(f"{to}/out"))

    assert run() == rows(captures.captured(spark, str(root)))
    assert run() == rows(captures.captured(spark, str(root)))
    put(root, "a", "2024-08-06T13", ["new"])
    (root / "b" / "2024-08-06T12" / "_SUCCESS").touch()
    put(root, "c", "2023-01-01", ["another source"])
    again = run()
    assert again == rows(captures.captured(spark, str(root))) and len(again) == 9
    assert run() == again


def test_dispatch_by_type(spark, tmp_path, tmp_path_factory):
    put(tmp_path, "gh-ann", "1", [json.dumps([event(1), event(2, "PushEvent")]), json.dumps([event(3, "Other")])])
    put(tmp_path, "gh-rel", "1", [json.dumps([{"id": 5, "tag_name": "v1", "html_url": "https://x/v1", "body": "b", "published_at": "2024-08-06T10:00:00Z"}])])
    put(tmp_path, "off", "1", [json.dumps([event(9)])])
    sources = [captures.Configured("gh-rel", "repo_releases", True, {"owner": "o", "repo": "r"}), captures.Configured("gh-ann", "user_events", True, {"username": "ann"}), captures.Configured("off", "user_events", False, {"username": "x"}), captures.Configured("off", "user_events", True, {}), captures.Configured("off", "unheard_of", True, {})]
    items = captures.dispatched(captures.captured(spark, str(tmp_path)), sources, SINCE)
    got = [(r.id, r.title) for r in items.orderBy("ord").collect()]
    assert got == [("github:release:5", "o/r released v1"), ("github:event:1", "ann starred o/r1"), ("github:event:2", "ann pushed 0 commit(s) to o/r2")]
    to = tmp_path_factory.mktemp("items")
    q = captures.dispatched(captures.captured(spark, str(tmp_path), stream=True), sources, SINCE).drop("metadata", "profile").writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/check").trigger(once=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{to}/out").collect()) == sorted(i for i, _ in got)
    assert captures.dispatched(captures.captured(spark, str(tmp_path)), sources[2:], SINCE) is None


def test_plugins_are_registered_once(spark, tmp_path):
    put(tmp_path, "lines", "1", ["hello"])

    @captures.plugin("test_lines", "author")
    def lines(raw, since):
        from tidemill.sources.common import item

        none = F.lit(None).cast("string")
        return raw.select(*item("rss", "line", F.col("ord").cast("string"), title=F.col("body"), url=none, content=none, author=F.col("author"), published=F.lit(since), meta=F.create_map().cast("map<string,string>"), order=F.col("ord")))

    got = captures.dispatched(captures.captured(spark, str(tmp_path)), [captures.Configured("lines", "test_lines", True, {"author": "me"})], SINCE).collect()
    assert [(r.title, r.author) for r in got] == [("hello", "me")]
    with pytest.raises(ValueError):
        captures.plugin("test_lines")(lines)
    del captures.PLUGINS["test_lines"]
