"""The data sources on files that are whole, split, broken and empty, and on every way that paging ends."""

import json

from pyspark.sql import functions as F

from feedloom.sources import documents
from feedloom.sources.readers import HarFiles, PagedFiles


def har(n):
    entry = lambda i: {"request": {"method": "get", "url": f"https://x/{i}", "headers": []}, "response": {"status": 200, "content": {"mimeType": "application/json", "text": json.dumps([{"title": f'}} "{i}" ]', "n": i}])}}}
    return json.dumps({"log": {"version": "1.2", "entries": [entry(i) for i in range(n)]}}, indent=1)


def test_har_files(spark, tmp_path):
    spark.dataSource.register(HarFiles)
    for name, text in {"a.har": har(50), "b.har": har(1), "c.har": har(0), "d.har": har(3)[:-200], "e.har": "{}"}.items():
        (tmp_path / name).write_text(text)
    for split in ("64", "0.001"):
        read = spark.read.format("har_files").option("path", str(tmp_path)).option("split_mb", split).load()
        got = [(r["file"][-5:], r["entry"], r["error"]) for r in read.collect()]
        assert sorted(x[1] for x in got if x[0] == "a.har") == list(range(50)) and [x[1] for x in got if x[0] == "b.har"] == [0]
        assert {x[2] for x in got if x[0] == "d.har"} == {None, "could not parse"} and [x for x in got if x[0] == "e.har"] == [("e.har", None, "no entries")]
        assert not [x for x in got if x[0] == "c.har"]
        assert read.rdd.getNumPartitions() == (1 if split == "64" else read.rdd.getNumPartitions()) and (split == "64" or read.rdd.getNumPartitions() > 8)
    columns = spark.createDataFrame([("a", har(50))], "file string, har string")
    want = documents.har_captures(columns, "file").select("ord", "method", "url", "status", "content_type", "body")
    have = documents.entry_captures(read.where(F.col("file").endswith("a.har"))).select(*want.columns)
    assert sorted(have.collect()) == sorted(want.collect())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = spark.read.format("har_files").option("path", str(tmp_path)).option("push_filters", "true").load().where(F.col("file") == f"{tmp_path}/b.har")
        assert one.count() == 1 and one.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_paged_files(spark, tmp_path):
    spark.dataSource.register(PagedFiles)
    page = lambda n, **more: json.dumps({"items": [{"n": i} for i in range(n)], **more})
    answers = {
        "short/1": page(3), "short/2": page(2), "short/3": page(3), "offset/0": page(3), "offset/3": page(3), "offset/6": page(0),
        "cursor/first": page(1, next="b"), "cursor/b": page(1, next=""), "cursor/c": page(1), "more/1": page(2, more=True), "more/2": page(2, more=False), "more/3": page(2),
        "total/1": page(2, total=2), "total/2": page(2, total=2), "total/3": page(2), "most/1": page(4), "most/2": page(4), "most/3": page(4), "broken/1": "{", "climb/first": page(1, next="../short/1"),
    }
    for at, text in answers.items():
        (tmp_path / "r" / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / f"{at}.json").write_text(text)
    configs = [
        {"config_id": "short", "per_page": 3}, {"config_id": "offset", "kind": "offset", "per_page": 3}, {"config_id": "cursor", "kind": "cursor"}, {"config_id": "more", "has_more": "more"},
        {"config_id": "total", "total_pages": "total"}, {"config_id": "most", "max_items": 6}, {"config_id": "broken"}, {"config_id": "absent"}, {"config_id": "climb", "kind": "cursor"}, {"config_id": "one", "max_pages": 1},
    ]
    (tmp_path / "r" / "one").mkdir()
    (tmp_path / "r" / "one" / "1.json").write_text(page(2))
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"item_path": "items", "max_pages": 9} | c) for c in configs))
    read = spark.read.format("paged_files").option("configs", str(tmp_path / "c.jsonl")).option("responses", str(tmp_path / "r")).option("per_task", 3).load()
    got = {r["config_id"]: r["n"] for r in read.where("error is null").groupBy("config_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"short": 5, "offset": 6, "cursor": 2, "more": 4, "total": 4, "most": 6, "climb": 1, "one": 2}
    assert {r["config_id"] for r in read.where("error = 'no items'").collect()} == {"broken", "absent"}
    assert read.rdd.getNumPartitions() == 4


def test_lines_of_many_documents(spark, tmp_path):
    """Many HAR documents or paged answers to a file: each line is read once, however the ranges of the tasks fall."""
    spark.dataSource.register(HarFiles)
    spark.dataSource.register(PagedFiles)
    flat = lambda n: json.dumps(json.loads(har(n)))
    (tmp_path / "hars").mkdir()
    (tmp_path / "hars" / "one.txt").write_text("".join(f"é{k}\t{flat(k % 4)}\n" for k in range(40)) + f"last\t{flat(2)}")
    (tmp_path / "hars" / "two.txt").write_text("broken\t{\n")
    (tmp_path / "hars" / "none.txt").write_text("")
    want = sorted((f"é{k}", i) for k in range(40) for i in range(k % 4)) + [("last", 0), ("last", 1)]
    (tmp_path / "pages").mkdir()
    pages = [{"config_id": f"c{k}", "item_path": "d", "start": 0, "per_page": 2, "max_pages": 9, "pages": {str(p): json.dumps({"d": [{"i": 2 * p}, {"i": 2 * p + 1}][: k - 2 * p]}) for p in range(4)} if k else {}} for k in range(7)]
    (tmp_path / "pages" / "x.json").write_text("".join(json.dumps(p) + "\n" for p in pages))
    for split in ("64", "0.0005"):
        got = spark.read.format("har_files").option("path", str(tmp_path / "hars")).option("named_lines", True).option("split_mb", split).load().collect()
        assert sorted((r["file"], r["entry"]) for r in got if r["error"] is None) == sorted(want) and [r["file"] for r in got if r["error"]] == ["broken"]
        rows = spark.read.format("paged_files").option("lines", str(tmp_path / "pages")).option("split_mb", split).load().collect()
        assert [r["config_id"] for r in rows if r["error"]] == ["c0"]
        assert sorted((r["config_id"], json.loads(r["raw"])["i"]) for r in rows if not r["error"]) == [(f"c{k}", i) for k in range(7) for i in range(k)]
