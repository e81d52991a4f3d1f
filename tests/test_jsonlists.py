"""Documents cut by byte ranges against the plain parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veloria.operators import catalog
from veloria.sources import contracts, files, jsonlists

ODD = ['a}b', "{[", ']}"', 'x\\"}', "\\", '\\\\"', '","k":[{', "", "é 🙂 }", "}\n{", '"wanted":[{']


def entries(n, seed):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        e = {"id": i, "text": rng.choice(ODD) + rng.choice(ODD), rng.choice(ODD) + "k": rng.choice([None, 1.5, True, [], [1, {"a": rng.choice(ODD)}], {"b": {"c": [{}]}}])}
        made.append({} if i % 17 == 3 else e)
    return made


def read(spark, path, key="wanted"):
    rows = jsonlists.read_json_list(spark, path, key).select(F.col("file"), "pos", F.to_json("entry").alias("j")).collect()
    return sorted((r.file.rsplit("/", 1)[-1], r.pos, json.dumps(json.loads(r.j), sort_keys=True)) for r in rows)


@pytest.mark.parametrize("indent", [None, 2])
def test_lists_of_large_documents(spark, tmp_path, indent):
    documents = {
        "a.json": {"n": 1, "other": entries(40, 1), "wanted": entries(400, 2), "more": {"x": [{"y": 1}]}, "last": entries(3, 3)},
        "b.json": {"wanted": entries(90, 4)},
        "c.json": {"text": '"wanted":[{', "empty": [], "wanted": entries(1, 5), "z": None},
        "d.json": {"other": entries(5, 6)}, "e.json": {"wanted": []}, "f.json": {}, "g.json": {"wanted": None, "x": {"wanted": 1}},
    }
    for name, d in documents.items():
        (tmp_path / name).write_text(json.dumps(d, indent=indent, ensure_ascii=name == "a.json"), encoding="utf-8")
    want = sorted((name, i, json.dumps(e, sort_keys=True)) for name, d in documents.items() for i, e in enumerate(d.get("wanted") or []))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(f"{tmp_path}/a.json").rdd.getNumPartitions() > 5
        assert read(spark, str(tmp_path)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert read(spark, str(tmp_path)) == want


def test_feed_entries_keep_what_was_landed(spark, tmp_path):
    feed = [{"pfidlb_3934": "1", "pfpzlb_3289": None, "new": {"a": [1, None]}, "hqfs_8609": "1788点券"}, {"pfidlb_3934": "2", "pfpzlb_3289": "", "fmb1lb_5300": "//x/y.png"}]
    (tmp_path / "feed.json").write_text(json.dumps({contracts.FEED_LIST: feed}), encoding="utf-8")
    rows = catalog.normalise_feed(files.read_feed(spark, f"{tmp_path}/feed.json")).orderBy("source_index").collect()
    assert [(r.quality, r.acquire_method, r.price_text, r.image_url, r.intro) for r in rows] == [(None, "1788点券", "1788点券", "", ""), ("", "", None, "//x/y.png", "")]
    assert [json.loads(r.raw_json) for r in rows] == feed
