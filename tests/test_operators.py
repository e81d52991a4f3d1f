"""Golden cases, properties, and the operators over files and tables."""

import json

import pytest
from pyspark.sql import functions as F

from veloria.functions import codes, jsonish, normal, text, vectors
from veloria.operators import catalog, facts, features, learning, scoring, similar, tables
from veloria.sources import contracts, files


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}").orderBy("_i").select(*cols).collect()]


def column(spark, items, f, kind="string"):
    return [r[0] for r in values(spark, [(x,) for x in items], f"x {kind}", f(F.col("x")))]


def test_names_urls_prices_keys(spark):
    assert column(spark, ["a/b:c?.", "  .. ", "x  y", "龙" * 200, None, ""], text.safe_name) == ["a_b_c_", "unknown", "x y", "龙" * 140, "unknown", "unknown"]
    assert column(spark, ["//h.com/a/B.PNG?x=1", "https://h/a.tiff", "https://h/a", "https://h/.png", "https://h/x.jpeg#f", None], text.url_suffix) == [".png", ".jpg", ".jpg", ".jpg", ".jpeg", ".jpg"]
    assert column(spark, ["直购60点券 或 3.5 荣耀积分", "活动赠送", None], text.price_text) == ["60点券 / 3.5 荣耀积分", None, None]
    assert [r[0] for r in values(spark, [(7, "x"), (12345, "x")], "n int, s string", text.source_key(F.col("n"), F.col("s")))] == ["0007-x", "12345-x"]
    assert [r[0] for r in values(spark, [("", None, "z"), ("", "", "")], "a string, b string, c string", text.first_filled(*map(F.col, "abc")))] == ["z", ""]
    assert [r[0] for r in values(spark, [(220.0, 100.0), (5.0, 0.0)], "n double, o double", text.ratio(F.col("n"), F.col("o")))] == [pytest.approx(1.2), None]
    assert column(spark, [5], lambda x: text.comparison_line(F.lit("G A-b"), x, x), "int") == ["- G A-b: 情绪溢价 5 (↓0 vs 当前皮肤)"]


def test_lenient_json(spark):
    items = ['```json\n{"a":1}\n```', 'hi {"a":1} ok', '{"a":', "", "[1]", "null", '```{"a":1}```', None]
    assert column(spark, items, lambda x: F.to_json(jsonish.lenient_json(x))) == ['{"a":1}', '{"a":1}', None, None, "[1]", None, None, None]


def test_normalisers(spark):
    one = lambda f, x: column(spark, [x], f, "double")[0]
    assert one(lambda x: normal.log_scale(x, F.lit(99.0)), 0.0) == 0 and one(lambda x: normal.log_scale(x, F.lit(99.0)), 99.0) == 1
    assert [one(lambda x: normal.log_clip(x, 730), v) for v in (-5.0, 730.0, 9999.0)] == [0, 1, 1]
    assert one(lambda x: normal.minmax(x, F.lit(3.0), F.lit(3.0)), 3.0) == 0 and one(lambda x: normal.invert_rank(x, F.lit(0.0)), 0.0) == 1
    assert column(spark, ["gacha", "?", None], lambda x: codes.mapped(x, codes.ACQUISITION_SCORES)) == [0.8, 0.0, 0.0]
    assert column(spark, ["伴生", "荣耀典藏", "x", None], lambda x: codes.code_of(x, codes.TIERS)) == [0, 5, None, None]


def scored(spark, **given):
    kinds = {f: "boolean" if f.startswith(("has_", "is_", "series_completion")) else "double" for f in features.FEATURES}
    given = {k: float(v) if kinds.get(k) == "double" else v for k, v in given.items()}
    cols = [F.lit(given.get(f)).cast(kinds[f]).alias(f) for f in features.FEATURES]
    return spark.range(1).select(F.col("id").alias("skin_id"), F.lit("m").alias("acquisition_method_score"), *cols)


def test_scorecard_goldens(spark):
    row = scored(spark, vlm_art_quality=8.5, vlm_effect_score=9, vlm_color_harmony=0.82, vlm_composition=8, official_tier=3, has_voice_pack=True, has_custom_anim=False)
    assert scoring.scorecard(row, scoring.fit(row)).first()["aesthetic"] == 79
    # missing features count as 0, which is the best for inverted normalisers
    empty = scoring.with_normals(scored(spark), scoring.fit(scored(spark))).first()
    assert empty["n_ownership_rate"] == 1 and empty["n_rerun_count"] == 1 and empty["n_vlm_art_quality"] == 0
    totals = values(spark, [(78, 92, 85, 90, 75), (95, 88, 93, 85, 90)], ", ".join(f"{d} int" for d in scoring.WEIGHTS), scoring.total_score())
    assert [t[0] for t in totals] == [84, 91]
    assert all(sum(r.weight for r in scoring.RULES if r.dimension == d) == pytest.approx(1) for d in scoring.WEIGHTS) and sum(scoring.WEIGHTS.values()) == pytest.approx(1)
    assert sorted({r.feature for r in scoring.RULES} - {"acquisition_method_score"}) == sorted(set(features.FEATURES) - set(scoring.UNSCORED) - {"acquisition_method"})
    assert [round(x, 4) for x in column(spark, [0, 50, 100, 200, 500], scoring.alpha_of, "int")] == [1.0, 0.7333, 0.6, 0.4667, 0.3333]
    assert values(spark, [(80, 0.5, 700)], "r int, m double, n int", scoring.blend(F.col("r"), F.col("m"), F.col("n"))) == [(59,)]


def test_prices_and_risks(spark):
    assert column(spark, [10.0, 30.0, 50.0, 70.0, 87.5, 88.0], lambda s: scoring.nearest_anchor(s)["score"], "double") == [0, 20, 40, 60, 80, 95]
    rows = spark.createDataFrame([(85, 3), (30, 2), (0, 0)], "total_premium int, official_tier int")
    got = [tuple(r)[2:] for r in scoring.with_prices(rows).collect()]
    assert got == [(125, 254, 0.85, 3.0), (7, 32, 0.70, 1.1), (0, 0, 0.70, 0.0)]
    cases = [(1, 131.0, 0, 100, False, 0, 50, 50), (2, 130.0, 0, 100, False, 0, 50, 50), (3, 69.0, 100, 200, False, 0, 50, 50), (4, None, 7, 100, False, 0, 50, 50), (5, 50.0, 0, 100, True, 3, 50, 50), (6, 50.0, 0, 100, True, 2, 50, 50), (7, 50.0, 0, 100, False, 0, 39, 61), (8, 50.0, 0, 100, False, 0, 40, 61), (9, 50.0, 0, 100, False, 0, 39, 60)]
    alerts = scoring.risks(spark.createDataFrame(cases, "skin_id int, official_price double, price_min int, price_max int, is_limited boolean, rerun_count int, aesthetic int, total_premium int")).collect()
    assert [(a.skin_id, a.type) for a in alerts] == [(1, "overpricing"), (3, "underpricing"), (4, "underpricing"), (5, "rerun_dilution"), (7, "aesthetic_deficit")]
    assert column(spark, [0, 19, 20, 80, 100], scoring.band, "int") == ["0-20", "0-20", "20-40", "80-100", "80-100"]


def test_vectors_and_neighbours(spark):
    pairs = values(spark, [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>", vectors.cosine(F.col("a"), F.col("b")))
    assert [p[0] for p in pairs] == [0, 0, pytest.approx(1)]
    rows = spark.createDataFrame([(i, "G", i % 3, (i * 7) % 20) for i in range(40)], "skin_id long, genre string, official_tier int, total_premium int")
    got = {(r.target_id, r.place): r.skin_id for r in similar.comparables(rows, 3).collect()}
    data = [tuple(r) for r in rows.collect()]
    for i, _, t, s in data:
        best = sorted((abs(s - x[3]), x[0]) for x in data if x[0] != i and abs(x[2] - t) <= 1)[:3]
        assert [got[i, p + 1] for p in range(3)] == [b[1] for b in best]


def test_ahp(spark):
    w = {"a": 4.0, "b": 2.0, "c": 1.0}
    rows = spark.createDataFrame([("m", i, j, w[i] / w[j]) for i in w for j in w] + [("n", "a", "a", 1.0), ("n", "b", "b", 1.0), ("n", "c", "c", 1.0), ("n", "a", "b", 9.0), ("n", "b", "a", 1 / 9), ("n", "b", "c", 9.0), ("n", "c", "b", 1 / 9), ("n", "a", "c", 1 / 9), ("n", "c", "a", 9.0)], "matrix string, i string, j string, v double")
    got = {(r.matrix, r.i): r for r in scoring.ahp_weights(rows).collect()}
    assert got["m", "a"].weight == pytest.approx(4 / 7, abs=1e-6) and abs(got["m", "a"].consistency_ratio) < 1e-6 and got["n", "a"].consistency_ratio > 0.1


def test_catalogue_files(spark, tmp_path):
    doc = {"hero-list": [{"cname": "甲", "ename": 1, "id": "x", "skinName": "p|q", "skins": ["p", "q"], "heroType": None}, {"cname": "乙", "ename": 2, "skins": []}, {"cname": "甲", "ename": 3, "skins": ["龙p"]}]}
    (tmp_path / "heroes.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1))
    heroes = files.read_catalogue(spark, str(tmp_path / "heroes.json"))
    assert heroes.count() == 3 and catalog.lookup(heroes, "cname", "甲").first()["ename"] == 3 and catalog.lookup(heroes, "cname", "?").count() == 0
    stats = catalog.totals(heroes).first()
    assert (stats.heroes, stats.skins, stats.mean_skins) == (3, 3, 1.0)
    assert {r.hero_type: r.heroes for r in catalog.type_counts(heroes).collect()} == {"未知": 3}
    assert {r.skins: r.heroes for r in catalog.skin_histogram(heroes).collect()} == {0: 1, 1: 1, 2: 1}
    assert catalog.totals(heroes.limit(0)).first()["mean_skins"] == 0
    (tmp_path / "feed.json").write_text(json.dumps({contracts.FEED_LIST: [{"pfidlb_3934": "1", "yxmclb_9965": "h", "pfmclb_7523": "s", "fmlb_4536": ""}, {"pfidlb_3934": "2"}]}))
    assert [r.source_index for r in files.read_feed(spark, str(tmp_path / "feed.json"), 1).collect()] == [1]
    assert catalog.normalise_feed(files.read_feed(spark, str(tmp_path / "feed.json"))).orderBy("source_index").first()["source_key"] == "0001-1"
    (tmp_path / "none.json").write_text("{}")
    assert files.read_feed(spark, str(tmp_path / "none.json")).count() == 0
    folder = tmp_path / "img" / "5wallpaper-bigskin"
    folder.mkdir(parents=True)
    for n in ("a-1-x.jpg", "b-1-y.JPG", "c.png"):
        (folder / n).write_bytes(b"x")
    assert sorted(tuple(r) for r in files.read_listing(spark, str(tmp_path / "img")).collect()) == [("5wallpaper-bigskin", "a-1-x.jpg"), ("5wallpaper-bigskin", "b-1-y.JPG")]
    run = {"image": "i", "prompt": "p", "results": [{"model": "m", "status": "ok", "elapsed_seconds": 1.25, "response": "{}"}, {"model": "n", "status": "missing", "hint": "h"}]}
    (tmp_path / "run.json").write_text(json.dumps(run))
    assert files.read_model_runs(spark, str(tmp_path / "run.json")).count() == 2


def test_tables_on_disk(spark, tmp_path):
    a = spark.createDataFrame([(1, "G", 5.0), (2, "H", 6.0)], "skin_id long, genre string, score double")
    files.put_features(a, str(tmp_path / "f"))
    files.put_features(a.where("genre = 'G'").withColumn("score", F.lit(7.0)), str(tmp_path / "f"))
    assert {r.skin_id: r.score for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {1: 7.0, 2: 6.0}
    files.append_cases(a, str(tmp_path / "c"))
    files.append_cases(a, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4
    files.write_json(a.withColumn("gap", F.lit(None).cast("int")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert spark.read.parquet(files.new_version(a, str(tmp_path / "v"))).count() == 2
    with pytest.raises(contracts.SchemaDrift):
        contracts.guard(a, contracts.SKINS)
    assert contracts.guard(a, a.schema) is a


def test_upserts(spark):
    old = spark.createDataFrame([(1, 1, "a", "p"), (2, 1, "b", "q")], "k int, n int, v string, path string")
    new = spark.createDataFrame([(2, 5, "c", None), (2, 6, "d", None), (3, 7, "e", "r")], "k int, n int, v string, path string")
    once = tables.upsert(old, new, ["k"], "n")
    want = [(1, 1, "a", "p"), (2, 6, "d", None), (3, 7, "e", "r")]
    assert sorted(tuple(r) for r in once.collect()) == want and sorted(tuple(r) for r in tables.upsert(once, new, ["k"], "n").collect()) == want
    assert (2, 6, "d", "q") in [tuple(r) for r in tables.upsert(old, new, ["k"], "n", keep=("path",)).collect()]
    assert {(r.k, r.change) for r in tables.difference(old, old.where("k = 1").unionByName(new.where("k = 3")), "k").collect()} == {(2, "removed"), (3, "added")}


def test_coverage_and_validation(spark):
    expected = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "b2"), ("c", "c1")], "cname string, file_name string")
    present = spark.createDataFrame([("a1",), ("a2",), ("b1",), ("z",)], "file_name string")
    assert {r.cname: r.bucket for r in catalog.coverage(expected, present).collect()} == {"a": "full", "b": "partial", "c": "none"}
    assert {r[0] for r in catalog.missing_assets(expected, present).collect()} == {"b2", "c1"} and {r[0] for r in catalog.extra_assets(expected, present).collect()} == {"z"}
    recs = spark.createDataFrame([(1, '{"cname":"a","ename":1,"id":null,"skinName":"x|y","skins":["x"],"heroType":"t"}'), (2, "{}"), (3, "not json")], "record_id int, json string")
    errors = catalog.validate_heroes(recs, "json").collect()
    assert [e.error for e in errors if e.record_id == 1] == ["count differs"] and sum(e.record_id == 2 for e in errors) == 6 and sum(e.record_id == 3 for e in errors) == 6


def test_as_of_and_gaps(spark):
    daily = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01', 5.0D), (1, DATE'2024-01-10', 7.0D) AS t(skin_id, day, price)")
    asked = spark.sql("SELECT * FROM VALUES (1, DATE'2023-12-31'), (1, DATE'2024-01-01'), (1, DATE'2024-01-09'), (2, DATE'2024-01-09') AS t(skin_id, day)")
    assert sorted(tuple(r)[2:] for r in facts.price_as_of(daily, asked).collect() if r.price is not None) == [(5.0,), (5.0,)]
    events = spark.sql("SELECT * FROM VALUES ('h', TIMESTAMP_NTZ'2024-01-01 10:00:00', 2.0D), ('h', TIMESTAMP_NTZ'2024-01-20 10:00:00', 4.0D) AS t(hero_name, ts, value)")
    assert sorted(r.index_7d for r in facts.search_index(events).collect()) == [2.0, 4.0]


def test_regression_learns(spark):
    rows = spark.range(300).select(F.col("id").alias("skin_id"), *[((F.col("id") * (i + 3)) % 17).cast("double").alias(f) for i, f in enumerate(features.FEATURES)]).withColumn("target", F.col("vlm_art_quality") / 20 + 0.1)
    model = learning.fit(rows, rounds=15, step=0.3)
    q = learning.quality(rows.withColumn("prediction", model.prediction())).first()
    assert q.rows == 300 and q.mape < 0.25 and q.r2 > 0.7
    weights = learning.dimension_weights(learning.importance(model, spark)).collect()
    assert sum(w.weight for w in weights) == pytest.approx(1)
    cold = learning.blended(rows.withColumn("total_premium", F.lit(40)), None, 10).first()
    assert cold.total_premium == 40 and cold.alpha == 1
    warm = learning.blended(rows.withColumn("total_premium", F.lit(40)), model, 300).first()
    assert warm.alpha == pytest.approx(0.2 + 0.8 / 4) and warm.total_premium == round(warm.alpha * 40 + (1 - warm.alpha) * warm.ml_based)


def test_catalogue_documents_need_their_keys_and_heroes(spark):
    whole = {k: [] for k in contracts.REQUIRED_TOP} | {"hero-list": [{"cname": "a"}]}
    cases = [(1, json.dumps(whole)), (2, json.dumps(whole | {"hero-list": []})), (3, json.dumps({"hero-list": [{}]})), (4, "not json")]
    errors = [tuple(r) for r in catalog.validate_catalogue(spark.createDataFrame(cases, "record_id int, json string"), "json").collect()]
    assert [e for e in errors if e[0] in (1, 2)] == [(2, "no heroes")]
    assert sum(e[0] == 3 for e in errors) == len(contracts.REQUIRED_TOP) - 1 and sum(e[0] == 4 for e in errors) == len(contracts.REQUIRED_TOP) + 1


def test_deduplication_tells_texts_of_one_id_apart(spark):
    from veloria.operators import clean

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "A"), (3, "c")], "doc_id int, text string")
    assert sorted(tuple(r) for r in clean.deduplicated(rows).collect()) == [(1, "a"), (1, "b"), (3, "c")]
    rows = spark.createDataFrame([(None, "aaa"), (None, "b"), (4, "B"), (None, None), (5, None)], "doc_id int, text string")
    assert sorted(map(str, map(tuple, clean.deduplicated(rows).collect()))) == sorted(map(str, [(None, "aaa"), (4, "B"), (5, None)]))
    rows = spark.createDataFrame([(0, "x"), (1, "X"), (1, "y")], "doc_id int, text string")
    assert sorted(tuple(r) for r in clean.deduplicated(rows).collect()) == [(0, "x"), (1, "y")]


def test_stream_upserts_go_on_after_a_restart(spark, tmp_path):
    import shutil

    from veloria.streaming import streams

    def land(rows, name):
        spark.createDataFrame(rows, "k int, n int").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    go = lambda: sorted(tuple(r) for r in streams.upsert_into(streams.landed(spark, f"{tmp_path}/in/*"), f"{tmp_path}/t", ["k"], "n").collect())
    land([(1, 1), (2, 1)], "a")
    assert go() == [(1, 1), (2, 1)] and go() == [(1, 1), (2, 1)]
    land([(2, 5)], "b")
    assert go() == [(1, 1), (2, 5)]
    for part in (tmp_path / "t" / "data").glob("batch-*"):
        shutil.rmtree(part)
    land([(1, 9)], "c")
    with pytest.raises(Exception):
        go()


def test_stream_upserts_touch_only_their_buckets(spark, tmp_path):
    from veloria.streaming import streams

    def land(rows, name):
        spark.createDataFrame(rows, "k int, n int").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    go = lambda at="t": dict(map(tuple, streams.upsert_into(streams.landed(spark, f"{tmp_path}/in/*", 1), f"{tmp_path}/{at}", ["k"], "n", buckets=8).collect()))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t" / "data").rglob("*.parquet")}
    land([(k, 1) for k in range(100)], "a")
    assert go() == dict.fromkeys(range(100), 1)
    first = files()
    assert len(first) == 8
    land([(5, 2), (5, 1)], "b")
    assert go()[5] == 2
    second = files()
    assert all(second[f] == t for f, t in first.items()) and len(second) == 9  # one bucket is new, the one before it stays
    land([(5, 3)], "c")
    assert go() == dict.fromkeys(range(100), 1) | {5: 3}
    third = files()
    assert len(set(first) - set(third)) == 1 and len(third) == 9  # what no manifest names is gone
    assert go() == dict.fromkeys(range(100), 1) | {5: 3} and files() == third  # nothing new, nothing written
    log = sorted(p for p in (tmp_path / "t" / "state" / "commits").iterdir() if p.name.isdigit())
    for p in (log[-1], log[-1].with_name(f".{log[-1].name}.crc")):
        p.unlink(missing_ok=True)  # as if the driver had gone down before the batch was marked as done
    assert go() == dict.fromkeys(range(100), 1) | {5: 3} and files() == third
    with pytest.raises(Exception, match="buckets"):
        streams.upsert_into(streams.landed(spark, f"{tmp_path}/in/*", 1), f"{tmp_path}/t", ["k"], "n", buckets=4)


def test_late_rows_are_counted(spark, tmp_path):
    from veloria.streaming import streams

    def land(rows, name):
        spark.createDataFrame(rows, "k int, day string").selectExpr("k", "CAST(day AS TIMESTAMP_NTZ) AS ts").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def go():
        rows = streams.counted(streams.timed(streams.landed(spark, f"{tmp_path}/in/*")))
        return sorted(r.k for r in streams.run(streams.without_repeats(rows, ["k"]), f"{tmp_path}/out").collect())

    land([(1, "2024-01-10"), (2, "2024-01-20")], "a")
    assert go() == [1, 2]
    land([(3, "2024-01-05"), (4, "2024-01-21"), (5, "2024-01-19 12:00:00")], "b")
    assert go() == [1, 2, 4, 5]
    assert sorted((r.landed, r.dropped) for r in streams.progress(spark, f"{tmp_path}/out").collect() if r.landed) == [(2, 0), (3, 1)]


def test_versions_tell_drift(spark, tmp_path):
    from pyspark.sql import types as T

    from veloria.sources import versions

    root = str(tmp_path / "t")
    kind = lambda ddl: spark.createDataFrame([], ddl).schema
    rows = lambda data, ddl: spark.createDataFrame(data, ddl)
    first = "k int, a string, n int"
    assert [tuple(r) for r in versions.upsert(rows([(1, "x", 1), (1, "y", 2)], first), root, ["k"], "n", kind(first)).collect()] == [(1, "y", 2)]
    with pytest.raises(contracts.SchemaDrift):  # the rows lack a column of the contract: nothing is written
        versions.upsert(rows([(2, 1)], "k int, n int"), root, ["k"], "n", kind(first))
    with pytest.raises(contracts.SchemaDrift):
        versions.put(rows([(2, "a", "b")], "k int, a string, n string"), root, kind(first))
    added = "k int, a string, n int, b double"
    got = versions.upsert(rows([(2, "z", 1, 0.5)], added), root, ["k"], "n", kind(added))
    assert sorted(map(tuple, got.collect())) == [(1, "y", 2, None), (2, "z", 1, 0.5)]
    lost = "k int, n int, b string"
    got = versions.upsert(rows([(3, 1, "q")], lost), root, ["k"], "n", kind(lost))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 2, None), (2, 1, "0.5"), (3, 1, "q")]
    told = {r.version: r.change for r in versions.versions(spark, root).collect()}
    assert told == {0: "first", 1: "added b", 2: "lost a; retyped b"}
    assert sorted(map(tuple, versions.read(spark, root, 1).collect())) == [(1, "y", 2, None), (2, "z", 1, 0.5)]  # the old version stays as it was
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))
    assert isinstance(versions.read(spark, root).schema, T.StructType)


def test_answers_are_parsed_once_in_many_tasks(spark):
    """The plan of the vision queries reads parsed fields from a written table of as many parts as there are shuffle partitions."""
    from veloria.plans import catalog_queries

    for name in ("quarantine", "palette"):
        plan = catalog_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "parse_json" not in plan.lower() and "ParseJson" not in plan, name
    assert catalog_queries._vision(spark, "/root/testdata/sf0.001").inputFiles().__len__() == 4


def test_peers_have_tasks_by_items(spark, monkeypatch):
    """However small the file: a task looks at so many items at most, and the pairs of a task are those of its items."""
    rows = spark.range(0, 3_000, 1, 1).select(F.col("id").alias("skin_id"), F.lit("G").alias("genre"), (F.col("id") % 50).cast("double").alias("official_price"), (F.col("id") % 3).cast("string").alias("hero_name"), F.lit(None).cast("string").alias("series"), F.lit(1).alias("official_tier"))
    whole = {tuple(r) for r in similar.peers(rows).collect()}
    monkeypatch.setattr(similar, "TASK_ITEMS", 300, raising=False)
    found = similar.peers(rows)
    assert found.rdd.getNumPartitions() == 10
    assert {tuple(r) for r in found.collect()} == whole and len(whole) == 15_000
    assert max(found.groupBy(F.spark_partition_id().alias("p")).count().collect(), key=lambda r: r["count"])["count"] < 3_000
