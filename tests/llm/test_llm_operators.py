"""The training-data operators against brute force, round trips and held-out accuracy, and on awkward rows."""

import glob
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloria.llm import ann, components, exact, html, jaccard, langid, linededup, mixing, packing, registry, simhash, tokens, warc
from veloria.llm.common import scratch_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(1000).cache()


@pytest.fixture(scope="module")
def awkward(spark):
    """Null cells, empty and long texts, ties, repeated rows and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e", "en", "x"), (1, "a b c d e", "en", "x"), (2, None, None, None), (3, "", "en", "x"), (None, "a b c d e", "fr", None), (None, None, None, None), (4, long, "en", "y"), (5, long, None, "y"), (6, " \n\t ", "de", "z"), (-7, "a b c d e", "en", "x"), (9, "x" * 5000 + " <|endoftext|> é\x01", "en", "x"), (10, "12 34 !!", "en", "x")]
    schema = "doc_id long, text string, lang string, source string"
    extra = {c: F.lit(7) for c in ("size", "target", "passes", "_digest", "_keep", "fp", "root", "base", "block", "start", "score", "line_no", "words", "_size", "_base", "taken", "sid", "_own_sha")}
    return spark.createDataFrame(rows, schema).withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def encoded(texts):
    tok = tokens.encoder(tokens.tokenizer_path()).tokenizer
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_elias_fano_selects():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 10**9, 3000), np.arange(700), np.zeros(5, int), rng.integers(0, 3, 900), np.array([2**62])):
        values = np.sort(values).astype(np.uint64)
        ef = tokens.EliasFano.from_bytes(tokens.EliasFano.of(values).to_bytes())
        assert (ef.values() == values).all()
        for i in [0, len(values) - 1, *rng.integers(0, len(values), 50).tolist()]:
            assert ef.select(i) == values[i]
    assert len(tokens.EliasFano.of(np.array([], np.uint64)).values()) == 0


def test_encoder_equals_the_tokenizer():
    texts = ["Ab <|endoftext|>x <|EndOfText|> STRASSE Größe's don't DON'T", "ﬁ Å \x01 a\x01b naïve, ÀÉ.", "x y \x1c z 12ab 3.5,,", "", "x" * 3000, "ΣΑΣ İstanbul 漢字 ​", "we'll they're,' 'tis"]
    got = tokens.encoder(tokens.tokenizer_path()).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() + [1] for g in got] == encoded(texts)


def test_token_files_round_trip(spark, docs, awkward, empty):
    for table in (docs, awkward):
        path = scratch_path(spark, "t")
        tokens.write_token_files(table, path, tokens.tokenizer_path(), block_tokens=5000)
        got = sorted(tokens.read_token_files(spark, path).collect(), key=lambda r: r.start)
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
        ids = encoded([r.text for r in rows])
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        assert [(r.doc_id, s, len(i), crc(i)) for r, s, i in zip(rows, starts.tolist(), ids)] == [tuple(r) for r in got]
    blocks = [tokens.TokenBlock(open(f, "rb").read()) for f in sorted(glob.glob(f"{path}/*.txt")) if len(open(f, "rb").read()) > 1]
    flat = [blocks[0].document(i).tolist() for i in range(blocks[0].n_docs)]
    assert flat == ids[: len(flat)]
    path = scratch_path(spark, "t")
    tokens.write_token_files(empty, path, tokens.tokenizer_path())
    assert tokens.read_token_files(spark, path).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in votes) * 2 > len(votes)) if votes else 0


def brute_components(fps):
    """fps: list of (doc_id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)].append(d)
    return [(d, f"{f:016x}", min(least[find(i)], default=None)) for i, (d, f) in enumerate(fps)]


def test_simhash_equals_brute_force(spark, docs, awkward, empty):
    for table in (docs, awkward):
        want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in table.collect()])
        got = [tuple(r) for r in simhash.near_duplicates(table).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_copies(awkward).columns == awkward.columns


@pytest.mark.parametrize("block_homes", [2, 1024])
def test_anchor_links_join_clusters(spark, block_homes):
    """Clusters of near fingerprints, dense enough to fill anchors; links join just what brute force joins."""
    rng = np.random.default_rng(3)
    values = {int(v) for v in rng.integers(0, 2**63, 40)}
    for v in list(values)[:8]:
        for _ in range(30):
            w = v
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                w ^= 1 << int(b)
            values.add(w)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in sorted(values)]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), block_homes=block_homes)
    roots = dict(components.connected_components(links).collect())
    want = brute_components([(v, v % (1 << 64)) for v in signed])
    groups, expected = defaultdict(set), defaultdict(set)
    for v, (_, _, c) in zip(signed, want):
        groups[roots.get(v, v)].add(v)
        expected[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert links.count() < 40 * len(values)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7001, 7000), (7001, 7000)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {7000: 7000, 7001: 7000}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_language_is_recognised_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_language_model(table, per_language=150)
    rows = langid.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.02 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark, awkward, empty):
    model = langid.fit_language_model(awkward)
    got = langid.identify(awkward, model)
    assert got.count() == awkward.count()
    none = got.join(awkward.select("doc_id", "text"), "doc_id").where("text IS NULL OR NOT rlike(text, '[a-zA-Z]')").collect()
    assert none and all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in none)
    assert {r.lang_pred for r in langid.identify(awkward, langid.fit_language_model(empty)).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    assert langid.drop_unknown_languages(awkward).columns == awkward.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to make it better for you and others.</div>
<article><h2>Big &amp; bold</h2><p><b>First   paragraph with
 some words<br>and more of them, quite a few in fact.<p>Short one.</p><!-- <p>hidden</p> --><aside>Aside text that is here</aside><div class="ad">Buy now, this is an advert text</div>
<p>Last a &lt; b &#233;t&eacute; and its end is near.</p><section id="comments"><p>I liked this article very much indeed, thank you for it.</p></section></article>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; us, with a long line of legal text that nobody reads</footer></body></html>"""


def test_main_text():
    tree = html.train_tree()
    x = np.array(html.labelled_blocks(), float)
    assert (tree.predict(x[:, :-1]) == x[:, -1]).all()
    got = html.main_texts([PAGE, "", "<p>a", PAGE[:900], "<" * 300 + "plain", "<div hidden>" + "no " * 30 + "</div>"], tree)
    assert got[0] == "Big & bold First paragraph with some words and more of them, quite a few in fact. Short one. Last a < b été and its end is near."
    assert got[1] == "" and got[5] == ""


def test_names_and_short_texts_of_articles():
    """What only shares a word with boilerplate is text; what is named as boilerplate goes, whatever its tag."""
    tree = html.train_tree()
    long = "A paragraph of the article that goes on for quite a while, so that it has many words in it."
    for name in ("social-history", "share-price-news", "tags-explained", "hasSidebar"):
        assert html.main_texts([f'<article><p>{long}</p><div class="{name}">Part of the text.</div></article>'], tree) == [f"{long} Part of the text."], name
    for gone in ('<p class="advert">Buy it now.</p>', '<ul><li class="comment">Nice.</li></ul>', '<ul><li class="comment"><p>Nice one.</p></ul>', '<div class="ad-box-2">Buy.</div>', '<p role="alert">Look.</p>'):
        assert html.main_texts([f"<article><p>{long}</p>{gone}<p>The end.</p></article>"], tree) == [f"{long} The end."], gone
    assert html.main_texts([f"<article><p>{long}</p><math><mi>x</mi></math><ul><li><a href=a>One source</a><li><a href=b>Two</a></ul></article>"], tree) == [f"{long} x One source Two"]
    assert html.main_texts(["<p>Hello there.</p><p>Bye now.</p>"], tree) == ["Hello there. Bye now."]
    page = f"<div>We keep small files on your machine, say yes to them or leave this page for good, it is your choice alone.</div><article><p>{long}</p><p>{long}</p></article>"
    assert html.main_texts([page], tree) == [f"{long} {long}"]
    menu = "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"
    assert html.main_texts([f"{menu}<p>Menu of things</p>{menu}<p>{long}</p><p>Short one.</p>"], tree) == [f"{long} Short one."]


def test_pages_of_unclosed_elements_take_linear_time():
    import time

    def seconds(n, page):
        began = time.process_time()
        html.text_blocks(page * n + "</iframe>")
        return time.process_time() - began

    for page in ("<p><iframe>hello</p>", "<div><svg><button>x</div>", "<object><p>y"):
        html.text_blocks(page)
        assert seconds(16_000, page) < 16 * max(0.05, seconds(2_000, page)), page


def test_pages(spark, empty):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "lorem ipsum dolor " * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = {(r.page_id, r.url): r for r in html.extract_main_text(pages).collect()}
    assert len(got) == 4 and got[2, None].text == "" and got[3, "w"].n_chars == 40_000 * 18 - 1
    assert html.extract_main_text(pages.limit(0)).count() == 0
    real = html.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").drop("url"), "page_id").collect()
    for r in real:
        inner = re.search("<article>(.*?)</article>", r.html, re.DOTALL)[1]
        assert r.text.split() == __import__("html").unescape(re.sub("<[^>]*>", " ", inner)).split()


def brute_lines(rows, t=0.8):
    """rows: (doc_id, text); returns {doc_id: removed line numbers}."""
    lines = sorted((d, i, frozenset(re.findall(r"[^\x20\x09-\x0D]+", x))) for d, text in rows for i, x in enumerate((text or "").split("\n")))
    removed, distinct = defaultdict(list), {}
    for d, i, s in lines:
        if not s:
            continue
        if s in distinct:
            removed[d].append(i)
            continue
        if any(len(s & o) >= t * len(s | o) - 1e-9 for o in distinct if min(len(s), len(o)) >= t * max(len(s), len(o)) - 1e-9):
            removed[d].append(i)
        distinct[s] = True
    return removed


def test_lines_equal_brute_force(spark, docs, awkward, empty):
    rng = np.random.default_rng(2)
    base = [[f"w{rng.zipf(1.3) % 5000}" for _ in range(n)] for n in (1, 2, 5, 5, 10, 20, 40, 200)]
    near = []
    for i in range(120):
        words = list(base[i % len(base)])
        for _ in range(rng.integers(0, 1 + len(words) // 6 + 1)):
            words[rng.integers(0, len(words))] = f"n{rng.integers(0, 40)}"
        near.append((i, "\n".join([" ".join(words), "", " ".join(rng.permutation(words))])))
    made = spark.createDataFrame(near, "doc_id long, text string")
    for table in (docs.select("doc_id", "text"), made):
        rows = [tuple(r) for r in table.collect()]
        want = brute_lines(rows)
        got = {r.doc_id: r for r in linededup.repeated_lines(table).collect()}
        assert len(got) == len(rows)
        for d, text in rows:
            assert got[d].n_lines == len((text or "").split("\n")) and list(got[d].removed_lines) == want[d], d
    assert linededup.repeated_lines(awkward).count() == awkward.count()
    assert linededup.repeated_lines(empty).count() == 0
    clash = awkward.withColumn("removed_lines", F.lit(1)).withColumn("_doc", F.lit(1))
    assert linededup.drop_repeated_lines(clash).count() == awkward.count()
    kept = {r.doc_id: r.text for r in linededup.drop_repeated_lines(made).collect()}
    assert kept[0] == "\n".join(x for i, x in enumerate(near[0][1].split("\n")) if i not in brute_lines(near)[0])


def test_lines_of_rows_that_share_a_doc_id(spark):
    """A line goes only if an earlier similar one stands in the tables, whatever else shares its doc_id."""
    words = lambda *w: " ".join(f"w{i}" for i in w)
    c, b = words(*range(10)), words(*range(9))
    a, a2 = words(*range(50, 60)), words(*range(50, 59))
    rows = [(1, c), (5, a), (5, b), (9, a2)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, list(r.removed_lines)) for r in linededup.repeated_lines(table).collect())
    assert got == [(1, []), (5, []), (5, [0]), (9, [0])]
    assert {r.text for r in linededup.drop_repeated_lines(table).where("doc_id = 5").collect()} == {a, ""}
    rows = [(None, f"{a}\nx{i}") for i in range(40)] + [(7, f"{c}\n{c}")] * 30
    got = linededup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kept = [r for r in got if r.doc_id is None and not r.removed_lines]
    assert len(got) == 70 and len(kept) == 1 and all(list(r.removed_lines) == [0] for r in got if r.doc_id is None and r.removed_lines)
    assert all(list(r.removed_lines) == [1] for r in got if r.doc_id == 7)


def test_second_semi_join_of_lines_gets_matched_entries_alone(spark):
    """Of a similar pair both sets keep the entry of a word that they share; sets that are like none keep no entry."""
    words = lambda *w: " ".join(f"w{i}" for i in w)
    texts = {1: words(*range(40)), 2: words(*range(3, 42)), 3: words(*range(100, 140)), 4: words(0, *range(200, 239)), 5: words(*range(300, 306)), 6: words(*range(300, 305))}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("__v_row", F.col("doc_id"))
    sets = linededup.line_sets(linededup.line_rows(table, linededup.rarity_levels(table), 0.8))
    rows = linededup.possible_entries(sets, 0.8).join(sets.select("sid", "doc_id"), "sid").select("doc_id", linededup._word("").alias("word")).collect()
    kept = {d: {r.word for r in rows if r.doc_id == d} for d in texts}
    assert kept[1] & kept[2] and kept[5] & kept[6] and not kept[3] and not kept[4]
    assert sorted(r.doc_id for r in linededup.repeated_lines(table.drop("__v_row")).collect() if r.removed_lines) == [2, 6]


def test_language_sample_holds_every_language(spark):
    """Few documents in many rows beside a large language, and more labels than a fixed list would hold."""
    rows = [(i % 3 + 4, "ab cd", "few") for i in range(3000)] + [(i, "xy zw", "many") for i in range(100, 3100)] + [(10_000 + i, f"t {i}", f"l{i}") for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    asked = {r.lang for r in table.where("crc32(cast(doc_id as string)) % 4 <> 2").select("lang").distinct().collect()}
    for per in (5, 50):
        sample = langid.training_sample(table, per).select("lang", "doc_id").distinct().groupBy("lang").count().collect()
        assert {r["lang"] for r in sample} == asked and all(r["count"] <= per for r in sample)


def test_exact_groups(spark, docs, awkward, empty):
    rows = [(r.doc_id, r.text or "") for r in awkward.collect()]
    got = exact.exact_groups(awkward).collect()
    assert len(got) == len(rows)
    import hashlib

    by_text = defaultdict(list)
    for d, x in rows:
        by_text[hashlib.sha256(x.encode()).hexdigest()].append(d)
    for r in got:
        own = by_text[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max((d for d in own if d is not None), default=None) and r.kept == (r.doc_id == r.keep_id)
    assert exact.drop_exact_copies(awkward).count() == len(by_text) and exact.drop_exact_copies(awkward).columns == [c for c in awkward.columns]
    assert exact.exact_groups(empty).count() == 0 and exact.drop_exact_copies(docs).count() == docs.select("text").distinct().count()


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[10], x[11], x[12] = x[0] * 2, x[0], 0
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(300, None, 1), (350, [float("nan")] * 8, 1), (400, [1.0, None] + [0.0] * 6, 1), (450, [1e38] * 8, 1), (500, [1.0, 2.0], 1), (550, [2.0, 4.0], 1), (600, [], 1), (None, [1.0] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in ann.nearest(table, tile_rows=64, query_rows=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 12)))
    vectors = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v))}
    unit = {i: v / np.abs(v).max() for i, v in vectors.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for q in (i for i in unit if i % 50 == 0):
        best = sorted((-round(float(unit[q] @ unit[c]), 12), c) for c in unit if c != q and len(unit[c]) == len(unit[q]))[:5]
        assert [(k, c, s) for k, (s, c) in enumerate([(-s, c) for s, c in best], 1)] == [(k, c, s) for k, c, s in got[q]] or [-s for s, _ in best] == pytest.approx([s for _, _, s in got[q]], abs=1e-9)
    assert [c for _, c, _ in got[0]][:2] == [10, 11] and ann.nearest(table.limit(0)).count() == 0
    dealt = ann.nearest(table, tile_rows=64, query_rows=3, group_tiles=1, sent_bytes=0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in dealt) == sorted((q, k, c) for q, rows in got.items() for k, c, _ in rows)


def test_nearest_counts_repeated_rows(spark):
    """Rows that share a vec_id are queries and candidates of their own."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.1]), (1, [1.0, 0.2]), (1, [1.0, 0.2]), (2, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted([(50, 1, 50), (50, 2, 1), (50, 3, 1), (50, 4, 2), (50, 1, 1), (50, 2, 1), (50, 3, 50), (50, 4, 2)])


def test_token_files_stand_in_the_order_of_their_numbers(spark, tmp_path):
    """Parts beyond 99999 and files beyond 999 come after those before them."""
    names = ["part-99998-u-c998.txt", "part-99998-u-c1000.txt", "part-99999-u-c000.txt", "part-100000-u-c000.txt"]
    folder = tmp_path / "part-7-x"
    folder.mkdir()
    for i, name in enumerate(names):
        (folder / name).write_bytes(tokens.pack_block([i], [np.arange(i + 1, dtype="<u4").tobytes()], True) + b"\n")
    got = sorted(tuple(r)[:3] for r in tokens.read_token_files(spark, str(folder)).collect())
    assert got == [(0, 0, 1), (1, 1, 2), (2, 3, 3), (3, 6, 4)]


def test_packing_keeps_large_ids_beside_nulls(spark):
    big = 9007199254740993
    rows = spark.createDataFrame([(big, "a b"), (None, "c"), (big, "a b")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in packing.pack_documents(rows, tokens.tokenizer_path()).collect()) == ["9007199254740993", "9007199254740993", "None"]


def test_crowded_half_fingerprints(spark):
    """Very many fingerprints with one half in common: anchors that they visit without a home there are dropped, links stay."""
    rng = np.random.default_rng(8)
    half = 0x1234ABCD
    values = sorted({int(v) << 32 | half for v in rng.integers(0, 2**31, 1500)} | {(77 << 32 | half) ^ (1 << b) for b in range(3)})
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), block_homes=64, block_visitors=200)
    roots = dict(components.connected_components(links).collect())
    want = brute_components([(v, v) for v in values])
    for v, (_, _, c) in zip(values, want):
        assert roots.get(v, v) == c


def test_warc_with_one_hot_payload(spark):
    rows = [(i, f"u{i}", "same" if i % 3 == 0 else f"p{i // 2}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    for hot_keys in (2, 20_000):
        got = {r.page_id: (r.revisit, r.refers_to) for r in warc.with_revisits(pages, hot_keys=hot_keys).collect()}
        assert got == {i: (first[h] != i, first[h] if first[h] != i else None) for i, _, h in rows}


def test_language_prediction_equals_a_plain_one(spark):
    """Text by text, gram by gram, from the same table."""
    model = langid.fit_language_model(spark.read.parquet(f"{SF}/documents.parquet"), per_language=40)
    texts = ["Hello, World 12 again", "ça va bien", "x", "12 34", ""]
    names, scores, _ = model.predict(texts)
    for t, name, score in zip(texts, names, scores):
        marks = re.sub(r"[^a-zà-ÿ]+", " ", f" {t.lower()} ")
        total, n = np.zeros(len(model.languages)), 0
        for size in langid.GRAMS:
            for i in range(len(marks) - size + 1):
                value = ord(marks[i])
                for c in marks[i + 1 : i + size]:
                    value = (value * 0x100000001B3 + ord(c)) % 2**64
                total += model.table[(value * 0x9E3779B97F4A7C15 + size) % 2**64 >> 40 & langid.BUCKETS - 1]
                n += 1
        p = langid.softmax(((total / max(n, 1) + model.bias) / model.temperature)[None])[0]
        if not any(c.isalpha() for c in t):
            assert name == "und" and score == 0
        else:
            assert name == model.languages[int(p.argmax())] and score == pytest.approx(p.max())


def check_pack(rows, ids_of, sequence):
    held = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    return held, pieces


def test_whole_packing_equals_plain_first_fit_decreasing(spark, docs):
    """Piece by piece: groups by the hash of each piece's draw, in each the longest first into the first sequence with room."""
    pieces = packing.cut_pieces(docs, tokens.tokenizer_path()).withColumn("draw", F.monotonically_increasing_id()).cache()
    rows = pieces.withColumn("g", F.pmod(F.xxhash64("draw", F.lit(17)), F.lit(5))).collect()
    want = set()
    for g in range(5):
        free: list[int] = []
        for r in sorted((r for r in rows if r.g == g), key=lambda r: (-r.length, r.doc_id is not None, r.doc_id or 0, r.start, r.ids_crc32, r.draw)):
            at = next((i for i, n in enumerate(free) if n >= r.length), None)
            if at is None:
                at = len(free)
                free.append(2048)
            want.add((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, (g << 32) + at, 2048 - free[at]))
            free[at] -= r.length
    got = packing.pack_pieces(pieces, 5).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_packing(spark, docs, awkward, empty):
    held, pieces = check_pack(packing.pack_documents(docs, tokens.tokenizer_path(), group_pieces=50).collect(), None, 2048)
    rows = docs.collect()
    for r, ids in zip(rows, encoded([r.text for r in rows])):
        assert sorted(pieces[r.doc_id, len(ids)]) == [(a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for a in range(0, len(ids), 2048)]
    total = sum(n for parts in held.values() for _, n in parts)
    assert len(held) * 2048 < 1.1 * total
    got = packing.pack_documents(awkward, tokens.tokenizer_path())
    check_pack(got.collect(), None, 2048)
    assert got.select(F.sum("length")).first()[0] == sum(map(len, encoded([r.text for r in awkward.collect()])))
    assert packing.pack_documents(empty, tokens.tokenizer_path()).count() == 0


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(4)
    tree, bins = packing.TournamentTree(100), []
    for size in rng.integers(1, 101, 500).tolist():
        want = next((i for i, b in enumerate(bins) if b + size <= 100), len(bins))
        if want == len(bins):
            bins.append(0)
        assert tree.place(size) == (want, bins[want])
        bins[want] += size


def test_warc_round_trip(spark):
    rng = np.random.default_rng(5)
    noise = [bytes(rng.integers(0, 256, 3000, dtype=np.uint8)).decode("latin-1") for _ in range(20)]
    rows = [(i, f"http://h/{i}?a=b c\r\nX: y", noise[i % 20]) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "u", "only"), (103, "u", "x" * 20_000_000), (104, "u", "<p>é漢</p>"), (104, "u", "<p>é漢</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("revisit", F.lit(1)).repartition(2)
    path = scratch_path(spark, "w")
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path, range_bytes=700).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    text = {(i): (u, (h or "")) for i, u, h in rows}
    for r in got:
        url, h = text[r.page_id]
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == warc.digest_of(h.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h] == r.page_id else ("revisit", first[h]))
        assert r.payload == (h.encode() if r.record_type == "response" else None)
    path = scratch_path(spark, "w")
    warc.write_warc(pages, path, least=10)
    assert {r.record_type for r in warc.read_warc(spark, path).collect() if r.payload_bytes < 10} == {"response"}
    path = scratch_path(spark, "w")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_range_reader_refuses_false_magic():
    member = warc.warc_record(1, "u", b"payload", None, False)
    data = b"\x1f\x8b\x08\x00junk" + member + b"\x1f\x8b\x08" + b"zz" * 50 + member
    read = lambda at, n: data[at : at + n]
    for step in (1, 7, 50, 10_000):
        found = [x for at in range(0, len(data), step) for x in warc.records_in(read, len(data), at, min(len(data), at + step))]
        assert len(found) == 2


def test_mixing(spark, docs, awkward, empty):
    for table in (docs, awkward):
        rows = mixing.mix(table).collect()
        assert len(rows) == table.count()
        per = defaultdict(lambda: [0, 0, 0.0])
        for r in rows:
            assert r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
            per[r.source][0] += r.size
            per[r.source][1] += r.taken
            per[r.source][2] = r.target
        largest = defaultdict(int)
        for r in rows:
            largest[r.source] = max(largest[r.source], r.size)
        for s, (size, taken, target) in per.items():
            assert target <= 3 * size + 1e-6 and abs(taken - target) <= largest[s]
        assert sum(x[2] for x in per.values()) == pytest.approx(sum(x[0] for x in per.values()))
        assert sorted(map(str, mixing.mix(table.repartition(5)).collect())) == sorted(map(str, rows))
    stream = mixing.mixed_documents(docs)
    assert stream.columns == docs.columns and stream.count() == sum(r.passes for r in mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(awkward.withColumn("slope", F.lit(1))).columns == [*awkward.columns, "slope"]
    assert mixing.mixed_documents(awkward).count() >= sum(r.passes > 0 for r in mixing.mix(awkward).collect())


def test_curriculum_inverts_its_integral(spark):
    slope = 0.5
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("p")).select("p", mixing.training_time(F.col("p"), F.lit(slope)).alias("t")).collect()
    for p, t in rows:
        assert t + slope * (t * t - t) == pytest.approx(p, abs=1e-12)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, map(T.Row(*names), *zip(*want.fetchall(), strict=True))))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, name):
    got = registry.queries()[name](spark, SF)
    assert got.count() > 0 and not any(isinstance(f.dataType, T.NullType) for f in got.schema)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and (docs.count() <= before or name == "mixing")
    held, pieces = check_pack(corpus_pipeline.run(spark, SF).collect(), None, 2048)
    assert {d for d, _ in pieces} == {r.doc_id for r in docs.collect()}


def edited(text, share, rng):
    """``text`` with that share of its words replaced, one at least."""
    words = text.split()
    for i in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_pipeline_drops_near_copies_of_similarity_080(spark, awkward, empty):
    """Planted near copies: groups equal brute force over all pairs at Jaccard 0.8 of five-word shingles."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(5000)}"
    bases = [" ".join(word() for _ in range(n)) for n in rng.integers(3, 300, 60)]
    texts = bases + [edited(b, s, rng) for b in bases for s in (0.0, 0.01, 0.02, 0.03)]
    texts += [edited(" ".join(f"hot{i}" for i in range(60)), 0.0, rng) for _ in range(80)] + ["", " \n", "A b", "a B", "a b c"]
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    table = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(table).collect()}
    assert got == dict(enumerate(root))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, SF).collect()} == set(root)
    stay = jaccard.drop_similar(awkward)
    assert stay.columns == awkward.columns and sorted({r.doc_id for r in stay.collect()}, key=str) == sorted({-7, 2, 4, 9, 10}, key=str)
    assert jaccard.drop_similar(empty).count() == 0


def test_pages_with_tags_left_open():
    """An omitted </head>, a self-closed svg and an unclosed button take no article text with them; what is closed stays dropped."""
    tree = html.train_tree()
    text = "This is the first long paragraph of the article, it has enough words to be seen as main text by any reader."
    article = f"<article><p>{text}</p></article>"
    pages = [
        f"<html><head><title>T</title><meta charset=utf-8><script>var a;</script><body>{article}</body></html>",
        f"<html><head><title>T</title>{article}</html>",
        f"<body><svg viewBox='0 0 1 1' />{article}</body>",
        f"<body><div><button>Go</div>{article}</body>",
        f"<body><button>Go {article}</body>",
        f"<body><select><option>a<option>b{article}</body>",
        f"<body><noscript><p>{text} no</p></noscript><svg><text>{text} no</text></svg><button><div>Go</div></button>{article}</body>",
    ]
    assert html.main_texts(pages, tree) == [text] * len(pages)


def test_lettered_texts_of_no_language_are_rejected(spark):
    """The calibrated threshold stands as it is: an unlearned language and most random letters go, held-out rows stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_language_model(table)
    rng = np.random.default_rng(0)
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10))) for _ in range(30)) for _ in range(200)]
    assert model.predict(junk)[2].mean() > 0.5
    assert model.predict(["все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью"])[2].all()
    held = table.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 AND lang IS NOT NULL").collect()
    assert held and model.predict([r.text or "" for r in held])[2].mean() < 0.02


def test_warc_joins_plain_shuffles(spark):
    """No side of the join on payloads is an aggregate, which could not be split."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = warc.with_revisits(pages)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Aggregate" not in plan


def test_near_pairs_in_blocks_and_groups(spark):
    """A crowded band cut into many blocks loses no pair of similarity 0.8, and groups of few texts verify the same pairs as brute force."""
    rng = np.random.default_rng(3)
    base = " ".join(f"w{i}" for i in range(200))
    texts = [base, *(edited(base, s, rng) for s in (0.005, 0.02, 0.05) for _ in range(8))]
    table = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], DOCS)
    nodes = jaccard._nodes(table, 5).select("node", "n", "keys", "sketch", F.struct("doc_id", "own").alias("at")).cache()
    sets = {jaccard.node_of(s): s for s in map(lambda t: jaccard.shingles(t.encode()), texts)}
    every = [(u, v) for u in sets for v in sets if u < v]
    share = lambda u, v: len(set(sets[u]) & set(sets[v])) / len(set(sets[u]) | set(sets[v]))
    want = {(u, v) for u, v in every if share(u, v) >= 0.8}
    assert 20 < len(want) < len(every)
    assert set(jaccard.near_pairs(sets, every, 0.8)) == want
    placed = nodes.select(F.explode("keys").alias("key"), "node", "n", F.col("node").alias("root"), F.lit(False).alias("end"))
    own = lambda links: sorted(tuple(r) for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    for block in (4, 1024):
        links = [tuple(r) for r in jaccard.cell_links(table, nodes, placed, 0.8, 5, block=block).collect()]
        assert {(min(p), max(p)) for p in links} <= want and own(links) == own(sorted(want))
    assert len(links) < len(want)
    pairs = spark.createDataFrame(every, "u long, v long")
    assert {tuple(r) for r in jaccard.verified(table, nodes, pairs, 0.8, 5, together=3).collect()} == want


def test_near_dedup_goes_by_simhash():
    """The fingerprint of a set is its plain SimHash; near texts share a band, and a pair's bands before one are told right."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    found = []
    for _ in range(300):
        words = list(base)
        for i in rng.choice(120, 2, replace=False):
            words[i] = f"new{rng.integers(1 << 30)}"
        a, b = (jaccard.shingles(" ".join(w).encode()) for w in (base, words))
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = np.stack([simhash.wide_fingerprint(a)]), np.stack([simhash.wide_fingerprint(b)])
        shared = np.flatnonzero(simhash.band_keys(x, 14, jaccard.BANDS)[0] == simhash.band_keys(y, 14, jaccard.BANDS)[0])
        for band in range(0, jaccard.BANDS, 7):
            assert simhash.shared_before(x ^ y, 14 << 6 | band)[0] == bool((shared < band).any())
        if similarity >= 0.8:
            found.append(len(shared) > 0)
            assert np.bitwise_count(x ^ y).sum() <= simhash.most_differing(0.8, 64 * simhash.WORDS)
    assert len(found) > 50 and np.mean(found) >= 0.98
    one = jaccard.shingles(b"a b c d e f g")
    mixed = [[int(v) for v in simhash.wide_fingerprint(one[i : i + 1])] for i in range(3)]
    for word, value in enumerate(simhash.wide_fingerprint(one).tolist()):
        assert all((value >> bit & 1) == (sum(m[word] >> bit & 1 for m in mixed) > 1) for bit in range(64))


def test_workers_keep_few_words():
    """What a worker knows of words from one task to the next is bounded in bytes, for rare and for long words, and changes no result."""
    import sys

    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(6)).encode()
    size = lambda known: sys.getsizeof(known) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in known.items())
    encoder = tokens.encoder(tokens.tokenizer_path())
    first = b" ".join(letters(i) for i in range(50))
    before, ids = jaccard.shingles(first).tolist(), encoder.encode([first])
    for at in range(0, 450_000, 5000):
        text = b" ".join(letters(i) for i in range(at, at + 5000))
        jaccard.shingles(text)
        encoder.encode([text])
    for i in range(1000):
        jaccard.shingles(b"%d" % i * 10_000)
    assert size(jaccard._words) < 16e6
    assert size(encoder) + size(encoder.old) < 64e6
    assert jaccard.shingles(first).tolist() == before and encoder.encode([first]) == ids


def test_white_space_tells_texts_of_one_doc_id_apart(spark):
    """Texts that differ in a tab alone are different texts: of their equal lines only the earliest stays, whatever doc_id they share."""
    rows = [(1, "a b c d e f"), (1, "a\tb c d e f"), (2, "a b\rc d e f"), (3, "x\ty\nx y")]
    got = [(r.doc_id, r.n_lines, list(r.removed_lines)) for r in linededup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 1, []), (1, 1, [0]), (2, 1, [0]), (3, 2, [1])]
    levels = linededup.rarity_levels(spark.createDataFrame([(1, "a b\n\na\tc")], "doc_id long, text string")).first().levels
    assert sum(v != 0 for v in levels) == 4  # a, b, c and the empty line
