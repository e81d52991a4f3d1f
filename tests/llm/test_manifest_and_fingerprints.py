"""Phrase fingerprints, centroid clusters and the Merkle manifest against plain Python, on awkward rows too."""

import hashlib
import math
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from veloria.llm import centroids, merkle, phrases

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
TEXTS = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "a b c d e"), (None, None), (4, LONG), (5, LONG), (6, " \n\t "), (-7, "é\U0001f600b" * 7), (9, "x" * 3000), (2**62, "abc"), (2**62 + 1, "abd"), (2**62 + 2, "abe")]
CROWDED = TEXTS + [(77, f"t{i} some") for i in range(150)] + [(None, f"n{i} some") for i in range(150)] + [(78, "same")] * 150


def lz(text):
    seen, node = set(), ""
    for ch in text:
        node += ch
        if node not in seen:
            seen.add(node)
            node = ""
    return seen


def edits(rows):
    """(doc_id, text, edited text, next text) in the stated order."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42)), r[1]))
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        yield d, t, t[: len(t) - k] + u[:k], u


def test_parse_is_the_plain_one_and_goes_on_from_a_cut():
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 40, 700):
        text, tail = ("".join(rng.choice("abé ") for _ in range(n)) for _ in range(2))
        p = phrases.parse(text)
        assert set(p.phrases) == lz(text) and [text[a:b] for a, b in zip([0, *p.ends[:-1]], p.ends)] == p.phrases
        for cut in {0, n // 3, n - n // 2, n}:
            whole = phrases.parse(text[:cut] + tail)
            assert sorted(phrases.reparse(p, cut, tail).tolist()) == sorted(whole.hashes.tolist())


def test_likeness_estimates_shared_phrases(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    for a, b in zip(texts, texts[1:]):
        x, y = lz(a), lz(b)
        sure = phrases.likeness(*(phrases.signature(phrases.parse(t).hashes, 10**6) for t in (a, b)), 10**6)
        assert abs(sure - len(x & y) / len(x | y)) < 1e-3  # all hashes: exact but for collisions
        assert abs(phrases.likeness(*(phrases.signature(phrases.parse(t).hashes) for t in (a, b))) - sure) < 0.2
    assert phrases.likeness(phrases.read(""), phrases.read("")) == 1.0 and phrases.likeness(phrases.read(""), phrases.read("00000001")) == 0.0
    assert phrases.written(phrases.read("0000000100000002")) == "0000000100000002"


@pytest.mark.parametrize("rows", [CROWDED, TEXTS[:1], [(None, "x")], []], ids=["crowded", "one", "null", "none"])
def test_edited_fingerprints_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("_h", "_block", "_closing", "_own", "_id", "_bucket", "fingerprint")}).repartition(3)
    want = [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), phrases.fingerprint(t), phrases.fingerprint(e), *(phrases.likeness(*map(phrases.read, map(phrases.fingerprint, (t, o)))) for o in (e, u))) for d, t, e, u in edits(rows)]
    for blocks in (None, 1, 40):
        assert sorted(map(str, map(tuple, phrases.edited_fingerprints(docs, blocks=blocks).collect()))) == sorted(map(str, want)), blocks
    plain = sorted(str((d, len(t or ""), phrases.fingerprint(t or ""))) for d, t in rows)
    assert sorted(str(tuple(r)) for r in phrases.fingerprints(docs).collect()) == plain


def test_fingerprints_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = phrases.op11_phrase_fingerprint(spark, SF).collect()
    want = {d: (hashlib.sha256(e.encode()).hexdigest(), phrases.fingerprint(e)) for d, t, e, _ in edits((r.doc_id, r.text) for r in docs.collect())}
    assert {r.doc_id: (r.edited_sha256, r.edited_fingerprint) for r in got} == want and len(got) == docs.count()
    nearer = [r.near_edited > r.near_next for r in got if r.n_chars > 200 and r.near_next < 0.9]
    assert sum(nearer) >= 0.97 * len(nearer)


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [max(-centroids.BOUND, min(centroids.BOUND, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        groups = [[] for _ in now]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        now = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, now)]
    found = [(i, *near(v)) for i, v in kept]
    return [(i, j, d, sum(y for _, y, z in found if z == j), sum(y for _, y, _ in found), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, d, j in found]


def test_clusters_equal_plain_ones(spark):
    rng = random.Random(5)
    f32 = lambda x: round(x * 256) / 256  # noqa: E731  exact in a float
    odd = [(1, [0.5] * 4), (1, [0.5] * 4), (1, [0.25] * 4), (None, [0.25] * 4), (3, None), (4, [1.0] * 3), (5, [math.nan, 0.0, 0.0, 0.0]), (6, [None, 0.0, 0.0, 0.0]), (7, [math.inf] + [0.0] * 3), (8, [2.0**120] * 4), (9, [-(2.0**120)] * 4), (10, [])]
    many = odd[:8] + [(100 + i, [f32(rng.gauss(i % 3, 0.4)) for _ in range(4)]) for i in range(150)] + [(300 + i, [0.5, 0.5, 0.5, -0.5]) for i in range(80)]
    for rows in (odd, many, odd[:1], odd[4:7], []):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cluster", "v", "vv", "distance", "c0", "n")}).repartition(3)
        got = centroids.clustered(table, clusters=5, rounds=3, dims=4, scale=64).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_clusters(rows, 5, 3, 4, 64)))


def test_clusters_stay_in_the_engine(spark):
    rows = centroids.integers(spark.read.parquet(f"{SF}/embeddings.parquet"))
    plan = rows.select(centroids.nearest_centroid(F.col("v"), F.col("vv"), [[1] * 64, [2] * 64]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, tampered):
    """Proof rows of (doc_id, source, lang, n_chars, text) tuples."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(enc, r))
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            a = i - i % 16
            yield "".join(level[a:i]), "".join(level[i + 1 : a + 16])
            i //= 16

    parts = {}
    for r in rows:
        parts.setdefault(r[1], []).append(r)
    trees = {s: tree([leaf(r) for r in sorted(own, key=lambda r: (key(r[0]), leaf(r)))]) for s, own in parts.items()}
    top = tree([trees[s][-1][0] for s in sorted(trees, key=key)])
    for at, s in enumerate(sorted(trees, key=key)):
        for i, r in enumerate(sorted(parts[s], key=lambda r: (key(r[0]), leaf(r)))):
            sides = [*path(trees[s], i), *path(top, at)]
            d = leaf(tampered(r))
            for a, b in sides:
                d = H(a, d, b)
            yield r[0], leaf(r), trees[s][-1][0], top[-1][0], H(*(x for side in sides for x in side)), d, d == top[-1][0]


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tampered(r):
    return (*r[:4], lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r


@pytest.mark.parametrize("block", [4096, 7, 16, 50])
def test_proofs_equal_plain_ones(spark, block):
    rng = random.Random(7)
    one = [(i, "hot", "en", i, f"Text É {i}") for i in range(-30, 300)]
    few = [(i, f"s{i % 40}", None, None, rng.choice([None, "", "AbC", LONG])) for i in range(60)]
    odd = [(None, None, None, None, None), (None, None, None, None, None), (5, None, "x", 1, "A"), (5, None, "x", 1, "A"), (5, None, "x", 1, "B"), (6, "", "", 0, ""), (7, "é", "", 0, "Z"), (8, "z", "", 0, "Z")]
    for rows in (one + few + odd, one, odd[:1], []):
        docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
        docs = docs.withColumns({c: F.lit(7) for c in ("at", "tree", "idx", "level", "width", "digest", "altered", "block", "range", "_own", "_tie")})
        got = merkle.audited(docs, {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, block=block).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_manifest(rows, tampered)))


def test_missing_nodes_are_the_least_set():
    rng = random.Random(11)
    for width in (1, 2, 16, 17, 300, 5000):
        held = set(rng.sample(range(width), min(width, rng.choice([1, 3, 40]))))
        asked = set(merkle.missing_nodes(held, width))
        given, level, w, above = set(), 0, width, set(held)  # what the leaves give, and what their proofs use
        used = set()
        while w > 1:
            given |= {(level, i) for i in above}
            for i in above:
                used |= {(level, j) for j in range(i - i % 16, min(w, i - i % 16 + 16)) if j != i}
            above, level, w = {i // 16 for i in above}, level + 1, -(-w // 16)
        assert asked == used - given
