"""A Merkle manifest of a dataset, and proofs for all its rows by multiproofs.

Rows are leaves; each part (source) has a tree over its leaves in ascending doc_id, and the parts' roots have a tree of
their own. Trees are built a level at a time from runs of 16 nodes. For the proofs, leaves lie in blocks of consecutive
ones. A block works out which nodes of the trees its leaves' proofs need beyond those that the leaves themselves give, asks
for them once, derives the inner nodes that its proofs share, and writes out each leaf's own proof.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 16
#: Consecutive leaves whose proofs are made together.
BLOCK = 4096
#: The tree over the parts' roots.
TOP = -1
TAMPER_STEP = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """32 bytes: SHA-256 of a row's encoded fields; ``changed`` stands in for some. A field that the table lacks counts as null."""
    own = {f: F.col(f) if f in docs.columns else F.lit(None).cast("string") for f in fields} | (changed or {})
    return F.unhex(F.sha2(F.concat(*[encoded(own[f]) for f in fields]), 256))


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Write ``rows`` in ascending order of ``keys`` (null first) with ``at``, their place from 0, and ``range``, their partition.

    Rows are dealt out by ranges of the keys, equal rows by their place in the input, so no key fills a partition. A table
    with a row a partition holds the places before each.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *[F.asc_nulls_first(k) for k in keys], "_tie")
    written = materialise(dealt.sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys], "_tie").drop("_tie").withColumn("_own", F.monotonically_increasing_id()), name)
    written = written.withColumn("range", F.shiftright("_own", 33))
    sizes = written.groupBy("range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = materialise(sizes.select("range", before.cast("long").alias("_before")), f"{name}-ranges")
    return written.join(F.broadcast(bases), "range").withColumn("at", F.col("_before") + F.col("_own").bitwiseAND(F.lit((1 << 33) - 1))).drop("_own", "_before")


def missing_nodes(held: Iterable[int], width: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes that the proofs of leaves ``held`` need of a tree with ``width`` leaves, beyond what those give: the least such set."""
    held, level = set(held), 0
    while width > 1:
        above = {i // RUN for i in held}
        for p in sorted(above):
            yield from ((level, i) for i in range(p * RUN, min(width, p * RUN + RUN)) if i not in held)
        held, level, width = above, level + 1, -(-width // RUN)


def _levels(nodes: DataFrame, width: int, name: str) -> list[DataFrame]:
    """The trees' nodes (tree, level, idx, width, digest), level by level, until each tree has one; ``width`` is the widest tree's."""
    out = [nodes.withColumn("level", F.lit(0))]
    while width > 1:
        width, level = -(-width // RUN), len(out)
        runs = out[-1].where("width > 1").groupBy("tree", F.shiftright("idx", 4).alias("idx"), F.ceil(F.col("width") / RUN).cast("long").alias("width"))
        below = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("_run"))  # RUN nodes at most
        text = F.array_join(F.transform("_run", lambda x: F.lower(F.hex(x["digest"]))), "")
        out.append(materialise(below.select("tree", "idx", "width", F.unhex(F.sha2(text, 256)).alias("digest"), F.lit(level).alias("level")), f"{name}-{level}"))
    return out


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: rows with tree, idx, width of the tree, tree_count and block; ``nodes``: all that other blocks may need; ``root`` in hex, None if there is no row."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def build(leaves: DataFrame, part: str = "source", key: str = "doc_id", block: int = BLOCK) -> Manifest:
    """The trees over ``leaves`` (part, key, digest; other columns stay).

    Leaves of a part ascend by key (null first), those that share a key by digest; rows that are equal in both are
    leaves of their own. Parts ascend bytewise, the null one first.
    """
    placed = numbered(leaves, [part, key, "digest"], "merkle-leaves")
    held = materialise(placed.groupBy("range", part).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")), "merkle-held")  # rows: ranges and parts at most
    parts = numbered(held.groupBy(part).agg(F.min("start").alias("start"), F.sum("n").alias("width")), [part], "merkle-parts").withColumnRenamed("at", "tree").drop("range")
    size = parts.agg(F.max("width"), F.count(F.lit(1))).first()
    if not size[1]:
        return Manifest(placed.withColumns({c: F.lit(0).cast("long") for c in ("tree", "idx", "width", "tree_count", "block")}), None, None)
    own = held.select("range", F.col(part).alias("_part")).join(parts.hint("merge"), F.col("_part").eqNullSafe(F.col(part))).select("range", "_part", "tree", F.col("start").alias("_start"), "width")
    on = (placed["range"] == own["range"]) & placed[part].eqNullSafe(own["_part"])  # not by part alone, which may hold most rows
    rows = placed.join(own.hint("merge"), on).select(*[placed[c] for c in leaves.columns], "at", "tree", "width", (F.col("at") - F.col("_start")).alias("idx"), F.lit(size[1]).alias("tree_count"), F.floor(F.col("at") / block).cast("long").alias("block"))
    rows = materialise(rows, "merkle-placed")
    levels = _levels(rows.select("tree", "idx", "width", "digest"), size[0], "merkle-level")
    subroots = materialise(_all(levels).where("width = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(size[1]).alias("width"), "digest"), "merkle-subroots")
    top = _levels(subroots, size[1], "merkle-top")
    first = F.col("at") - F.col("idx") % RUN
    edge = rows.where(F.floor(first / block) != F.floor((first + RUN - 1) / block)).select("tree", "idx", "width", "digest", F.lit(0).alias("level"))  # leaves whose run lies in two blocks
    return Manifest(rows, _all([edge, *levels[1:], *top]), top[-1].first()["digest"].hex())


def _needed(rows: pa.Table) -> pa.Table:
    """The coordinates (tree, level, idx) that a block asks for; rows: a tree each, with its leaves' first and last index."""
    out, block = [], rows["block"][0].as_py()
    for tree, low, high, width in zip(*(rows[c].to_pylist() for c in ("tree", "low", "high", "width")), strict=True):
        out += [(tree, level, i) for level, i in missing_nodes(range(low, high + 1), width)]
    out += [(TOP, level, i) for level, i in missing_nodes(rows["tree"].to_pylist(), rows["tree_count"][0].as_py())]
    tree, level, idx = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"block": pa.array([block] * len(out), pa.int64()), "tree": pa.array(tree, pa.int64()), "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64())})


class Forest:
    """The nodes that a block holds, as hex texts by (tree, level, index), and its leaves' paths to the root."""

    def __init__(self, fetched: dict[tuple[int, int, int], str]):
        self.nodes, self.sides, self.rest = dict(fetched), {}, {}

    def derive(self, tree: int, held: Iterable[int], width: int) -> str:
        """Fill in the inner nodes above the leaves ``held``; return the tree's root."""
        level, held, nodes = 0, set(held), self.nodes
        while width > 1:
            held = {i // RUN for i in held}
            for p in held:
                nodes[tree, level + 1, p] = _hash("".join(nodes[tree, level, i] for i in range(p * RUN, min(width, p * RUN + RUN))))
            level, width = level + 1, -(-width // RUN)
        return nodes[tree, level, 0]

    def beside(self, tree: int, level: int, i: int, width: int) -> tuple[str, str]:
        """What stands to the left and to the right of a node in its run."""
        a, b = i - i % RUN, min(width, i - i % RUN + RUN)
        return "".join(self.nodes[tree, level, j] for j in range(a, i)), "".join(self.nodes[tree, level, j] for j in range(i + 1, b))

    def above(self, tree: int, level: int, i: int, width: int, tops: int) -> list[tuple[str, str]]:
        """The pairs of ``beside`` from a node up to the root over all trees; leaves with a node in common share what lies above it."""
        at = (tree, level, i)
        if at not in self.rest:
            if width > 1:
                up = self.above(tree, level + 1, i // RUN, -(-width // RUN), tops)
                found = [self.beside(tree, level, i, width), *up]
            else:
                found = self.above(TOP, 0, tree, tops, tops) if tree != TOP else []
            if level == 0 and tree != TOP:  # a leaf's own path is used once
                return found
            self.rest[at] = found
        return self.rest[at]


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(manifest: Manifest, key: str = "doc_id") -> DataFrame:
    """For each leaf its part's root, the root, its proof's SHA-256 and the root folded from ``altered`` (null: its digest) and the proof.

    The proof is the texts of the other nodes of each run, from the leaf's up to the root, left to right; a node alone in
    its run needs none. ``verified``: the folded root is the manifest's. An empty table gives no row.
    """
    if manifest.root is None:
        return manifest.leaves.select(F.col(key).cast("long").alias("doc_id"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified")).where("false")
    root = manifest.root
    spans = manifest.leaves.groupBy("block", "tree", "width", "tree_count").agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    asked = materialise(spans.groupBy("block").applyInArrow(_needed, "block long, tree long, level int, idx long"), "merkle-asked")
    found = materialise(asked.join(manifest.nodes.select("tree", "level", "idx", "digest").hint("merge"), ["tree", "level", "idx"]), "merkle-found")

    def expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        forest = Forest({(t, level, i): d.hex() for t, level, i, d in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "idx", "digest")), strict=True)})
        rows = list(zip(*(leaves[c].to_pylist() for c in ("key", "digest", "altered", "tree", "idx", "width", "tree_count")), strict=True))
        held: dict[int, list[int]] = {}
        widths = {}
        for _, digest, _, tree, i, width, _ in rows:
            forest.nodes[tree, 0, i] = digest.hex()
            held.setdefault(tree, []).append(i)
            widths[tree] = width
        subroots = {tree: forest.derive(tree, own, widths[tree]) for tree, own in held.items()}
        forest.nodes |= {(TOP, 0, tree): digest for tree, digest in subroots.items()}
        if rows:
            forest.derive(TOP, subroots, rows[0][-1])
        out = []
        for key, digest, altered, tree, i, width, tops in rows:
            path = forest.above(tree, 0, i, width, tops)
            folded = reduce(lambda d, sides: _hash(sides[0] + d + sides[1]), path, (altered or digest).hex())
            out.append((key, digest.hex(), subroots[tree], root, _hash("".join(a + b for a, b in path)), folded, folded == root))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PROOF.split(", ")])

    leaves = manifest.leaves.select("block", F.col(key).cast("long").alias("key"), "digest", "altered", "tree", "idx", "width", "tree_count")
    return leaves.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(expand, PROOF)


def audited(docs: DataFrame, altered: dict[str, Column], where: Column, part: str = "source", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Proofs of the rows of ``docs``, folded from leaves whose fields are ``altered`` in the rows of ``where``.

    A null field is part of the leaf as such; repeated rows are leaves each; fields that the table lacks count as null,
    columns that are no fields are ignored.
    """
    changed = F.when(where, leaf_digest(docs, altered))
    own = docs.select(F.col(part).cast("string").alias(part), F.col(key).cast("long").alias(key), leaf_digest(docs).alias("digest"), changed.alias("altered"))
    return proofs(build(own, part, key, block), key)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audited(docs, {"text": F.translate("text", UPPER, LOWER)}, F.crc32(F.col("doc_id").cast("string")) % TAMPER_STEP == 0)


def _sql(levels: int = 6, top_levels: int = 4) -> str:
    """The same rows in SQL, for up to 16^levels rows a source and 16^top_levels sources."""
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    bits = "list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: CAST(i AS UBIGINT))), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))), lambda c, b: {bits}), 4294967295::UBIGINT)"
    parts = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents)",
        """p AS (SELECT r, doc_id, leaf, coalesce(altered, leaf) AS f, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER (PARTITION BY source) AS w,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)""",
        "n0 AS (SELECT s, i, w, leaf AS h FROM p)",
        "f0 AS (SELECT r, s, i, f, '' AS proof FROM p)",
    ]

    def climb(n: str, f: str, at: int, count: int) -> None:
        for k in range(at, at + count):
            parts.append(f"""q{k} AS (SELECT a.s, a.i, a.w, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS hi
  FROM {n}{k} a LEFT JOIN {n}{k} b ON a.s = b.s AND a.i // 16 = b.i // 16 AND a.i <> b.i GROUP BY a.s, a.i, a.w)""")
            parts.append(f"{n}{k + 1} AS (SELECT s, i // 16 AS i, (w + 15) // 16 AS w, CASE WHEN w = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {n}{k} GROUP BY s, i // 16, w)")
            parts.append(f"{f}{k + 1} AS (SELECT r, f.s, f.i // 16 AS i, CASE WHEN w = 1 THEN f ELSE sha256(lo || f || hi) END AS f, proof || lo || hi AS proof FROM {f}{k} f JOIN q{k} q ON f.s = q.s AND f.i = q.i)")

    climb("n", "f", 0, levels)
    last = levels + top_levels
    parts.append(f"t{levels} AS (SELECT CAST(0 AS BIGINT) AS s, s AS i, count(*) OVER () AS w, h FROM n{levels})")
    parts.append(f"g{levels} AS (SELECT r, CAST(0 AS BIGINT) AS s, s AS i, f, proof FROM f{levels})")
    climb("t", "g", levels, top_levels)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, n.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, g.f AS folded_root, g.f = t.h AS verified
FROM p JOIN g{last} g ON g.r = p.r JOIN n{levels} n ON n.s = p.s, t{last} t"""


SQL = _sql()
