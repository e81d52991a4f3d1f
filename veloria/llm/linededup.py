"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line's set are the distinct words in it. A line is removed if an earlier line, by (doc_id, line number), has a set whose
Jaccard similarity to its own is ``threshold`` or more.

1. Rarity: words are counted in 2^18 hash buckets over all texts; a bucket's rounded logarithm is its words' rarity. The
   levels are one row, which the next step reads as a scalar subquery.
2. One pass cuts all lines into words, orders them by (rarity, hash), and writes the first n - ceil(threshold n) + 1 of them, the
   prefix: similar sets share a word of their prefixes. Equal sets fall together by two 64-bit digests of their words' 64-bit
   hashes; the earliest line stands for them. Sets of up to three words are similar to equal ones alone.
3. A semi join on prefix words leaves the entries (set, word) that have a possible partner by a 64-bit parity sketch (each
   differing bit needs a word in which the sets differ), by length and by the words' places in the sets. No pairs are listed.
   Both sets of a similar pair keep their entry of the first word that they share.
4. Only for the sets of those entries the lines are fetched. A set is verified, on the words themselves, with the earliest set
   that has an entry of one of its words, and where that one is not similar, with every earlier one in a second semi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

THRESHOLD = 0.8
BUCKETS = 1 << 18
SENT_LINES = 1_000_000
#: Sizes and places beyond these count as these in the first look-up, which only makes its filters weaker.
_MOST_WORDS, _MOST_PLACE = (1 << 18) - 1, (1 << 14) - 1


def _text() -> Column:
    """The text with a space for each other character that parts words, except the newline that parts lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    odd = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    return F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _own() -> Column:
    """What tells a text from others of its doc_id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _cut(line: Column) -> Column:
    """The line's words in order; runs of spaces leave empty ones. One plain character parts faster than a pattern."""
    return F.split(line, " ", -1)


def _how(rows: int) -> str:
    """The strategy of a join with a written table of so many rows of a few numbers each."""
    return "broadcast" if rows <= SENT_LINES else "merge"


def _bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity_levels(docs: DataFrame) -> DataFrame:
    """One row (levels): for each bucket four times the binary logarithm of the number of words that fell in it, in the upper byte."""
    # cut at once: lines of their own would be copied and decoded once more
    words = docs.select(F.explode(_cut(F.replace(_text(), F.lit("\n"), F.lit(" ")))).alias("word"))
    counts = words.groupBy(_bucket(F.xxhash64("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.select(F.col("bucket").cast("long").alias("bucket"), F.least(F.lit(127), F.round(F.log2("n") * 4) + 1).cast("tinyint").alias("level")), "rarity-counts")
    every = docs.sparkSession.range(BUCKETS).join(counts.hint("merge"), F.col("id") == F.col("bucket"), "left").select("id", F.coalesce("level", F.lit(0).cast("tinyint")).alias("level"))
    row = every.agg(F.sort_array(F.collect_list(F.struct("id", "level"))).alias("all"))
    return materialise(row.select(F.transform("all", lambda x: F.shiftleft(x["level"].cast("long"), 56)).alias("levels")), "rarity-levels")


def _shared(a: Column, b: Column, t: float) -> Column:
    """The number of words that sets of a and b words must share for a similarity of t, not rounded up."""
    return (a + b) * F.lit(t / (1 + t)) - F.lit(1e-9)


def _needed(a: Column, b: Column, t: float) -> Column:
    """Words that sets of a and b words must share for a similarity of t."""
    return F.ceil(_shared(a, b, t))


def _prefix(n: Column, t: float) -> Column:
    return (n - F.ceil(n * F.lit(t) - F.lit(1e-9)) + 1).cast("int")


def _sketch(words: Column) -> Column:
    """A 64-bit word in which each set bit says that an odd number of words chose it. A shift looks at six bits of its distance."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(w, 33).cast("int"))))


def _half_sketch(hashes: Column) -> Column:
    """The same bits by about half of the words alone; these are the hashes before a rarity has shifted them by a byte."""
    one = lambda h: F.call_function("shiftleft", F.shiftright(h, 35).bitwiseAND(F.lit(1)), F.shiftrightunsigned(h, 41).cast("int"))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(one(h)))


def _hashes(line: Column) -> Column:
    """The hashes of a line's distinct words."""
    return F.array_except(F.transform(_cut(line), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def line_rows(docs: DataFrame, levels: DataFrame, t: float) -> DataFrame:
    """One row per line: the text's __v_row, doc_id, hash own, line_no, the set's digests a and b, size n, sketch and prefix (32 bits of each hash)."""
    # hashed below the generator: beside it a text would be hashed once a line
    rows = docs.select("__v_row", F.col("doc_id").cast("long").alias("doc_id"), _own().alias("own"), _text().alias("text"))
    rows = rows.select("__v_row", "doc_id", "own", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = rows.select("__v_row", "doc_id", "own", "line_no", _hashes(F.col("line")).alias("hashes"), levels.scalar().alias("levels"))
    # the rarity takes the place of the upper byte; without nulls the sort is one of plain numbers
    ranked = F.transform("hashes", lambda h: F.coalesce(F.get(F.col("levels"), _bucket(h)), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 8)))
    rows = rows.select("__v_row", "doc_id", "own", "line_no", F.sort_array(ranked).alias("words"))
    rows = rows.select("__v_row", "doc_id", "own", "line_no", "words", F.size("words").alias("n"))
    prefix = F.transform(F.slice("words", 1, _prefix(F.col("n"), t)), lambda w: F.shiftright(F.shiftleft(w, 32), 32).cast("int"))
    rows = rows.select("__v_row", "doc_id", "own", "line_no", F.xxhash64("words").alias("a"), F.xxhash64(F.lit(7), "words").alias("b"), "n", _sketch(F.col("words")).alias("sketch"), prefix.alias("prefix"))
    return materialise(rows, "line-rows")


def line_sets(rows: DataFrame) -> DataFrame:
    """One row per distinct set with words: its earliest line (by doc_id, line number, hash of its text), size n, sketch and prefix."""
    sets = rows.where("n > 0").groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no", "own", "n", "sketch", "prefix")).alias("line")).select("line.*")
    return materialise(sets.withColumn("sid", F.monotonically_increasing_id()), "line-sets")


def _near(n: Column, m: Column, place: Column, other: Column, bits: Column, t: float) -> Column:
    """Sketches, lengths and places allow the similarity. Each word in which the sets differ changes one bit, so ``bits`` is even with n + m."""
    shared = _shared(n, m, t)
    # the first test meets all pairs: one product, what n + m less twice ``shared`` comes to
    return (bits <= (n + m) * F.lit((1 - t) / (1 + t)) + F.lit(1e-8)) & (m >= n * F.lit(t) - F.lit(1e-9)) & (n >= m * F.lit(t) - F.lit(1e-9)) & (n - place >= shared) & (m - other >= shared)


def _word(side: str) -> Column:
    return F.shiftright(F.col(f"{side}entry"), 32)


def _place(side: str) -> Column:
    return F.col(f"{side}entry").bitwiseAND(F.lit(_MOST_PLACE))


def possible_entries(sets: DataFrame, t: float) -> DataFrame:
    """(sid, entry) of every entry that may be shared with a similar set. An entry is a word with the set's size and its place, in one number."""
    entries = sets.where(_needed(F.col("n"), F.col("n") + 1, t) <= F.col("n"))
    entries = entries.select("sid", "sketch", F.least(F.col("n"), F.lit(_MOST_WORDS)).cast("long").alias("n"), F.posexplode("prefix").alias("place", "word"))
    entry = F.shiftleft(F.col("word").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("n"), 14)).bitwiseOR(F.least(F.col("place"), F.lit(_MOST_PLACE)).cast("long"))
    entries = entries.select(entry.alias("entry"), "sid", "sketch")
    size = lambda side: F.shiftright(F.col(f"{side}entry"), 14).bitwiseAND(F.lit(_MOST_WORDS))
    near = _near(size("x."), size("y."), _place("x."), _place("y."), F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))), t)
    near = (_word("x.") == _word("y.")) & near & (F.col("x.sid") != F.col("y.sid"))
    return entries.alias("x").join(entries.alias("y").hint("merge"), near, "left_semi").select("sid", "entry")


def _lines_of(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(sid, at, n, line, s0, s1) of the sets in ``held``: the line itself and its sketches by either half of the words.

    Each text is cut into lines once more, but only the lines asked for into words.
    """
    found = F.struct("line_no", "sid", "n", "sketch")
    by_doc = materialise(held.groupBy(F.col("doc_id").alias("_doc"), F.col("own").alias("_own")).agg(F.collect_list(found).alias("_found")), "possible-documents")
    size = by_doc.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_found")), F.lit(0))).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _own().alias("own"), "text")
    rows = rows.join(by_doc.hint(_how(max(size))), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own")))
    # as a generator's output the lines are cut once a text and not again for each of those found
    rows = rows.select("doc_id", "own", "_found", F.explode(F.array(F.split(_text(), "\n", -1))).alias("lines"))
    line = lambda f: F.struct(f["line_no"].alias("line_no"), f["sid"].alias("sid"), f["n"].alias("n"), f["sketch"].alias("sketch"), F.coalesce(F.get(F.col("lines"), f["line_no"]), F.lit("")).alias("line"))
    rows = rows.select("doc_id", "own", F.inline(F.transform("_found", line)))
    rows = rows.select("sid", F.struct("doc_id", "line_no", "own").alias("at"), "n", "line", "sketch", _half_sketch(_hashes(F.col("line"))).alias("s1"))
    return rows.select("sid", "at", "n", "line", F.col("sketch").bitwiseXOR(F.col("s1")).alias("s0"), "s1")


def _counted(lines: DataFrame) -> DataFrame:
    """``lines`` with the number m of a line's distinct words; as it can't be null, no test for nulls counts the lines below a join."""
    return lines.withColumn("m", F.coalesce(F.size(F.array_remove(F.array_distinct(_cut(F.col("line"))), "")), F.lit(0)))


def removed_sets(docs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """sid of every set that has an earlier similar one."""
    matched = materialise(possible_entries(sets, t), "possible-entries")
    possible = materialise(matched.select("sid").distinct(), "possible-lines")
    held = materialise(sets.drop("prefix").join(possible.hint(_how(possible.count())), "sid", "left_semi"), "possible-sets")
    lines = materialise(_lines_of(docs, held), "possible-words")
    if lines.count() > held.count():  # rows that repeat doc_id and text give a set's line once each
        lines = materialise(lines.groupBy("sid").agg(*[F.min(c).alias(c) for c in lines.columns if c != "sid"]), "distinct-words")
    entries = matched.select("sid", _word("").alias("word"), _place("").alias("place"))
    entries = materialise(entries.join(lines.drop("line").hint("merge"), "sid"), "possible-sketches")
    lines = lines.select("sid", "line")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    near = _near(x("n"), y("n"), x("place"), y("place"), sum(F.bit_count(x(s).bitwiseXOR(y(s))) for s in ("s0", "s1")), t)
    near = (x("word") == y("word")) & (x("sid") != y("sid")) & near & (y("at") < x("at"))  # with sid on both sides one exchange serves both
    later = materialise(entries.alias("x").join(entries.alias("y").hint("merge"), near, "left_semi"), "later-lines")
    # an earlier set of one of its words, the first, is the partner of most: verify that one alone
    asked = materialise(later.select("word").distinct(), "later-words")
    heads = entries.join(asked.hint(_how(asked.count())), "word", "left_semi").groupBy("word").agg(F.min(F.struct("at", "sid", "n", "s0", "s1", "place")).alias("head")).select("word", "head.*")
    tried = later.alias("x").join(materialise(heads, "first-lines").alias("y").hint("merge"), near)
    tried = tried.groupBy(x("sid").alias("sid")).agg(F.min(F.struct(y("at").alias("at"), y("sid").alias("sid"))).alias("y")).select("sid", F.col("y.sid").alias("partner"))
    tried = materialise(tried, "tried-lines")
    alike = lambda a, b: F.size(F.array_remove(F.array_intersect(_cut(a("line")), _cut(b("line"))), "")) >= _needed(a("m"), b("m"), t)
    how = _how(tried.count())
    own = _counted(lines.join(tried.hint(how), "sid"))
    other = _counted(lines.select(F.col("sid").alias("partner"), "line").join(tried.select("partner").distinct().hint(how), "partner", "left_semi"))
    both = own.select("sid", "partner", F.struct("m", "line").alias("x")).join(other.select("partner", F.struct("m", "line").alias("y")).hint("merge"), "partner")
    found = materialise(both.where(alike(x, y)).select("sid").distinct(), "verified-lines")
    # the others are compared with every earlier set that shares a prefix word
    rest = materialise(later.join(found.hint(_how(found.count())), "sid", "left_anti"), "unverified-lines")
    asked = materialise(rest.select("word").distinct(), "unverified-words")
    partners = entries.join(asked.hint(_how(asked.count())), "word", "left_semi").alias("y")
    partners = materialise(partners.join(rest.alias("x").hint("merge"), near, "left_semi"), "unverified-partners")
    with_line = lambda e: _counted(e.join(lines.hint("merge"), "sid"))
    more = with_line(rest).alias("x").join(with_line(partners).alias("y").hint("merge"), near & alike(x, y), "left_semi").select("sid")
    return found.unionAll(more).distinct()


def _by_row(docs: DataFrame, threshold: float) -> DataFrame:
    """(__v_row, doc_id, n_lines, removed_lines) for every row of ``docs``, which has the row's number in __v_row."""
    rows = line_rows(docs, rarity_levels(docs), threshold)
    sets = line_sets(rows)
    removed = materialise(removed_sets(docs, sets, threshold), "removed-lines")
    kept = sets.select("sid", "doc_id", "own", "line_no").join(removed.hint(_how(removed.count())), "sid", "left_anti")
    kept = materialise(kept.groupBy(F.col("doc_id").alias("_doc"), F.col("own").alias("_own")).agg(F.collect_list("line_no").alias("_kept")), "kept-lines")
    texts = rows.groupBy("__v_row").agg(F.max("doc_id").alias("doc_id"), F.max("own").alias("own"), F.count(F.lit(1)).alias("n_lines"), F.collect_list(F.when(F.col("n") > 0, F.col("line_no"))).alias("_worded"))
    joined = materialise(texts, "worded-lines").join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own")), "left")
    gone = F.sort_array(F.array_except("_worded", F.coalesce("_kept", F.array().cast("array<int>"))))
    return joined.select("__v_row", "doc_id", "n_lines", gone.alias("removed_lines"))


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, removed_lines) for every row of ``docs``; removed_lines are line numbers from 0, ascending.

    Lines end at newlines. Lines without words are never removed; null texts are one empty line. A place (doc_id, line
    number, text) keeps its line if it is the earliest of a set without an earlier similar one; places go by doc_id (null
    first), line number and the text's XXH64. Rows that share a doc_id with different texts are documents of their own, rows
    that repeat doc_id and text share their lines' fate. Other columns are ignored; an empty table gives no rows.
    """
    return _by_row(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__v_row")), threshold).drop("__v_row")


def drop_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with their repeated lines taken out of text; null texts, ties and repeated rows as in ``repeated_lines``."""
    rows = materialise(docs.withColumn("__v_row", F.monotonically_increasing_id()), "numbered-documents")
    gone = _by_row(rows, threshold).where(F.size("removed_lines") > 0).select(F.col("__v_row").alias("__v_own"), F.col("removed_lines").alias("__v_gone"))
    joined = rows.join(materialise(gone, "gone-lines").hint("merge"), F.col("__v_row") == F.col("__v_own"), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("__v_gone", i))
    return joined.withColumn("text", F.when(F.col("__v_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed_lines"))
