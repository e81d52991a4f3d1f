"""Similar items: banded candidates, cosine ranking, peers, comparables, nearest neighbours."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import index


def candidates(items: DataFrame, width: int = 1) -> DataFrame:
    """(target_id, skin_id) pairs of one genre with tiers at most ``width`` apart, by an equality join over exploded tiers.

    Pairs within a band are this operator's result; ``competitors`` finds the nearest of them without listing them.
    """
    t = items.select(F.col("skin_id").alias("target_id"), F.col("genre").alias("_g"), F.explode(F.sequence(F.col("official_tier") - width, F.col("official_tier") + width)).alias("_t"))
    return t.join(items.select("skin_id", "genre", "official_tier").hint("merge"), (F.col("_g") == F.col("genre")) & (F.col("_t") == F.col("official_tier"))).where("skin_id <> target_id").select("target_id", "skin_id")


def competitors(items: DataFrame, k: int = 5, width: int = 1) -> DataFrame:
    """(target_id, place, skin_id, similarity): the k most similar items of the genre with tiers at most ``width`` apart, by cosine of ``vector``, ties by id."""
    return top(index.search(items, k, genre="genre", tier="official_tier", width=width), ["target_id"], [F.desc("similarity"), F.col("skin_id")], k)


def top(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


#: The ways in which peers can be alike, alone and together.
SHARED = ("hero_name", "series", "official_tier")
#: Items a task of ``peers`` looks at: each becomes seven rows, and these up to 6 pairs each.
TASK_ITEMS = 50_000
COMBINATIONS = tuple(c for n in range(1, len(SHARED) + 1) for c in combinations(SHARED, n))


def peers(skins: DataFrame, k: int = 5) -> DataFrame:
    """(target_id, place, skin_id, ways, gap): skins of the same hero, series or tier within a genre, most ways shared first, then the
    nearest price (to 4 decimals), then by id. Skins without a genre or price take no part, a null is not shared.

    Whatever is among a skin's k first peers is among the k nearest in price of those that share the same ways or more. So for each
    combination of ways only neighbours are looked at: skins fall into its groups, a group's distinct prices stand in order with the k + 1
    least ids of each, and each price is compared with the k prices on either side. Output and work grow with the number of skins, and
    the number of tasks as well: what a task holds doesn't, though a small file has many skins.
    """
    tasks = max(1, -(-skins.count() // TASK_ITEMS))
    rows = skins.where(F.col("genre").isNotNull() & F.col("official_price").isNotNull()).withColumn("price", F.round(F.col("official_price").cast("double"), 4))
    ways = F.array(*[F.struct(F.lit(i).alias("combination"), *[(F.col(s) if s in c else F.lit(None)).cast("string").alias(f"_{s}") for s in SHARED], F.lit(len(c)).cast("long").alias("ways")) for i, c in enumerate(COMBINATIONS)])
    rows = rows.select("skin_id", "genre", "price", *SHARED).repartition(tasks, "skin_id")  # one exchange serves both readers
    rows = rows.select("skin_id", "genre", "price", *SHARED, F.explode(ways).alias("w")).select("skin_id", "genre", "price", "w.*", *SHARED)
    whole = F.lit(False)
    for i, c in enumerate(COMBINATIONS):
        known = F.lit(True)
        for s in c:
            known = known & F.col(s).isNotNull()
        whole = whole | ((F.col("combination") == i) & known)
    names = [f"_{s}" for s in SHARED]
    group = ["combination", "genre", *names]
    rows = rows.where(whole).select("skin_id", "price", "ways", *group)
    few = top(rows.select("skin_id", "price", *group), [*group, "price"], [F.col("skin_id")], k + 1)
    prices = few.groupBy(*group, "price").agg(F.array_sort(F.collect_list("skin_id")).alias("ids"))  # k + 1 ids at most
    around = F.collect_list(F.struct("price", "ids")).over(W.partitionBy(*group).orderBy("price").rowsBetween(-k, k))  # a row a distinct price
    found = F.flatten(F.transform("around", lambda x: F.transform(x["ids"], lambda i: F.struct(F.round(F.abs(x["price"] - F.col("price")), 4).alias("gap"), i.alias("skin_id")))))
    near = prices.withColumn("around", around).select(*[F.col(c).alias(f"g{c}") for c in group], F.col("price").alias("_price"), F.slice(F.array_sort(found), 1, k + 1).alias("near"))
    on = F.col("price") == F.col("_price")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"g{c}"))
    pairs = rows.join(near.hint("merge"), on).select(F.col("skin_id").alias("target_id"), "ways", "near").repartition(tasks, "target_id")  # a target's pairs meet here only: nothing to combine before
    pairs = pairs.select("target_id", "ways", F.explode("near").alias("n")).select("target_id", "ways", "n.*").where("target_id <> skin_id")
    per = pairs.groupBy("target_id", "skin_id").agg(F.max("ways").alias("ways"), F.min("gap").alias("gap"))
    return top(per, ["target_id"], [F.desc("ways"), F.col("gap"), F.col("skin_id")], k)


def comparables(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k items of the same genre and a tier at most one away whose total is nearest, ties by id.

    Nearness depends on (genre, tier, total) alone, of which there are few, so candidates are ranked for each of these and
    not for each item: k + 1 items of a total are enough, and k + 1 candidates of a key, as an item itself may be one.
    """
    key = ["genre", "official_tier", "total_premium"]
    few = top(scored.select("skin_id", *key), key, [F.col("skin_id")], k + 1).drop("place")
    asked = scored.select(*key).distinct().select(*[F.col(c).alias(f"_{c}") for c in key], F.explode(F.sequence(F.col("official_tier") - 1, F.col("official_tier") + 1)).alias("_near"))
    pairs = asked.join(few.hint("merge"), (F.col("_genre") == F.col("genre")) & (F.col("_near") == F.col("official_tier")))
    pairs = pairs.withColumn("gap", F.abs(F.col("_total_premium") - F.col("total_premium")))
    mine = [f"_{c}" for c in key]
    best = top(pairs, mine, [F.col("gap"), F.col("skin_id")], k + 1).select(*mine, "skin_id", "total_premium", "gap")
    own = scored.select(F.col("skin_id").alias("target_id"), *[F.col(c).alias(f"_{c}") for c in key])
    rows = own.join(best.hint("merge"), mine).where("target_id <> skin_id")
    return top(rows, ["target_id"], [F.col("gap"), F.col("skin_id")], k).select("target_id", "place", "skin_id", "total_premium", "gap")


def nearest(items: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
    """(target_id, skin_id, similarity, place): the k most similar of all items by cosine, ties by id.

    Exact, unless ``probes`` bounds the cells of the index that an item is compared with.
    """
    return top(index.search(items, k, probes=probes), ["target_id"], [F.desc("similarity"), F.col("skin_id")], k)
