"""Decks, tournaments and prices: operations that the surveyed platform declares but does not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.search import all_of

#: Rules of a deck: its size, and copies of a card other than basic energy.
DECK_SIZE, COPIES = 60, 4


def deck_problems(entries: DataFrame, banned: list[str] | None = None) -> DataFrame:
    """deck, total, problems of (deck, card, quantity, basic): a total other than 60, more than four of a card that is no
    basic energy, banned cards; an empty list is a valid deck."""
    per_card = entries.groupBy("deck", "card").agg(F.sum("quantity").alias("n"), F.max("basic").alias("basic"), F.max(F.col("card").isin(banned or [])).alias("bad"))
    over, bad = F.col("n").cast("long").cast("string"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.concat(F.lit("banned: "), "card"))))
    many = F.array_sort(F.collect_list(F.when((F.col("n") > COPIES) & ~F.col("basic"), F.concat(F.lit("too many: "), "card", F.lit(" ("), over, F.lit(")")))))
    decks = per_card.groupBy("deck").agg(F.sum("n").alias("total"), many.alias("many"), bad.alias("bad"))
    size = F.when(F.col("total") != DECK_SIZE, F.array(F.concat(F.lit("size: "), F.col("total").cast("string")))).otherwise(F.array().cast("array<string>"))
    return decks.select("deck", "total", F.concat(size, "many", "bad").alias("problems"))


def deck_counts(entries: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """deck, the quantity of each kind, and the total."""
    return entries.groupBy("deck").agg(*[F.sum(F.when(F.col(kind) == k, F.col("quantity")).otherwise(0)).alias(k) for k in kinds], F.sum("quantity").alias("total"))


def deck_text(entries: DataFrame) -> DataFrame:
    """deck, text: a line for each card, larger quantities first. A deck's entries are bounded by its size."""
    lines = F.array_sort(F.collect_list(F.struct((-F.col("quantity")).alias("o"), "card", "quantity")))
    return entries.groupBy("deck").agg(F.array_join(F.transform(lines, lambda x: F.concat(x["quantity"].cast("string"), F.lit(" "), x["card"])), "\n").alias("text"))


def imported_decks(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of the decks that tournament results name, as decks of their own that say where they come from."""
    named = results.where(F.col("deck").isNotNull()).select("deck", "tournament", "placement")
    return named.join(entries, "deck").select(F.concat_ws("/", "tournament", "placement").alias("deck"), F.col("deck").alias("source_deck"), "card", "quantity")


def meta_game(decks: DataFrame, entries: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(archetypes: n and share in per cent; the cards that the most decks play, and their copies)."""
    total = decks.agg(F.count("*").alias("_all"))  # one row
    kinds = decks.groupBy(F.coalesce("archetype", F.lit("OTHER")).alias("archetype")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    shares = kinds.select("archetype", "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("pct"))
    # Copies of a card in a deck are one entry first, so decks need no distinct count.
    usage = entries.groupBy("card", "deck").agg(F.sum("quantity").alias("q")).groupBy("card").agg(F.count("*").alias("n_decks"), F.sum("q").alias("copies"))
    return shares, usage.orderBy(F.desc("n_decks"), F.desc("copies"), "card").limit(most)


def compared_prices(prices: DataFrame, card: str = "card") -> DataFrame:
    """lowest, highest, average and n of each card over sources, and the source that is cheapest."""
    cheapest = F.min(F.struct("price", "source"))["source"]
    return prices.groupBy(card).agg(F.round(F.min("price"), 6).alias("lowest"), F.round(F.max("price"), 6).alias("highest"), F.round(F.avg("price"), 6).alias("average"), F.count("price").alias("n"), cheapest.alias("cheapest"))


def recent_prices(prices: DataFrame, days: list[int], card: str = "card", date: str = "date") -> DataFrame:
    """Each day's price of a card with its mean over the last 7, 30, ... days, the day itself included."""
    day = F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date"))
    daily = prices.groupBy(card, day.alias("day")).agg(F.avg("price").alias("price"))
    over = lambda n: Window.partitionBy(card).orderBy("day").rangeBetween(-(n - 1), 0)
    return daily.select(card, "day", F.round("price", 6).alias("price"), *[F.round(F.avg("price").over(over(n)), 6).alias(f"mean_{n}") for n in days])


def price_alerts(alerts: DataFrame, prices: DataFrame) -> DataFrame:
    """Alerts (card, target) whose card costs less than the target now, in some source."""
    now = prices.groupBy("card").agg(F.min("price").alias("_least"))
    return alerts.join(now, "card").where(F.col("_least") < F.col("target")).drop("_least")


def tournaments(rows: DataFrame, results: DataFrame, kind: str | None = None, region: str | None = None, begin=None, end=None, player: str | None = None) -> DataFrame:
    """Tournaments of a kind, a region, a range of days, and a player who took part."""
    tests = [F.col(c) == v for c, v in (("kind", kind), ("region", region)) if v]
    tests += [F.col("date") >= F.lit(begin)] if begin is not None else []
    tests += [F.col("date") <= F.lit(end)] if end is not None else []
    found = rows.where(all_of(tests))
    return found.join(results.where(F.contains(F.lower("player"), F.lit(player.lower()))).select("tournament"), "tournament", "left_semi") if player else found


def collection_stats(items: DataFrame, owner: str, card: str, rarity: str, kind: str, whole: DataFrame) -> DataFrame:
    """owner, total, unique, completion in per cent of ``whole`` (the catalogue of cards, by ``card``), and maps by rarity
    and kind."""
    n_all = whole.select(card).distinct().agg(F.count("*").alias("_all"))  # one row
    unique = items.groupBy(owner, card).agg(F.sum("quantity").alias("q"), F.first(rarity).alias("r"), F.first(kind).alias("k"))
    counts = unique.groupBy(owner).agg(F.sum("q").alias("total"), F.count("*").alias("unique"))
    listed = lambda c, name: unique.groupBy(owner, F.coalesce(c, F.lit("unknown")).alias("x")).agg(F.sum("q").alias("n")).groupBy(owner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("x", "n")))).alias(name))
    out = counts.crossJoin(F.broadcast(n_all)).join(listed("r", "by_rarity"), owner).join(listed("k", "by_kind"), owner)
    return out.withColumn("completion", F.round(F.coalesce(100.0 * F.try_divide(F.col("unique"), F.col("_all")), F.lit(0.0)), 6)).drop("_all")


def converted(amounts: DataFrame, rates: DataFrame, to: str, price: str = "price", currency: str = "currency") -> DataFrame:
    """Amounts in another currency; ``rates`` has (currency, rate) to one unit. Null where a rate is missing."""
    target: Column = F.first(F.when(F.col("currency") == to, F.col("rate")), ignorenulls=True)
    goal = rates.agg(target.alias("_to"))  # one row
    out = amounts.join(rates.select(F.col("currency").alias(currency), F.col("rate").alias("_from")), currency, "left").crossJoin(F.broadcast(goal))
    return out.withColumn("converted", F.col(price) * F.col("_from") / F.col("_to")).drop("_from", "_to")
