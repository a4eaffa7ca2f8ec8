"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets come from the weights by water filling.  The whole budget is cut into equal
blocks of tokens, and blocks are seats: sources get them by highest quotients
``target / (2 k - 1)``, and every source hands its seats on to its shards in the same
way, by their sizes.  A shard lays its documents out in seeded order, over and over,
and takes the blocks its quota pays for from the front.

Everything is DataFrame expressions.  The seats are not dealt out one by one: rounding
``target / (budget / seats)`` gives all of them but for at most half a seat per party,
and only quotients around that point are ranked.  Shards hold ``SHARD_DOCS`` documents
or so, whatever the size of their source, so no window runs over a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestitch.operators.scratch import Scratch

#: Documents of one shard, about.
SHARD_DOCS = 1_000
#: Tokens of a block at most; a small corpus gets smaller blocks, so that quotas stay fine.
BLOCK_TOKENS = 32
#: A source is used this many times at most.
MAX_EPOCHS = 3
#: Sources and shards whose shares go to every task; beyond, rows are joined by a shuffle.
BROADCAST_ROWS = 200_000
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def fill_targets(sources: DataFrame, budget: Column, cap: Column) -> DataFrame:
    """Adds ``target``: shares of ``budget`` by ``weight``, none above ``cap``.

    ``sources`` has ``weight`` (positive) and ``rank`` (distinct); one row per source.
    """
    order = Window.orderBy("full", "rank")
    left = F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = sources.withColumn("budget", budget.cast("double")).withColumn("cap", cap.cast("double")).withColumn("full", F.col("cap") / F.col("weight")).withColumn("level", level)
    everyone = Window.orderBy("full", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    water = F.coalesce(F.first(F.when(F.col("level") <= F.col("full"), F.col("level")), ignorenulls=True).over(everyone), F.max("full").over(everyone))
    return rows.withColumn("target", F.least(F.col("cap"), water * F.col("weight"))).drop("cap", "full", "level")


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Sainte-Lague: ``(*group, key, quota)`` with ``seats`` of each group dealt out by ``votes``.

    Ties go to the party that comes first by ``key``, which is distinct within a group.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, n = F.sum(votes).over(whole).cast("double"), F.count(F.lit(1)).over(whole)
    p = parties.select(*group, key, F.col(votes).cast("double").alias("v"), F.col(seats).cast("long").alias("s"), total.alias("total"), n.alias("n"))
    p = p.withColumn("a", F.when(F.col("total") > 0, F.floor(F.col("v") * F.col("s") / F.col("total") + 0.5)).otherwise(F.lit(0)).cast("long"))
    p = p.withColumn("open", F.when(F.col("total") > 0, F.col("s") - F.sum("a").over(whole)).otherwise(F.lit(0)))
    reach = F.when(F.col("total") > 0, F.ceil(F.col("n") * F.col("v") / F.col("total")) + 2).otherwise(F.lit(1)).cast("int")
    p = p.withColumn("j", F.explode(F.sequence(F.lit(1), reach)))
    up = F.col("v") / (2 * (F.col("a") + F.col("j")) - 1)
    down = F.when(F.col("j") <= F.col("a"), F.col("v") / (2 * (F.col("a") - F.col("j")) + 1)).otherwise(F.lit(float("inf")))
    p = p.withColumn("q", F.when(F.col("open") > 0, -up).otherwise(down))
    turn = F.row_number().over(whole.orderBy("q", F.when(F.col("open") > 0, F.lit(1)).otherwise(F.lit(-1)) * F.dense_rank().over(whole.orderBy(F.col(key).asc_nulls_last())), "j"))
    p = p.withColumn("turn", turn)
    won = F.count_if(F.col("turn") <= F.abs("open"))
    return p.groupBy(*group, key, "a", "open").agg(won.alias("won")).select(*group, key, (F.col("a") + F.sign("open").cast("long") * F.col("won")).alias("quota"))


def _sizes(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size")]


def _quotas(sizes: DataFrame, store: Scratch, weights: tuple[float, ...]) -> DataFrame:
    """A row per source: its target, number of shards and quota of blocks."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("rank", rank).withColumn("weight", weight)
    all_rows = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("budget", F.sum("source_size").over(all_rows)).withColumn("parties", F.count(F.lit(1)).over(all_rows))
    sources = fill_targets(sources, F.col("budget"), MAX_EPOCHS * F.col("source_size"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TOKENS), F.floor(F.col("budget") / (200 * F.col("parties")))))
    sources = store.write(sources.withColumn("block", block.cast("long")).withColumn("seats", F.round(F.col("budget") / F.col("block")).cast("long")).withColumn("shards", F.ceil(F.col("rows") / SHARD_DOCS).cast("long")), 1)
    quotas = apportion(sources, [], "rank", "target", "seats").withColumnRenamed("quota", "source_quota")
    return store.write(sources.join(quotas, "rank").select("rank", F.col("source").alias("s"), "source_size", "target", "block", "shards", "source_quota"), 1)


def _placed(sizes: DataFrame, quotas: DataFrame, seed: int, *keep: str) -> DataFrame:
    """Rows with the share of their source and their shard."""
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards"))
    return sizes.join(quotas, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", "block", "source_quota", "rank", shard.alias("shard"), *keep)


def _turn(seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), "doc_id")


def _line(placed: DataFrame, seed: int, *tie: str) -> tuple[DataFrame, Column, Column]:
    """The rows of every shard in line, how often all are taken, and how many more words from the front."""
    shards = placed.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    dealt = apportion(shards, ["rank"], "shard", "shard_size", "source_quota")
    order = Window.partitionBy("rank", "shard").orderBy(_turn(seed), "doc_id", "size", *tie)
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = placed.join(dealt, ["rank", "shard"]).withColumn("end", end).withColumn("shard_size", F.sum("size").over(Window.partitionBy("rank", "shard")))
    tokens = F.least(F.col("quota") * F.col("block"), MAX_EPOCHS * F.col("shard_size"))
    whole = F.when(F.col("shard_size") > 0, F.floor(tokens / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    return line, whole, tokens - whole * F.col("shard_size")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), seed: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document a mixture by source weights takes.

    Sources, in code point order and null last, have the ``weights`` in turn.  The
    budget is the number of words of all documents.  Returns per input row
    ``(doc_id, source, size, source_size, target, taken)``: target is its source's, and
    taken counts repeats, so it reaches ``MAX_EPOCHS`` times the size at most.  Columns
    in ``keep``, of other names than these, follow.

    * A null or blank text has size 0 and is taken 0 times; a source without words has
      target 0.  The null source is a source like any other.
    * Repeated rows and null ids are rows of their own.  Equal rows are interchangeable,
      so the result is the same multiset in every run.
    * An empty table gives an empty result.
    """
    store = Scratch(docs.sparkSession, "mix")
    sizes = store.write(docs.select(*_sizes(id_col, text_col, source_col), *keep))
    placed = store.write(_placed(sizes, _quotas(sizes, store, weights), seed, *keep))
    line, whole, part = _line(placed, seed)
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part - (F.col("end") - F.col("size"))))
    return line.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def mix_whole(docs: DataFrame, keep: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), seed: int = 13) -> DataFrame:
    """``mix`` for wide columns in ``keep``: they are written once and neither shuffled nor sorted.

    Of a shard's line only the row in which the words taken from the front end is needed.
    Rows before it are taken once more than those after it, so every row finds its share in
    one small row a source and one a shard.  Rows of equal ids and sizes stand in line by
    their place in the written table.  If there are over ``BROADCAST_ROWS`` small rows, the
    shares are found for the narrow columns and joined with the wide ones.
    """
    store = Scratch(docs.sparkSession, "mix")
    rows = store.write(docs.select(*_sizes(id_col, text_col, source_col), F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept")))
    sizes = rows.select("doc_id", "source", "size", "row")
    quotas = _quotas(sizes, store, weights)
    line, whole, part = _line(_placed(sizes, quotas, seed, "row"), seed, "row")
    place = F.struct(_turn(seed).alias("turn"), "doc_id", "size", "row")
    cut = F.struct(place.alias("place"), whole.alias("whole"), (part - (F.col("end") - F.col("size"))).alias("left"))
    cuts = line.where(F.col("end") > part).groupBy(F.col("rank").alias("r"), F.col("shard").alias("n")).agg(F.min(cut).alias("cut"))
    cuts = store.write(cuts)
    small = quotas.count() + cuts.count() <= BROADCAST_ROWS
    names = ["source_size", "target", "taken"]

    def shared(df: DataFrame, *others: str) -> DataFrame:
        few, cut_at = (F.broadcast(quotas), F.broadcast(cuts)) if small else (quotas, cuts)
        found = _placed(df, few, seed, "row", *others).join(cut_at, (F.col("rank") == F.col("r")) & (F.col("shard") == F.col("n")), "left")
        front = F.when(place < F.col("cut.place"), F.col("size")).when(place == F.col("cut.place"), F.col("cut.left")).otherwise(F.lit(0))
        taken = F.coalesce(F.col("cut.whole"), F.lit(0)) * F.col("size") + front  # a shard without a cut has no words
        return found.withColumn("taken", taken.cast("long"))

    mixed = shared(rows, "kept") if small else rows.join(shared(sizes).select("row", *names), "row")
    return mixed.select("doc_id", "source", "size", *names, *[F.col("kept").getField(c).alias(c) for c in keep])
