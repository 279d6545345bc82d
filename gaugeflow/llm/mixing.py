"""Mixing sources to target weights, in DataFrame functions alone.

Texts are laid end to end, source by source and shard by shard, and cut into
blocks of equally many words. Sainte-Laguë's method deals the mix's blocks to
the sources (the highest quotients of votes by 1, 3, 5, ... get them), and
then each source's blocks to its shards, so that every shard has an integer
quota. A shard gives its quota by whole passes over its blocks and, for the
rest, the blocks of least seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.order import numbered

from .common import need, written

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """``sizes`` (``source, source_size``; a row a source) with ``source_no``,
    ``target`` and ``capped``.

    Sources by code point, null last, take ``weights`` in turn and share the
    sum of all sizes by them. A target stops at ``repeats`` times its source's
    size, and what is over is shared by weight among the others, until none is
    above. An empty source has target 0; without words all have.

    A round is one aggregate over the sources; each one caps further sources,
    and a round that caps none is the last."""
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    parties = numbered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()])
    parties = written(parties.select("source", "source_size", F.col("rank").alias("source_no"), turn.alias("weight"), (F.col("source_size") * repeats).alias("most")), "sources")
    total, level, capped = None, 0.0, -1
    while True:
        above = F.col("weight") * level >= F.col("most") if capped >= 0 else F.lit(False)
        r = parties.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("most"))).alias("spent"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n")).first()
        total = r["all"] or 0
        if not total or r["open"] is None or r["n"] == capped:
            break
        level, capped = (total - (r["spent"] or 0)) / r["open"], r["n"]
    above = F.col("weight") * level >= F.col("most")
    return parties.select("source", "source_no", "source_size", F.when(above, F.col("most").cast("double")).otherwise(F.col("weight") * level).alias("target"), above.alias("capped"))


def sainte_lague(parties: DataFrame, group: str) -> DataFrame:
    """Seats of each row of ``parties`` by highest quotients, in each ``group``.

    A row (``group, votes, many, seats``, a long ``tie`` that no other row of
    its group has) stands for ``many`` parties of equally many ``votes``; all
    rows of a group carry its number of ``seats``. Adds ``quota``, the seats of
    each of the ``many``, and ``extra``: how many of them get one more, where
    the last seats fall between parties that tie. Equal quotients go by
    ``tie``. Rows with ``many`` or ``votes`` of 0 get nothing.

    A party with a share of t seats gets its k-th at (k - 1/2) / t. With n
    parties the last seat of a group falls within 1 ± n / (2 seats): rounding
    each share takes at most half a seat from each party. So only the seats in
    that band, some 2 n, are sorted; what is below it is sure.
    """
    own = Window.partitionBy(group)
    rows = parties.withColumn("n", F.sum("many").over(own)).withColumn("all", F.sum(F.col("votes") * F.col("many")).over(own))
    rows = rows.withColumn("share", F.coalesce(F.col("votes") * F.col("seats") / F.nullif(F.col("all"), F.lit(0.0)), F.lit(0.0)))
    width = (F.col("n") / 2 + 1) / F.greatest(F.col("seats"), F.lit(1))
    sure = F.greatest(F.lit(0), F.floor((1 - width) * F.col("share") + 0.5)).cast("long")
    rows = rows.withColumn("sure", F.when(F.col("many") > 0, sure).otherwise(0).cast("long")).withColumn("last", F.floor((1 + width) * F.col("share") + 0.5).cast("long"))
    rows = rows.withColumn("left", F.col("seats") - F.sum(F.col("sure") * F.col("many")).over(own))
    seat = F.when((F.col("last") > F.col("sure")) & (F.col("many") > 0), F.sequence(F.col("sure") + 1, F.col("last"))).otherwise(F.array().cast("array<long>"))
    open_ = rows.withColumn("seat", F.explode_outer(seat)).withColumn("at", (F.col("seat") - 0.5) / F.col("share"))
    there = F.when(F.col("seat").isNotNull(), F.col("many")).otherwise(0)
    upto = F.sum(there).over(own.orderBy(F.col("at").asc_nulls_last(), "tie", "seat").rowsBetween(Window.unboundedPreceding, 0))
    open_ = open_.withColumn("before", upto - there).withColumn("got", F.greatest(F.lit(0), F.least(there, F.col("left") - F.col("before"))))
    full = (F.col("got") == F.col("many")) & (F.col("got") > 0)
    keys = [c for c in parties.columns if c not in ("votes", "many", "seats", "tie")]
    return open_.groupBy(*dict.fromkeys([group, "tie", *keys])).agg((F.first("sure") + F.count_if(full)).alias("quota"), F.coalesce(F.sum(F.when(~full, F.col("got"))), F.lit(0)).cast("long").alias("extra"))


def _order(seed: int, block: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.col("source_no"), F.col("shard"), block.cast("long"))


def shard_quotas(shards: DataFrame, sources: DataFrame, block: int, repeats: int, seed: int) -> DataFrame:
    """Per shard (``source_no, shard, words``): ``blocks``, ``passes`` over all
    of them, and the hash and number (``cut_hash, cut_block``) up to which its
    blocks come once more; null if none does.

    Sources that are capped give each block ``repeats`` times. The others get
    the blocks that are left by their targets; a source's own blocks differ a
    little from ``block`` words, so its number is carried over by its words."""
    cut = shards.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long"))
    sums = cut.groupBy("source_no").agg(F.sum("blocks").alias("all_blocks"))
    free = sources.where("not capped and source_size > 0")
    n = free.agg(F.round(F.sum("target") / block).cast("long")).first()[0] or 0
    dealt = sainte_lague(free.select(F.lit(0).alias("group"), "source_no", F.col("target").alias("votes"), F.lit(1).alias("many"), F.lit(n).alias("seats"), F.col("source_no").alias("tie")), "group")
    seats = sources.where("source_size > 0").join(sums, "source_no").join(dealt.select("source_no", "quota"), "source_no", "left")
    most = F.col("all_blocks") * repeats
    own = F.round(F.col("quota") * block * F.col("all_blocks") / F.col("source_size")).cast("long")
    seats = seats.select("source_no", F.when(F.col("capped"), most).otherwise(F.least(most, own)).alias("seats"))
    # Shards of equally many blocks tie; a source has few such classes, whatever the number of its shards.
    classes = cut.groupBy("source_no", "blocks").agg(F.count("*").alias("many")).join(seats, "source_no")
    given = sainte_lague(classes.select("source_no", "blocks", F.col("blocks").cast("double").alias("votes"), "many", "seats", F.col("blocks").alias("tie")), "source_no").select("source_no", "blocks", "quota", "extra")
    rows = cut.join(given, ["source_no", "blocks"])
    # The one class of a source whose last seats don't reach all of its shards: those of least hash have them.
    torn = rows.where("extra > 0").withColumn("k", F.row_number().over(Window.partitionBy("source_no", "blocks").orderBy(F.xxhash64(F.lit(seed), "source_no", "shard"), "shard"))).withColumn("quota", F.col("quota") + (F.col("k") <= F.col("extra")).cast("long")).drop("k")
    rows = rows.where("extra = 0").unionByName(torn).withColumn("quota", F.least(F.col("quota"), F.col("blocks") * repeats))
    rest = F.col("quota") % F.col("blocks")
    hashed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(_order(seed, x).alias("h"), x.alias("x")))
    cut_at = F.when(rest > 0, F.element_at(F.array_sort(hashed), rest.cast("int")))
    return rows.withColumn("cut", cut_at).select("source_no", "shard", "blocks", (F.expr("quota div blocks")).alias("passes"), F.col("cut.h").alias("cut_hash"), F.col("cut.x").alias("cut_block"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeats: int = 3, block: int = 32, shard_blocks: int = 128, seed: int = 11) -> DataFrame:
    """What the mix takes of each row of ``docs`` (``doc_id, text, source``):
    ``doc_id, source, size, source_size, target`` and ``pieces``, the spans of
    words (``start, end`` exclusive, ``times``) that it takes; see ``drawn``.

    Sizes are numbers of words. ``block``: words of a block, so a source misses
    its target by about as many; ``shard_blocks``: blocks of a shard, about. No
    word comes more than ``repeats`` times. The same rows give the same pieces,
    however they lie in files.

    Null and empty texts have size 0 and no pieces; a null source is a source,
    the last one; null and repeated keys are rows of their own (rows that are
    equal in key, source and size lie in one shard, and which of them gets
    which span is open); extra columns are ignored; an empty table gives none.
    """
    sized = written(need(docs, "doc_id", "source", "text").select("doc_id", "source", words_of(F.col("text")).alias("size")), "sized")
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "targets")
    named = sources.withColumnRenamed("source", "own")
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / (block * shard_blocks)))
    laid = sized.join(named, F.col("source").eqNullSafe(F.col("own"))).withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), shards))
    own = Window.partitionBy("source_no", "shard")
    upto = F.sum("size").over(own.orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    laid = laid.withColumn("first", upto - F.col("size")).withColumn("words", F.sum("size").over(own))
    laid = written(laid.select("doc_id", "source", "size", "source_size", "target", "source_no", "shard", "first", "words"), "laid")
    quotas = shard_quotas(laid.groupBy("source_no", "shard").agg(F.max("words").alias("words")).where("words > 0"), sources, block, repeats, seed)
    both = laid.join(quotas, ["source_no", "shard"], "left")
    number = lambda end: f"(({end}) * blocks + words - 1) div words - 1"  # noqa: E731  of the block that holds word ``end`` - 1
    cut = lambda x: F.floor(x * F.col("words") / F.col("blocks"))

    def piece(x: Column) -> Column:
        h = _order(seed, x)
        more = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (x <= F.col("cut_block")))
        first, end = F.greatest(cut(x), F.col("first")), F.least(cut(x + 1), F.col("first") + F.col("size"))
        return F.struct((first - F.col("first")).alias("start"), (end - F.col("first")).alias("end"), (F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")).alias("times"))

    spans = F.filter(F.transform(F.sequence(F.expr(number("first + 1")), F.expr(number("first + size"))), piece), lambda p: p["times"] > 0)
    none = F.array().cast("array<struct<start:bigint,end:bigint,times:bigint>>")
    return both.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, spans).otherwise(none).alias("pieces"))


def taken(pieces: Column) -> Column:
    """Words of all pieces, repeats counted."""
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + (p["end"] - p["start"]) * p["times"])


def drawn(text: Column, pieces: Column) -> Column:
    """The pieces of a text as an array of texts, words joined by spaces, each
    as often as it comes; empty for null."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))
    return F.flatten(F.transform(pieces, lambda p: F.array_repeat(F.array_join(F.slice(words, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")), " "), p["times"].cast("int"))))
