"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distinctspark.session import join_group_params, materialize

WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times over.
REPEATS = 3
#: About so many blocks in the mix, whatever its size: targets are met within half a block.
BLOCKS = 1 << 18
#: A source of fewer than so many of these blocks is cut into this many smaller ones of its own.
LEAST_BLOCKS = 64
#: Points drawn per needed slot.  Gaps of n golden-ratio points are below 2.62 / n, so every
#: source has met its quota before they run out.
MARGIN = 4
#: 2^32 over the golden ratio; i * this mod 2^32 is the i-th point.
GOLDEN = 2654435769
_WORD = r"[^\x20\x09-\x0D]+"


def _place(seed: int) -> Column:
    """60 bits of the MD5 of seed, doc_id and text: where the shuffle puts a document."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                    F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, h): words of each whole text, and its place in the shuffle."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"),
                       words.alias("size"), _place(seed).alias("h"))


def targets(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, weight, target) of a table (source, source_size).

    Sources by code point, NULL last, weigh 5, 2, 1, repeating.  They share the total size by
    weight; what exceeds REPEATS times a source's size is shared by the others again until none
    is above.  In order of cap per weight, the capped ones come first, so one pass settles it.
    One row per source goes through a window without keys.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (n - 1) % len(WEIGHTS) + 1)
    table = sizes.select(n.alias("sid"), "source", "source_size",
                         weight.cast("long").alias("weight"),
                         (F.col("source_size") * REPEATS).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    every = Window.partitionBy()
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = "decimal(38,0)"
    table = table.withColumn(
        "rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
    table = table.withColumn(
        "weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    capped = F.col("cap").cast(whole) * F.col("weights") <= F.col("rest").cast(whole) * F.col("weight")
    table = table.withColumn("capped", capped)
    # The first source that is not capped sees what is left for all that are not.
    left = [F.min_by(F.when(~F.col("capped"), F.col(c)), F.when(~F.col("capped"), F.struct(
        F.col("cap") / F.col("weight"), "sid"))).over(every) for c in ("rest", "weights")]
    share = left[0].cast("double") * F.col("weight") / left[1]
    return table.select("sid", "source", "source_size", "weight",
                        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)
                        .alias("target"))


def placed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with a size, and the word ``start`` it has in its source's shuffled order.

    Each source is cut by ranges of ``h`` into about sqrt(documents) parts; parts are summed in
    their own tasks and the parts' totals give the offsets, so no source is ordered in one task.
    """
    rows = docs.where("size > 0")
    n = rows.count()
    bits = max(0, math.ceil(math.log2(n) / 2)) if n else 0
    rows = join_group_params(
        rows, sources.select("source", "sid", "source_size", "per_block"), ["source"], "source_size")
    rows = rows.withColumn("part", F.shiftright("h", 60 - bits))
    totals = rows.groupBy("sid", "part").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sid", "part").orderBy("h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(offsets, ["sid", "part"]).select(
        "doc_id", "h", "sid", "size", "per_block", (F.col("offset") + F.col("inner")).alias("start"))


def schedule(sources: DataFrame) -> DataFrame:
    """(sid, rank, slot, block): the blocks of the mix; ``rank`` counts each source's own slots.

    ``sources`` has the words ``per_block`` of each source.

    A source needs ``quota`` slots: whole rounds over its blocks, then those of the last, partial
    round, whose words come nearest to its target.  Cells 0 to sum(quota) - 1 are laid out source
    by source; slot i takes the cell under the i-th golden-ratio point, and a source that has met
    its quota is passed over.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / F.col("per_block"))
    rounds = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(REPEATS))
    rest = F.col("target") - rounds * F.col("source_size")
    quota = sources.where("source_size > 0").select(
        "sid", blocks.alias("blocks"), (rounds * blocks + F.least(F.round(rest / F.col("per_block")), blocks)).cast("long").alias("quota"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    quota = materialize(quota.where("quota > 0"), "quota")
    cells = quota.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first().n
    owners = quota.select("sid", "quota", "blocks", F.explode(
        F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("cell"))
    point = (F.col("id") * GOLDEN).bitwiseAND(0xFFFFFFFF)
    slots = spark.range(MARGIN * cells).select(
        F.col("id").alias("slot"), F.shiftright(point * cells, 32).alias("cell"))
    slots = slots.join(owners, "cell").withColumn("part", F.shiftright("slot", 10))
    counts = slots.groupBy("sid", "part").agg(F.count("*").alias("n"))
    parts = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1
    ranked = slots.withColumn("inner", within).join(offsets, ["sid", "part"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("inner"))
    return ranked.where("rank < quota").select(
        "sid", "rank", "slot", F.expr("rank % blocks").alias("block"))


def _laid_out(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sized documents, sources, parts, slots).

    ``parts`` has a row per document and block it stands in: sid, doc_id, h, size, start, block, and
    the words ``part`` of it there.  ``slots`` is the schedule.
    """
    table = materialize(sized(docs, seed), "sized")
    sources = targets(table.groupBy("source").agg(F.sum("size").alias("source_size")))
    words = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    block = max(1, -(-words // BLOCKS))
    own = F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))
    sources = materialize(sources.withColumn("per_block", F.greatest(own, F.lit(1))), "sources")
    slots = materialize(schedule(sources), "slots")
    rows = materialize(placed(table, sources), "placed")
    size = F.col("per_block")
    spans = rows.select("*", F.explode(F.sequence(
        F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
    )).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * size)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
    return table, sources, spans.withColumn("part", high - low).drop("per_block"), slots


def mix_order(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(slot, start, doc_id, words): the mix itself, in the order of slot and start.

    A row is the part of a document that a block takes at a slot.  Documents without words and blocks
    that no slot takes have no rows.
    """
    _, _, parts, slots = _laid_out(docs, seed)
    taken = parts.join(slots.select("sid", "block", "slot"), ["sid", "block"])
    return taken.select("slot", "start", "doc_id", F.col("part").alias("words"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, h, source, size, source_size, target, taken, first_slot) of every row of ``docs``.

    ``taken`` counts the words the mix takes of the document, repeats included, and ``first_slot`` is
    the slot of the schedule that takes the first of them (NULL where none does).  Documents of a
    source are shuffled and laid end to end; the stream is cut into blocks of equal words (the
    last may be shorter), and a source's r-th slot takes its block r mod blocks.

    A NULL or empty text has size 0 and takes nothing; NULL is a source of its own.  Equal rows
    take what their places take.  Other columns are ignored.  An empty table gives an empty mix.
    """
    table, sources, parts, slots = _laid_out(docs, seed)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    taken = parts.join(times, ["sid", "block"], "left")
    taken = taken.groupBy("sid", "start", "doc_id", "h", "size").agg(
        F.coalesce(F.sum(F.col("part") * F.col("times")), F.lit(0)).alias("taken"),
        F.min("slot").alias("first_slot"))
    names = sources.select("sid", "source", "source_size", "target")
    full = join_group_params(taken, names.withColumn("w", F.col("source_size")), ["sid"], "w")
    empty = join_group_params(
        table.where("size = 0"), names.drop("sid").withColumn("w", F.lit(1)), ["source"], "w")
    columns = ["doc_id", "h", "source", "size", "source_size", "target", "taken", "first_slot"]
    none = {"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")}
    return full.select(*columns).unionByName(empty.withColumns(none).select(*columns))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: repeated, left out, or cut in the last copy.

    A source's last round over its blocks stops within a document; that copy keeps its first
    words only.  Rows equal in doc_id and text are taken as often as all of them together, with
    the other columns of one of them.  Documents without words are left out.
    """
    key = [F.col("h").alias("_h"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
           F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null")]
    names = ["_h", "_id", "_source", "_null"]
    plan = mix(docs, seed).where("taken > 0").groupBy(*key).agg(
        F.sum(F.expr("taken div size")).alias("_copies"), F.max(F.expr("taken % size")).alias("_cut"))
    keyed = docs.select(_place(seed).alias("_h"), *key[1:], *docs.columns)
    # Dealt out by the key once, for both steps.
    one = keyed.dropDuplicates(names).join(plan, names)
    whole = F.when(F.col("_copies") > 0, F.array_repeat(F.lit(0).cast("long"), F.col("_copies").cast("int")))
    cuts = F.concat(F.coalesce(whole, F.array().cast("array<bigint>")),
                    F.when(F.col("_cut") > 0, F.array("_cut")).otherwise(F.array().cast("array<bigint>")))
    copies = one.withColumn("_cut", F.explode(cuts))
    # Parts are a word with the white space before it.
    parts = F.split("text", r"(?<=[^ \t-\r])(?=[ \t-\r])")
    text = F.when(F.col("_cut") > 0, F.array_join(F.slice(parts, F.lit(1), F.col("_cut").cast("int")), ""))
    return copies.withColumn("text", text.otherwise(F.col("text"))).select(*docs.columns)
