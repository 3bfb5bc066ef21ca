"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document's expected copies are its source's target over the source's size. Within a source the
documents stand in one order; along it the expected copies add up, and with one offset per source a
document is emitted once for every integer that its stretch of the sum crosses. So a source's number of
copies misses its expectation by less than one, and as the order goes by size, so do its words by little.

The prefix sum is never taken over a whole source: documents are dealt by (source, size class, salt)
into pieces, ranks are taken inside a piece, and only the pieces' counts (at most classes x salts for a
source) are summed across. They are counted once and written; a second look at the documents ranks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, set_aside, written

#: Fixed by the contract: weights in order of the sources' names, and the limit to a source's target.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Pieces of a source: 4 size classes to each doubling, and salts within a class: so many hexadecimal digits of an MD5 digest.
CLASSES_PER_DOUBLING = 4
SALT_DIGITS = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_fraction(col: Column) -> Column:
    """A number in [0, 1) from a string, by the first 32 bits of its MD5 digest."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in order of their names' code points, null last, weigh WEIGHTS in turn. All sizes together are
    shared out by weight; no target passes MOST times its source's size. In order of size by weight the
    limited sources come first, so one pass of running sums finds which are limited and what a unit of
    weight gets elsewhere. One row a source: the windows below see a few rows only."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    unit = (F.col("total") - MOST * F.col("size_before")) / F.col("weight_rest")
    first_open = F.min(F.when(MOST * F.col("ratio") >= F.col("unit"), F.struct("ratio", "place", "unit")))
    return (
        sizes.withColumn("place", F.row_number().over(ordered))
        .withColumn("weight", weight)
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("unit", unit)
        .withColumn("share", first_open.over(everything)["unit"])
        .select("source", "source_size", F.least(F.col("weight") * F.col("share"), MOST * F.col("source_size")).alias("target"))
    )


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Add size, source_size, target, copies and taken (all named so; such columns of `docs` are replaced).

    Null text: size 0. Null source: a source of its own, last in order. Empty table: no rows. Null or
    repeated doc_id: rows are still mixed one by one, rows without an id dealt by their texts; rows alike in source,
    size and doc_id stand beside one another in the order, so which of them gets a copy more is of no account. A source of size 0 has
    target 0 and gives nothing. The offset depends on seed and source alone, so reruns agree."""
    added = ("size", "source_size", "target", "copies", "taken")
    docs, back = set_aside(docs.drop(*added), lambda c: c.startswith("_mix_") or c in ("_n", "_size"))
    base = docs.withColumn("size", n_words(F.col("text")))
    bits = F.length(F.bin("size"))
    base = (
        base.withColumn("_mix_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
        .withColumn("_mix_bits", bits)
        .withColumn("_mix_class", F.col("_mix_bits") * CLASSES_PER_DOUBLING + F.expr("shiftright(size, greatest(_mix_bits - 3, 0)) & 3").cast("int"))
        .withColumn("_mix_salt", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))), 1, SALT_DIGITS))
        .withColumn("_mix_tie", F.xxhash64("text"))
        .drop("_mix_bits")
    )
    piece = ["_mix_source", "_mix_class", "_mix_salt"]
    pieces = base.groupBy(*piece).agg(F.first("source").alias("source"), F.count("*").alias("_n"), F.sum("size").alias("_size"))
    pieces = written(pieces, "mix-pieces")
    per_source = targets(pieces.groupBy("source").agg(F.sum("_size").alias("source_size")))
    before = Window.partitionBy("_mix_source").orderBy("_mix_class", "_mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*piece, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_mix_before"))
    per_source = per_source.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_mix_source"), "source_size", "target")
    offsets = offsets.join(per_source, "_mix_source")
    rank = F.col("_mix_before") + F.row_number().over(Window.partitionBy(*piece).orderBy("size", "doc_id", "_mix_tie"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hex_fraction(F.concat(F.lit(f"{seed}/"), F.col("_mix_source")))
    copies = F.floor(F.col("_mix_rate") * F.col("_mix_rank") + F.col("_mix_offset")) - F.floor(F.col("_mix_rate") * (F.col("_mix_rank") - 1) + F.col("_mix_offset"))
    return (
        base.join(offsets, piece)
        .withColumn("_mix_rank", rank)
        .withColumn("_mix_rate", rate)
        .withColumn("_mix_offset", offset)
        .withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop(*piece, "_mix_tie", "_mix_before", "_mix_rank", "_mix_rate", "_mix_offset")
        .withColumnsRenamed(back)
    )


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy."""
    mixed, back = set_aside(mixed, "_mix_copy".__eq__)
    return mixed.where("copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_mix_copy").withColumnsRenamed(back)
