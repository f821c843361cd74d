"""Mixing sources to target weights by thresholds on a hash.

A source's *size* is its number of words. Sources, in the order of their names, take the given weights in turn, and
share the words of all sources in proportion to them; a source is taken ``most`` times at most, and what it can't give is
shared by the others, again and again until none is above. That is a water level: every target is the smaller of
level times weight and the cap, and the level is found in a few rounds of sums over sources.

A target is as many whole passes over the source as fit, and a rest. Which documents are taken once more for the
rest is told by a hash of doc_id and text: those below a threshold. Thresholds nest, so a larger budget takes all that a
smaller one takes. To find one, words are summed by source and the hash's first ten bits; the running sum over the
1,024 buckets tells which bucket holds the threshold; only that bucket's documents are summed by the next ten bits,
and so on until the bucket holds a single document, which is taken if that comes nearer to the target. Nothing is sorted,
documents meet thresholds in a filter, and a source with a third of all rows is as many sums as any other.

Rows equal in doc_id and text have the same hash; which of them are taken is told by their places in a stored table, how
many is not. A null text has no words, a null source comes last, and a null doc_id is hashed as none. A document without
words is taken as often as others, which takes no words. Ties don't occur beyond equal rows. An empty table gives an
empty table. Extra columns, whatever their names, are ignored or, by ``mixed``, returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ingest import numbered
from .common import Columns, Stored, only

#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a hash that one round looks at, and rounds for a whole hash.
DIGIT_BITS, DIGITS = 10, 6
_SOURCE = ["known", "source"]


def _hash(key: Column) -> Column:
    """The first 60 bits of the MD5 hash, as a number."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _digit(level: int) -> Column:
    """The level-th ten bits of the hash, or beyond it of the hash of the place."""
    column, at = ("hash", level) if level < DIGITS else ("place", level - DIGITS)
    return F.shiftright(column, DIGIT_BITS * (DIGITS - 1 - at)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")


def _placed(stored: DataFrame) -> DataFrame:
    """A stored table with a hash of where each row lies."""
    where = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
    return stored.select("*", _hash(where).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``sizes`` (known, source, source_size) with ``target``: the smaller of weight times a level and ``most`` sizes."""
    ranked = numbered(sizes.withColumn("__last", ~F.col("known")), "__last", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_row") % len(weights) + 1).cast("int")).cast("long")
    own = ranked.select(*_SOURCE, "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    left, shares = own.agg(F.sum("source_size"), F.sum("weight")).first()
    if left is None:
        return own.select(*_SOURCE, "source_size", F.lit(0.0).alias("target"))
    total, full = left, F.lit(False)
    while True:
        level = F.lit(left) * F.col("weight") / F.lit(shares)
        full = F.col("cap") < level
        capped, free = own.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if not free or (total - capped, free) == (left, shares):
            break
        left, shares = total - capped, free
    return own.select(*_SOURCE, "source_size", F.when(full, F.col("cap").cast("double")).otherwise(level).alias("target"))


def _budgets(told: DataFrame) -> DataFrame:
    """Whole passes and the words of the rest."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return told.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))


def _sums(rows: DataFrame, level: int) -> DataFrame:
    return rows.groupBy(*_SOURCE, _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))


def _boundary(sums: DataFrame, known: DataFrame, level: int) -> DataFrame:
    """The digit at which a source's running sum passes its rest, added to the digits known so far, and what is left of
    the rest before it. A source has at most 1,024 digits in a round."""
    before = Window.partitionBy(*_SOURCE).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.join(known, _SOURCE).withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    here = running.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    column, at = ("hash_at", level) if level < DIGITS else ("place_at", level - DIGITS)
    digits = F.col(column) + F.shiftleft(F.col("digit").cast("long"), DIGIT_BITS * (DIGITS - 1 - at))
    return here.withColumn("rest", F.col("rest") - F.col("before")).withColumn(column, digits).select(*_SOURCE, "digit", "rest", "words", "n", "hash_at", "place_at")


def _thresholds(base: DataFrame, budgets: DataFrame, first: DataFrame, store: Stored) -> tuple[DataFrame, int]:
    """For each source with a rest the digits of its threshold, and how many they are: rows below (hash_at, place_at) are
    taken once more, and what lies there if half of its ``words`` or more is left of the ``rest``."""
    zero = F.lit(0).cast("long")
    known = budgets.where("rest > 0").select(*_SOURCE, "rest", zero.alias("hash_at"), zero.alias("place_at"))
    sums, rows = first, base
    for level in range(2 * DIGITS):
        known = store.keep(_boundary(sums, known, level), f"boundary{level}")
        if level + 1 == 2 * DIGITS or known.where("n > 1").isEmpty():
            break
        within = rows.withColumn("digit", _digit(level)).join(known.select(*_SOURCE, "digit"), [*_SOURCE, "digit"])
        rows = store.keep(within.select(*_SOURCE, "size", "hash", "place"), f"rows{level}")
        known = known.select(*_SOURCE, "rest", "hash_at", "place_at")
        sums = _sums(rows, level + 1)
    return known, level + 1


def _upper(column: str, digits: int) -> Column:
    """A hash with its first digits only."""
    gone = DIGIT_BITS * (DIGITS - max(0, min(DIGITS, digits)))
    return F.shiftleft(F.shiftright(column, gone), gone) if gone < DIGIT_BITS * DIGITS else F.lit(0).cast("long")


def _mix(own: Columns, carried: list[str], weights: tuple[int, ...], most: int, seed: int, text: str, doc_id: str, source: str) -> DataFrame:
    spark = own.df.sparkSession
    store = Stored(spark, "source-mixing")
    name = F.col(own.of(source)).cast("string")
    key = F.concat_ws(":", F.lit(seed), F.col(own.of(doc_id)).cast("string"), F.col(own.of(text)))
    size = F.coalesce(F.regexp_count(own.of(text), F.lit(WORD)), F.lit(0)).cast("long")
    base = own.df.select(*carried, name.isNotNull().alias("known"), F.coalesce(name, F.lit("")).alias("source"), size.alias("size"), _hash(key).alias("hash"))
    base = _placed(store.keep(base, "words"))
    first = store.keep(_sums(base, 0), "sums")
    sizes = store.keep(first.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size")), "sizes")
    budgets = store.keep(_budgets(targets(sizes, weights, most)), "budgets")
    known, digits = _thresholds(base, budgets, first, store)
    told = budgets.select(*_SOURCE, "source_size", "target", "passes").join(known.select(*_SOURCE, "hash_at", "place_at", (2 * F.col("rest") >= F.col("words")).alias("taken_at")), _SOURCE, "left")
    hash_, place = _upper("hash", digits), _upper("place", digits - DIGITS)
    at = (hash_ == F.col("hash_at")) & (place == F.col("place_at"))
    below = (hash_ < F.col("hash_at")) | ((hash_ == F.col("hash_at")) & (place < F.col("place_at")))
    once_more = F.coalesce(below | (at & F.col("taken_at")), F.lit(False))
    copies = F.col("passes") + once_more.cast("int")
    mixed = base.join(store.keep(told, "thresholds"), _SOURCE)
    return mixed.select(*carried, F.when(F.col("known"), F.col("source")).alias("source"), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), copies and taken (words, repeats counted) of each row.
    Another ``seed`` takes other documents."""
    own = Columns(only(docs, doc_id, text, source))
    return _mix(own, [own.of(doc_id)], weights, most, seed, text, doc_id, source).withColumnRenamed(own.of(doc_id), doc_id)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed corpus itself: each row of ``docs``, with all its columns, as often as it is taken."""
    own = Columns(docs)
    taken = _mix(own, own.all, weights, most, seed, text, doc_id, source).where("copies > 0")
    return own.back(taken.select(*own.all, F.explode(F.sequence(F.lit(1), "copies"))))
