"""Similar names: pairs of 95 % similarity or more, by segments, without loss.

That allows t edits, t the 5.5 % of both lengths, so at most 11 % of the longer one's. Of t + 1 segments that one name is cut into, t edits leave one
whole, shifted by t places at most. For few edits a key is the shorter name's length, the segment's place and its text, and the longer name probes
the substrings that can equal it. For many edits segments are about nine characters whatever the length: a key is the text alone, and the longer
name probes each of its substrings of the lengths that segments have; t is rounded up to a class then, so that both sides cut alike.
All keys of a name are made in its row, by functions of its length: one explode and one join on hashes, whose plan knows nothing of the lengths.

Defined cases: null names go; equal names are one; names under ten characters allow no edit and have no partner; the empty name has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settle

#: Edits by per mille of the longer length, the most edits with keys by place, and the growth of classes beyond.
EDITS, FEW, GROWTH = 110, 6, 1.25


def _int(c: Column) -> Column:
    return c.cast("int")


def _start(size: Column, i: Column, cuts: Column) -> Column:
    return _int(F.floor(size * i / cuts))


def _class(t: Column) -> Column:
    """The class of a number of edits above FEW, and its upper bound."""
    return _int(F.ceil(F.log(t / F.lit(FEW + 1.0)) / F.log(F.lit(GROWTH)) - 1e-9))


def _bound(c: Column) -> Column:
    return _int(F.ceil(F.pow(F.lit(GROWTH), c) * (FEW + 1) - 1e-9))


def _upto(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _each(values: Column, f) -> Column:
    return F.flatten(F.transform(values, f))


def _indexed(name: Column, size: Column) -> Column:
    """The keys of a name as the shorter one (or of equal length)."""

    def few(t: Column) -> Column:
        # there is a longer name of a length for which t edits are right
        low, high = F.ceil(t * 1000 / EDITS), F.ceil((t + 1) * 1000 / EDITS) - 1
        fits = (F.greatest(size, low) <= F.least(size + t, high)) & (size > t)
        own = F.transform(F.sequence(F.lit(0), t), lambda i: F.xxhash64(t, size, i, F.substring(name, _start(size, i, t + 1) + 1, _start(size, i + 1, t + 1) - _start(size, i, t + 1))))
        return F.when(fits, own).otherwise(F.array().cast("array<bigint>"))

    def many(c: Column) -> Column:
        cuts = _bound(c) + 1
        return F.transform(F.sequence(F.lit(0), _bound(c)), lambda i: F.xxhash64(-c, F.substring(name, _start(size, i, cuts) + 1, _start(size, i + 1, cuts) - _start(size, i, cuts))))

    most = _int(F.floor(size * EDITS / (1000 - EDITS))) + 1  # of the longest name that can be near
    least = F.greatest(_int(F.floor(size * EDITS / 1000)), F.lit(FEW + 1))
    return F.concat(_each(_upto(F.lit(1), F.lit(FEW)), few), _each(F.when(most > FEW, _upto(_class(least), _class(most))).otherwise(F.array().cast("array<int>")), many))


def _probes(name: Column, size: Column) -> Column:
    """The keys that a name asks for as the longer one."""
    t = _int(F.floor(size * EDITS / 1000))

    def few(less: Column) -> Column:
        other = size - less

        def of(i: Column) -> Column:
            at, width = _start(other, i, t + 1), _start(other, i + 1, t + 1) - _start(other, i, t + 1)
            # shifts that the segments before and after can pay for, inside the name
            low, high = F.greatest(-i, less - (t - i), -at), F.least(i, less + (t - i), size - width - at)
            return F.transform(_upto(low, high), lambda s: F.xxhash64(t, other, i, F.substring(name, at + s + 1, width)))

        return _each(F.sequence(F.lit(0), t), of)

    cuts = _bound(_class(t)) + 1
    widths = _upto(_int(F.floor((size - t) / cuts)), _int(F.floor(size / cuts)) + 1)
    many = _each(widths, lambda w: F.transform(_upto(F.lit(1), size - w + 1), lambda p: F.xxhash64(-_class(t), F.substring(name, p, w))))
    return F.when(t < 1, F.array().cast("array<bigint>")).when(t <= FEW, _each(F.sequence(F.lit(0), t), few)).otherwise(many)


def near_names(names: DataFrame) -> DataFrame:
    """Pairs (a, b, ratio) of distinct names (name), a before b, of 95 % similarity or more, rounded."""
    n = settle(names.select("name").filter("name is not null").distinct().select(F.monotonically_increasing_id().alias("id"), "name", F.length("name").alias("size")))
    # keys go with numbers, not with names
    long_ = n.select(F.col("id").alias("x"), F.col("size").alias("sx"), F.explode(F.array_distinct(_probes(F.col("name"), F.col("size")))).alias("key"))
    index = n.select(F.col("id").alias("y"), F.col("size").alias("sy"), F.explode(F.array_distinct(_indexed(F.col("name"), F.col("size")))).alias("key"))
    apart = F.floor((F.col("sx") + F.col("sy")) * EDITS / 2000)
    met = settle(long_.join(index, "key").filter((F.col("x") != F.col("y")) & (F.col("sy") <= F.col("sx")) & (F.col("sx") - F.col("sy") <= apart)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    named = met.join(n.select(F.col("id").alias("x"), F.col("name").alias("_a")), "x").join(n.select(F.col("id").alias("y"), F.col("name").alias("_b")), "y")
    pairs = named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).withColumn("_t", F.length("a") + F.length("b"))
    near = pairs.withColumn("_d", F.call_function("levenshtein", F.col("a"), F.col("b"), _int(F.floor(F.col("_t") * EDITS / 2000)))).filter("_d >= 0")
    return near.select("a", "b", F.round((F.col("_t") - F.col("_d")) / F.col("_t") * 100, 0).cast("long").alias("ratio")).filter("ratio >= 95")
