"""Line dedup by a segment-partition edit join.

Lines are trimmed, and equal ones (by 96 bits of hashes) are one row before anything is joined. A line
of LENGTH characters is split into threshold + 1 segments; two lines within the
threshold share one whole segment, up to a shift. So every line probes, for each length that
a partner may have, the few substrings that can equal that partner's segments
(the window of shifts that both ends allow), in an index keyed by length, place and
substring. Candidates are verified by banded bit-parallel edit distance: for
each number of errors one word holds the states of the band's diagonals.

With `words_per_edit`, lines of changed words link as well: two lines are also near if one
becomes the other by one edit of a word (changed, added or left out) for each `words_per_edit` words
of the shorter, or if the Jaccard similarity of their distinct shingles of five words is 0.8 or more.
One edit touches five shingles at most, so either way both lines share enough shingles
that, in the order of hashes, the first few of each line hold a common one: a prefix join that loses no pair.
An edit of a character touches six shingles at most, so a line that has more than all its edits can touch is not indexed by
segments: its first few shingles find what its segments would.

A line goes if it equals an earlier one, or if an earlier line is near;
earlier: by (doc_id, line number) of the first occurrence. So a line needs one earlier partner, not all of them:
lines that share a key meet the earliest of them first, those that found none the first few, and only what is
still without a partner meets the rest. Thousands of variants of a line so make few pairs, and no link that decides is lost.

Lines under `min_chars` are only compared for equality; with `chars_per_edit`, a line is allowed one edit for each
so many characters, up to the threshold, so short lines are compared as strictly as they are short. Blank lines stay.

Defined cases: a null or empty text has one blank line; repeated rows of equal id and text are one
document and are cleaned alike; null ids come first; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, same, settle, table, words
from .decontaminate import windows

THRESHOLD, MIN_CHARS = 2, 24
#: Characters of a line for each edit that op6 allows, up to THRESHOLD.
CHARS_PER_EDIT = 12
#: How many of the earliest lines of a key a line meets, round by round; None: all.
ROUNDS = (1, 16, None)
#: Words of a shingle, and words of a line for each edit of a word that op6 allows.
SHINGLE, WORDS_PER_EDIT = 5, 20
#: Shingles that an edit of a character touches at most: of one word, or of two that it joins.
TOUCHED = SHINGLE + 1
#: One document of so many (by hash, in expectation) tells frequent shingles, within these bounds; and the buckets that shingles are counted in.
RATE, SAMPLE, BUCKETS = 25, (5_000, 200_000), 1 << 18
#: Lines of the sample that make a shingle frequent, and times that make a line one whose keys are made once.
OFTEN, REPEATED = 3, 20
#: Lines to verify up to which their hashes are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_LINES = 1_000_000
BLANKS = " \t\n\x0b\f\r"


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, line_no, line) of the lines that are not blank."""
    # outer, though no array here is empty: Spark else works an array out once more to see whether it is
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode_outer(F.split(text, "\n")).alias("line_no", "raw"))
    return base.select("doc_id", "text_key", "line_no", F.btrim("raw", F.lit(BLANKS)).alias("line")).filter("line <> ''")


def allowed(length: Column, threshold: int, chars_per_edit: int | None) -> Column:
    """Edits that a line of this length, the shorter of a pair, allows."""
    return F.least(F.lit(threshold), F.floor(length / chars_per_edit).cast("int")) if chars_per_edit else F.lit(threshold)


def edit_keys(line: Column, length: Column, threshold: int, min_chars: int, chars_per_edit: int | None = None) -> tuple[Column, int]:
    """Keys (or null) that a line shares with each line of its length or up to `threshold` shorter that is within the edits; and their number.

    The last bit of a key is 1 where the line itself is indexed: its own segments, unshifted.
    """
    places = []
    for most in range(1 if chars_per_edit else threshold, threshold + 1):
        for delta in range(most + 1):
            for i in range(most + 1):
                # shifts that the segments before and after can pay for
                low, high = max(-i, delta - (most - i)), min(i, delta + (most - i))
                places += [F.struct(*[F.lit(v).alias(k) for k, v in (("most", most), ("delta", delta), ("i", i), ("shift", shift))]) for shift in range(low, high + 1)]

    def key(p: Column) -> Column:
        other, n = length - p["delta"], p["most"] + 1
        here = (other >= min_chars) & (other > p["most"]) & (allowed(other, threshold, chars_per_edit) == p["most"])
        # segments of nearly one length, the longer ones last
        short = n - other % n
        size = F.floor(other / n).cast("int")
        at = size * p["i"] + F.greatest(F.lit(0), p["i"] - short) + p["shift"]
        size = size + F.when(p["i"] >= short, 1).otherwise(0)
        own = F.xxhash64(other, p["i"], F.substring(line, at + 1, size)).bitwiseAND(F.lit(-4))
        return F.when(here & (at >= 0) & (at + size <= length), own.bitwiseOR(F.when((p["delta"] == 0) & (p["shift"] == 0), F.lit(1)).otherwise(0)))

    return F.transform(F.array(*places), key), len(places)


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two lines are within `threshold` edits.

    Bit d of word e says that the first j + d - threshold characters of a and the first j of b
    are within e edits; a step takes b's next character.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    chars = [F.regexp_extract_all(x, F.lit(r"(?s)."), F.lit(0)) for x in (a, b)]
    state = F.struct(*[F.lit(sum(1 << (threshold + d) for d in range(e + 1))).alias(f"r{e}") for e in range(threshold + 1)])

    def distance(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]

        def step(s: Column, j: Column) -> Column:
            c = F.get(y, j)
            match = sum((F.when(F.get(x, j + (d - threshold)) == c, 1 << d).otherwise(0) for d in range(width)), F.lit(0))
            rows, last_new = [], None
            for e in range(threshold + 1):
                new = s[f"r{e}"].bitwiseAND(match)
                if e:
                    old = s[f"r{e - 1}"]
                    # replaced; b has one more; a has one more
                    new = new.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(last_new, 1).bitwiseAND(F.lit(full)))
                last_new = new
                rows.append(new.alias(f"r{e}"))
            return F.struct(*rows)

        steps = F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.array().cast("array<int>"))
        end = F.size(x) - F.size(y) + threshold
        return F.aggregate(steps, state, step, lambda s: (end >= 0) & (end < width) & (F.call_function("shiftright", s[f"r{threshold}"], F.least(F.greatest(end, F.lit(0)), F.lit(width))).bitwiseAND(F.lit(1)) == 1))

    return F.get(F.transform(F.array(F.struct(chars[0].alias("x"), chars[1].alias("y"))), distance), F.lit(0))


def bind(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def line_words(line: Column) -> Column:
    """The words of a trimmed line; a pattern is matched only where single blanks don't part them all."""
    odd = [F.contains(line, F.lit(x)) for x in ("  ", *BLANKS[1:])]
    return F.when(reduce(or_, odd), words(line)).otherwise(F.split(line, " "))


def word_hashes(line: Column) -> Column:
    """A hash for each word of a line."""
    return F.transform(line_words(line), lambda x: F.xxhash64(x))


def line_shingles(w: Column, of=F.xxhash64) -> Column:
    """Hashes of the shingles of hashed words."""
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))), lambda x, i: of(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))


def sampled(docs: DataFrame) -> DataFrame:
    """Rows (line, n) of the lines of a sample of documents."""
    n = docs.count()
    rate = max(1, n // min(max(n // RATE, SAMPLE[0]), SAMPLE[1]))
    return lines_of(docs.filter(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(rate)) == 0)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def frequent(few: DataFrame) -> bytes:
    """A byte for each bucket of shingle hashes: 1 if several lines of a sample have one of its shingles.

    The sample decides only which shingles of a line come last, and so the cost, never a result.
    """
    counted = few.select(F.explode_outer(F.array_distinct(bind(word_hashes(F.col("line")), lambda w: line_shingles(w)))).alias("h")).groupBy("h").count()
    # at most BUCKETS rows; the bucket of a shingle that is not frequent is seldom that of one that is
    found = counted.filter((F.col("count") >= OFTEN) & F.col("h").isNotNull()).select(F.shiftrightunsigned("h", 46).alias("h")).distinct().toArrow()
    out = bytearray(BUCKETS)
    for h in found["h"].to_pylist():
        out[h] = 1
    return bytes(out)


def word_keys(line: Column, words_per_edit: int, late: bytes, touched: int) -> Column:
    """The first shingle hashes of a line, as keys of their own kind (the second last bit is 1) that are all indexed; `long`: they find edits of characters, too.

    Of two lines that are so near that `touched` shingles of either differ at most, one of them long, both have a common one of their first
    touched + 1: the other has two words less at most.
    """

    def often(h: Column) -> Column:
        return F.substring(F.lit(late), F.shiftright(h, 44).cast("int") + 1, 1) == F.lit(b"\x01")

    least = touched + SHINGLE  # words of a long line

    def cut(w: Column, s: Column) -> Column:
        more = F.when(F.size(w) >= least - touched // TOUCHED, touched).otherwise(0)
        first = (F.greatest(F.floor(F.size(w) / words_per_edit) * SHINGLE, F.floor(F.size(s) / 5), more) + 1).cast("int")

        def last(few: Column) -> Column:
            # frequent ones come last: where the first few hold none, they stay the first
            return F.when(F.exists(few, often), F.slice(F.concat(F.filter(s, lambda h: ~often(h)), F.filter(s, often)), F.lit(1), first)).otherwise(few)

        keys = F.transform(bind(F.slice(s, F.lit(1), first), last), lambda h: h.bitwiseOR(F.lit(3)))
        return F.struct(keys.alias("keys"), ((F.size(w) >= least) & (F.size(s) > touched)).alias("long"))

    return bind(word_hashes(line), lambda w: bind(F.sort_array(F.array_distinct(line_shingles(w, lambda *x: F.shiftrightunsigned(F.xxhash64(*x), 2)))), lambda s: cut(w, s)))


def line_keys(lines: DataFrame, threshold: int, min_chars: int, chars_per_edit: int | None, words_per_edit: int | None, late: bytes = b"") -> DataFrame:
    """The lines with `_keys`, whose first is null, and `_skip`: the place of the last key that is no shingle."""
    length = F.length("line")
    own, n = edit_keys(F.col("line"), length, threshold, min_chars, chars_per_edit)
    none, skip = F.array(F.lit(None).cast("long")), F.lit(n + 1)
    keys = F.concat(none, own)
    if words_per_edit:
        lines = lines.withColumn("_w", F.when(length >= min_chars, word_keys(F.col("line"), words_per_edit, late, threshold * TOUCHED)))
        keys = F.when(F.col("_w.long"), F.concat(none, "_w.keys")).otherwise(F.concat(keys, "_w.keys"))
        skip = F.when(F.col("_w.long"), 1).otherwise(skip)
    return lines.withColumns({"_keys": F.when(length >= min_chars, keys).otherwise(none), "_skip": skip})


def met_keys(keyed: DataFrame) -> DataFrame:
    """Of rows (group, a, indexed, place), those of groups that several lines have, one of them indexed, and those with a place."""
    of, of_key = Window.partitionBy("group"), F.when(F.col("place").isNull(), F.col("a"))
    met = keyed.withColumns({"_low": F.min(of_key).over(of), "_high": F.max(of_key).over(of), "_any": F.max("indexed").over(of)})
    return met.filter("place is not null or _low <> _high and _any > 0").drop("_low", "_high", "_any")


def once(met: DataFrame) -> DataFrame:
    """Rows (group, a, indexed, by_words) of the rows without a place."""
    # a line that is indexed under a key and also probes with it counts as indexed
    return met.filter("place is null").groupBy("group", "a").agg(F.max("indexed").alias("indexed")).withColumn("by_words", F.col("group").bitwiseAND(F.lit(1)).cast("int"))


def exploded(lines: DataFrame, *columns: str) -> DataFrame:
    """Rows (group, a, indexed, place) of lines with keys, and with columns one for each line that has them as `place`, in a group by chance.

    indexed: 1 or 0, and of a shingle 1 plus twice its place in the line's order.
    """
    keyed = lines.select("a", *columns, "_skip", F.posexplode_outer("_keys").alias("_at", "key")).filter("key is not null or _at = 0")
    indexed = F.col("key").bitwiseAND(F.lit(1)).cast("int") + F.greatest(F.col("_at") - F.col("_skip"), F.lit(0)) * 2
    place = F.when(F.col("_at") == 0, F.struct(*columns)) if columns else F.lit(None)
    group = F.coalesce(F.shiftright("key", 1), F.shiftrightunsigned("a", 2))
    return (keyed if columns else keyed.filter("key is not null")).select(group.alias("group"), "a", indexed.alias("indexed"), place.alias("place"))


def shared_keys(lines: DataFrame, threshold: int, min_chars: int, chars_per_edit: int | None, words_per_edit: int | None, late: bytes = b"") -> DataFrame:
    """Rows (group, a, indexed, by_words) of the keys that several lines have, one of them indexed; lines: rows (line), repeats included."""
    keyed = line_keys(lines.select("line", F.xxhash64("line").alias("a")), threshold, min_chars, chars_per_edit, words_per_edit, late)
    return once(met_keys(exploded(keyed)))


def coded(w: Column, code) -> Column:
    """A text with one character for each word."""
    return F.decode(F.unhex(F.array_join(F.transform(w, lambda x: F.lpad(F.hex(code(x) + 0x10000), 8, "0")), "")), "UTF-32")


def sketch(w: Column) -> Column:
    """A text with one of 94 characters for each hashed word."""
    return F.array_join(F.transform(w, lambda x: F.char((F.pmod(x, F.lit(94)) + 33).cast("long"))), "")


def word_near(a: Column, b: Column, words_per_edit: int) -> Column:
    """Whether two lines are near by their words."""

    def edits(p: Column) -> Column:
        most = F.floor(F.least(F.size(p["x"]), F.size(p["y"])) / words_per_edit).cast("int")

        def close(code) -> Column:
            return F.call_function("levenshtein", coded(p["x"], code), coded(p["y"], code), most) >= 0

        # hashes never make lines look further apart: the numbering of words is for the few that remain
        return close(lambda x: F.pmod(F.xxhash64(x), F.lit(1_000_000))) & bind(F.array_distinct(F.concat(p["x"], p["y"])), lambda all_: close(lambda x: F.array_position(all_, x)))

    def similar(p: Column) -> Column:
        own = [F.array_distinct(F.transform(windows(p[k], SHINGLE), lambda s: F.concat_ws(" ", s))) for k in "xy"]
        return bind(F.struct(own[0].alias("s"), own[1].alias("t")), lambda q: F.size(F.array_intersect(q["s"], q["t"])) * 9 >= (F.size(q["s"]) + F.size(q["t"])) * 4)

    return bind(F.struct(words(a).alias("x"), words(b).alias("y")), lambda p: F.when(edits(p), True).otherwise(similar(p)))


def removals(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, words_per_edit: int | None = None, chars_per_edit: int | None = None) -> DataFrame:
    """Rows (doc_id, text_key, line_no, why) of the lines that go; why: exact or near."""
    hashed = [F.xxhash64("line").alias("a"), F.hash("line").alias("b")]
    lines = lines_of(docs).select("*", *hashed)
    rules = threshold, min_chars, chars_per_edit, words_per_edit
    with Scratch(docs.sparkSession) as scratch:
        few = scratch.keep(sampled(docs))
        late = frequent(few) if words_per_edit else b""
        # a line that is met again and again has its keys made once
        bound = max(REPEATED, (few.agg(F.sum("n")).first()[0] or 0) // BROADCAST_LINES)
        again = scratch.keep(few.filter(F.col("n") >= bound).select("line", *hashed))
        own = line_keys(lines.join(F.broadcast(again.select("a", "b", F.lit(True).alias("_again"))), ["a", "b"], "left"), *rules, late)
        own = own.withColumn("_keys", F.when(F.col("_again"), F.slice("_keys", 1, 1)).otherwise(F.col("_keys")))
        place = ["b", "doc_id", "text_key", "line_no"]
        keyed = exploded(own, *place).unionByName(exploded(line_keys(again, *rules, late)).withColumn("place", F.lit(None).cast("struct<b:int,doc_id:bigint,text_key:bigint,line_no:int>")))
        met = scratch.keep(met_keys(keyed))
        scratch.free()  # the shuffle of all keys, several times what is left of them
        places = met.filter("place is not null").select("a", "place.*")
        distinct = settle(places.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line_no", "text_key")).alias("first")))
        keyed = scratch.keep(once(met))
        ids = scratch.keep(distinct.join(keyed.select("a").distinct(), "a", "left_semi").select("a", "b", "first"))
        texts = scratch.keep(texts_of(lines, ids, words_per_edit))
        scratch.free()
        later = settle(near_earlier(scratch, keyed, texts, threshold, words_per_edit, chars_per_edit))
        marks = distinct.join(later.withColumn("near", F.lit(True)), ["a", "b"], "left").filter("n > 1 or near")
        joined = places.distinct().join(marks, ["a", "b"])
        again = ~(F.struct("doc_id", "line_no", "text_key").eqNullSafe(F.col("first")))
        return settle(joined.filter(again | F.col("near")).select("doc_id", "text_key", "line_no", F.when(again, "exact").otherwise("near").alias("why")))


def texts_of(lines: DataFrame, ids: DataFrame, words_per_edit: int | None) -> DataFrame:
    """Rows (a, b, line, first, size) of the lines that share a key; size: what tells most lines apart without their texts.

    `odd` has a bit for each bucket of shingles: whether their number is odd. Each shingle that one line has and the other has not changes one bit.
    """
    hint = F.broadcast if ids.count() <= BROADCAST_LINES else lambda x: x
    first = F.struct("doc_id", "line_no", "text_key").eqNullSafe(F.col("first"))
    few = lines.join(hint(ids), ["a", "b"]).filter(first).select("a", "b", "line", "first").dropDuplicates(["a", "b"])

    def odd(h: Column, lane: int) -> Column:
        flip = lambda s, x: F.when(F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(1)) == lane, s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))).otherwise(s)
        return F.aggregate(h, F.lit(0).cast("long"), flip)

    if not words_per_edit:
        return few.withColumn("size", F.struct(F.length("line").alias("c")))
    size = bind(word_hashes(F.col("line")), lambda w: bind(F.array_distinct(line_shingles(w)), lambda s: F.struct(F.length("line").alias("c"), F.size(w).alias("w"), F.size(s).alias("n"), odd(s, 0).alias("even"), odd(s, 1).alias("odd"), sketch(w).alias("code"), F.transform(s, lambda x: F.shiftright(x, 32).cast("int")).alias("grams"))))
    return few.withColumn("size", size)


def near_earlier(scratch: Scratch, keyed: DataFrame, texts: DataFrame, threshold: int, words_per_edit: int | None, chars_per_edit: int | None) -> DataFrame:
    """Rows (a, b) of the lines to which an earlier line is near."""
    of, order = Window.partitionBy("group"), Window.partitionBy("group").orderBy("first", "b")
    size = [F.col(f"size.{c}") for c in (("c", "w", "n", "even", "odd") if words_per_edit else ("c",))]
    members = keyed.join(texts.select("a", "b", "first", F.struct(*size).alias("size")), "a")
    me = F.struct("a", "b", "size", "indexed")
    members = members.withColumns({"rank": F.row_number().over(order), "members": F.count(F.lit(1)).over(of), "head": F.first(me).over(order)})
    members = scratch.keep(members.select("group", "a", "b", "size", "indexed", "by_words", "rank", "members", F.when(F.col("rank") > 1, F.col("head")).alias("head")))
    scratch.free()
    found, low = None, 0
    apart = F.abs(F.col("x.size.c") - F.col("y.size.c")) <= threshold
    if words_per_edit:
        # shingles that one of both has, at least: each changes a bit at most
        unlike = F.bit_count(F.col("x.size.even").bitwiseXOR(F.col("y.size.even"))) + F.bit_count(F.col("x.size.odd").bitwiseXOR(F.col("y.size.odd")))
        alike = (F.least("x.size.n", "y.size.n") * 5 >= F.greatest("x.size.n", "y.size.n") * 4) & (unlike * 9 <= F.col("x.size.n") + F.col("y.size.n"))
        # what comes before the shared shingle is not shared, and what follows must be enough for either rule; an edit takes five shingles at most
        most = F.floor(F.least("x.size.w", "y.size.w") / words_per_edit) * SHINGLE
        changed = (F.abs(F.col("x.size.w") - F.col("y.size.w")) * SHINGLE <= most) & (unlike <= most * 2)
        need = F.least(F.ceil((F.col("x.size.n") + F.col("y.size.n")) * 4 / 9), F.greatest("x.size.n", "y.size.n") - most)
        left = F.least(*[F.col(f"{k}.size.n") - F.shiftright(f"{k}.indexed", 1) for k in "xy"])
        as_words = (F.col("x.by_words") > 0) & (alike | changed) & (left >= need)
        as_chars = apart & (unlike <= 2 * threshold * TOUCHED) & ((F.col("x.by_words") == 0) | (left >= F.greatest("x.size.n", "y.size.n") - threshold * TOUCHED))
    else:
        as_words, as_chars = F.lit(False), apart
    fits = as_words | as_chars

    def needed(pairs: DataFrame) -> dict[str, DataFrame]:
        """For either side of the pairs, the texts and sizes of the lines that it has: no others are dealt out."""
        few = F.broadcast if pairs.count() <= BROADCAST_LINES else lambda x: x
        ids = {k: pairs.select(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")).distinct() for k in "xy"}
        return {k: texts.select("a", "b", F.struct("line", "size").alias(k)).join(few(i), ["a", "b"], "left_semi").withColumnsRenamed({"a": f"a{k}", "b": f"b{k}"}) for k, i in ids.items()}

    for high in ROUNDS:
        x = members.filter((F.col("members") > low + 1) & (F.col("rank") > low + 1))
        if found is not None:
            x = x.join(found, ["a", "b"], "left_anti")
        if high == 1:  # the earliest line of a key came with the window
            met = x.select(F.struct(*x.columns).alias("x"), F.col("head").alias("y")).filter((F.col("x.indexed") + F.col("y.indexed") > 0) & fits)
        else:
            y = members.filter((F.col("members") > low + 1) & (F.col("rank") > low))
            if high:
                y = y.filter(F.col("rank") <= high)
            y = y.select("group", "rank", F.struct("a", "b", "size", "indexed").alias("y"))
            met = x.select("group", "rank", F.struct("a", "b", "size", "indexed", "by_words").alias("x")).alias("l").join(y.alias("r"), (F.col("l.group") == F.col("r.group")) & (F.col("r.rank") < F.col("l.rank")) & (F.col("x.indexed") + F.col("y.indexed") > 0) & fits)
        pairs = met.select(*[F.col(f"{k}.{c}").alias(f"{c}{k}") for k in "xy" for c in "ab"], as_words.alias("words"), as_chars.alias("chars")).groupBy("ax", "bx", "ay", "by").agg(F.bool_or("words").alias("words"), F.bool_or("chars").alias("chars"))
        pairs = scratch.keep(pairs)
        scratch.free()
        one = needed(pairs)
        told = pairs.join(one["x"], ["ax", "bx"]).join(one["y"], ["ay", "by"])
        chars, by_words = F.col("chars"), F.lit(False)
        if words_per_edit:
            # hashes never make lines look further apart: only what passes is compared word by word
            shared = F.size(F.array_intersect("x.size.grams", "y.size.grams"))
            told = told.withColumn("_both", shared)
            edits = F.floor(F.least("x.size.w", "y.size.w") / words_per_edit).cast("int")
            larger = F.greatest("x.size.n", "y.size.n")
            # of hashes a similarity of 0.7 is asked for: distinct shingles may look the same in them
            like = F.col("_both") * 17 >= (F.col("x.size.n") + F.col("y.size.n")) * 7
            close = (F.col("_both") >= larger - edits * SHINGLE) & (F.call_function("levenshtein", F.col("x.size.code"), F.col("y.size.code"), edits) >= 0)
            chars = chars & (F.col("_both") >= larger - threshold * TOUCHED)
            by_words = F.col("words") & (like | close) & word_near(F.col("x.line"), F.col("y.line"), words_per_edit)
        most = allowed(F.least(F.length("x.line"), F.length("y.line")), threshold, chars_per_edit)
        # the bounded built-in distance turns most candidates away at less cost
        hit = (chars & (F.levenshtein("x.line", "y.line", threshold).between(0, most)) & within(F.col("x.line"), F.col("y.line"), threshold)) | by_words
        new = told.filter(hit).select(F.col("ax").alias("a"), F.col("bx").alias("b")).distinct()
        new = scratch.keep(new)
        found = new if found is None else found.union(new)
        low = high
    return found


def counts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """One row for each document row: n_lines and the numbers of lines that go."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    per = gone.groupBy("doc_id", "text_key").agg(F.count(F.when(F.col("why") == "exact", 1)).alias("n_exact"), F.count(F.when(F.col("why") == "near", 1)).alias("n_near"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    out = base.alias("d").join(per.alias("g"), same("d", "g", "doc_id", "text_key"), "left")
    return out.select("d.doc_id", "d.n_lines", F.coalesce("g.n_exact", F.lit(0)).cast("long").alias("n_exact"), F.coalesce("g.n_near", F.lit(0)).cast("long").alias("n_near"))


def dedupe(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, words_per_edit: int | None = None, chars_per_edit: int | None = None) -> DataFrame:
    """The documents with the lines that go left out of their texts; other columns as they are."""
    gone = removals(docs, threshold, min_chars, words_per_edit, chars_per_edit).groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("_gone"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"))
    joined = own.alias("d").join(gone.alias("g"), F.col("d.id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.key") == F.col("g.text_key")), "left")
    kept = F.array_join(F.transform(F.filter(F.transform(F.split(F.col("d.row.text"), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("g._gone"), s["i"])), lambda s: s["x"]), "\n")
    return joined.select(*[(F.when(F.col("g._gone").isNull(), F.col("d.row.text")).otherwise(kept).alias("text") if c == "text" else F.col("d.row")[c].alias(c)) for c in docs.columns])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return counts(docs, removals(docs, min_chars=CHARS_PER_EDIT, words_per_edit=WORDS_PER_EDIT, chars_per_edit=CHARS_PER_EDIT))
