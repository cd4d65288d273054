"""Near copies by SimHash: fingerprints of five-word shingles, compared bit-sliced, then verified on the shingles.

A text is the set of its distinct shingles of `shingle` words, A-Z lower-cased; fewer words make one
shingle, no words the empty one. Texts link at a Jaccard similarity of `SIMILARITY`, 4/5, or more.

Candidates: such texts share four fifths of either set, so in any one order of shingles the first n // 5 + 1
of both hold a common one. These are the keys; texts of a key meet, if the shingles from the key on can still be enough. In the order, shingles that a sample
of texts often holds come last, which keeps keys' groups small; the sample changes no result.

In a group, SimHash fingerprints are compared bit-sliced by the counters of `simhash`. At a similarity of 4/5 the
sets' cosine is 8/9 and the angle 0.476, so each of 64 bits differs with probability 0.152: 9.7 bits in the mean, 2.9 in deviation.
RADIUS lies 3.6 deviations above: about one linked pair in 5000 at the very edge goes by, and unrelated texts pass once in 500.
What passes is verified on the hashes of all shingles. Long groups are cut into blocks of BLOCK texts; blocks meet pair by pair, in tasks of their own.

A text first meets the earliest texts of a key, then those of other components only: thousands of copies of a text
make few pairs, and no link between components is lost.

Defined cases: null and empty texts are one text, whose only shingle is the empty one; texts of fewer words than a shingle are near only if their words are equal;
repeated texts are one text here, and `simhash.without_copies` keeps one row of them; ids and further columns are not read; an empty table has no copies; a
very long text is a set of hashes, so its repeats cost nothing, and it meets only texts whose number of shingles fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

SEED, SHINGLE, RADIUS = 42, 5, 20
#: One text of so many is in the sample, within these bounds; how often the sample must hold a shingle, and the most of these that come last.
RATE, SAMPLE, OFTEN, FREQUENT = 25, (2_000, 200_000), 3, 1_000_000
#: Texts of a group that meet as one block, and partners that a text is verified with, round by round; None: all.
BLOCK, ROUNDS = 512, (1, 8, None)
#: Texts up to which keys of texts are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_TEXTS = 1_000_000


def shingles(text: bytes | None, shingle: int = SHINGLE) -> set[bytes]:
    w = (text or b"").lower().split()
    return {b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}


def hashes(text: bytes | None, shingle: int = SHINGLE):
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    return np.unique(np.fromiter((digest(s, SEED) for s in shingles(text, shingle)), np.uint64))


def fingerprint_of(found) -> int:
    """The SimHash of distinct shingle hashes."""
    import numpy as np

    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(found), bitorder="little").view(np.int64)[0])


def key_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _keys(texts: DataFrame, shingle: int, last=None) -> DataFrame:
    """Rows (k, n, fp, key, place) of the first shingles of each text, or of all where `last` is None."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            own, size, prints, places, all_ = batch.column(0).to_numpy(), [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                h = hashes(t.as_py(), shingle)
                size.append(len(h))
                prints.append(fingerprint_of(h))
                h = h.view(np.int64)
                if last is not None:
                    late = last[np.searchsorted(last, h).clip(max=len(last) - 1)] == h if len(last) else np.zeros(len(h), bool)
                    h = np.concatenate([h[~late], h[late]])[: len(h) // 5 + 1]
                all_.append(h)
                places.append(np.arange(len(h), dtype=np.int32))
            times = [len(h) for h in all_]
            columns = [np.repeat(own, times), np.repeat(np.array(size, np.int32), times), np.repeat(np.array(prints, np.int64), times), np.concatenate(all_), np.concatenate(places)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "n", "fp", "key", "place"])

    return texts.mapInArrow(run, "k long, n int, fp long, key long, place int")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (k, s): 32 bits of the hash of each distinct shingle of a text; two shingles share them once in four billion."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = [np.unique(hashes(t.as_py(), shingle).astype(np.uint32)).view(np.int32) for t in batch.column(1).cast(pa.binary())]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            flat = np.concatenate(own) if own else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k", "s"])

    return texts.mapInArrow(run, "k long, s array<int>")


def _fits(n, place, i, j):
    """Whether texts of n shingles that first agree at these places of their orders can still share enough: what comes before is not shared."""
    import numpy as np

    return np.minimum(n[i] - place[i], n[j] - place[j]) * 9 >= (n[i] + n[j]) * 4


def _groups(keys: DataFrame, radius: int) -> DataFrame:
    """Rows (key, k, n, fp, place, block, size, first) of keys that several texts have.

    first: the earliest text of the key, among its first BLOCK, whose fingerprint is near and which is before this one; null if none.
    block: which BLOCK of the key's texts it is in; size: the number of them, 0 beyond BLOCK. A task holds
    one batch and the first block of a key, however long the key's group is.
    """
    schema = "key long, k long, n int, fp long, place int, block int, size int, first long"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import simhash

        def firsts(key, k, n, fp, place, runs):
            """For each row the index of its first near row in its run, or -1."""
            out = np.full(len(k), -1)
            i, j = simhash.shifted_links(fp.view(np.uint64), runs, radius)
            good = _fits(n, place, i, j) & (k[i] != k[j])
            i, j = i[good], j[good]
            order = np.lexsort((-i, j))  # the smallest i of a j is written last
            out[j[order]] = i[order]
            return out

        def batch_of(rows, block, size, whole, first):
            """first: places in `whole`, the texts' keys that were compared."""
            key, k, n, fp, place = rows
            none = first < 0
            to = np.where(none, 0, whole[np.where(none, 0, first)])
            small = [pa.array(x.astype(np.int32)) for x in (place, block, size)]
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(k), pa.array(n.astype(np.int32)), pa.array(fp), *small, pa.array(to, mask=none)], names=["key", "k", "n", "fp", "place", "block", "size", "first"])

        def told(rows):
            """Whole runs of at most BLOCK rows."""
            key, k = rows[:2]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[start, len(key)])
            runs = np.repeat(np.arange(len(start)), length)
            several = (np.maximum.reduceat(k, start) != np.minimum.reduceat(k, start))[runs]
            rows, runs = rows[:, several], runs[several]
            return batch_of(rows, np.zeros(len(runs)), length[runs], rows[1], firsts(*rows, runs))

        def long_run(rows, head, at):
            """A part of a long run: its rows from place `at` on meet the first block."""
            out = []
            for lo in range(0, rows.shape[1], BLOCK):
                part = rows[:, lo : lo + BLOCK]
                both = np.concatenate([head, part], axis=1) if at + lo >= BLOCK else part
                skip = both.shape[1] - part.shape[1]
                first = firsts(*both, np.zeros(both.shape[1], np.int64))[skip:]
                out.append(batch_of(part, (at + lo + np.arange(part.shape[1])) // BLOCK, np.zeros(part.shape[1]), both[1], first))
            return out

        held, head, at = np.zeros((5, 0), np.int64), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            if held.shape[1] < simhash.LANES:
                continue
            yield from _parts(held, told, long_run, state := {"head": head, "at": at}, False)
            held, head, at = state["rest"], state["head"], state["at"]
        if held.shape[1]:
            yield from _parts(held, told, long_run, {"head": head, "at": at}, True)

    dealt = keys.select("key", "k", "n", "fp", "place").repartition("key").sortWithinPartitions("key", "k")
    return dealt.mapInArrow(run, schema)


def _parts(rows, told, long_run, state: dict, last: bool):
    """Batches of the runs of sorted rows. The last run waits for more rows unless `last`; of a long one all whole blocks go at once."""
    import numpy as np

    key = rows[0]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[start[1:], len(key)]
    short = []
    for a, b in zip(start.tolist(), ends.tolist(), strict=True):
        goes_on = state["head"] is not None and a == 0 and state["head"][0, 0] == key[0]
        if not goes_on and a == 0:
            state["head"], state["at"] = None, 0
        final = b < len(key) or last
        if not goes_on and b - a <= BLOCK:
            if final:
                short.append((a, b))
                continue
            break
        if not goes_on:
            state["head"], state["at"] = rows[:, a : a + BLOCK], 0
        cut = b if final else a + (b - a) // BLOCK * BLOCK
        yield from long_run(rows[:, a:cut], state["head"], state["at"])
        state["at"] += cut - a
        if final:
            state["head"], state["at"] = None, 0
            continue
        a = cut
        break
    else:
        a = len(key)
    state["rest"] = rows[:, a:]
    if short:
        at = np.concatenate([np.arange(x, y) for x, y in short])
        yield told(rows[:, at])


def _open(members: DataFrame) -> DataFrame:
    """Members without groups that are seen whole and have one root; groups lie together in the tables, but a cut one is kept as it is."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                key, size, root = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "size", "root"))
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                length = np.diff(np.r_[start, len(key)])
                done = (length == size[start]) & (np.maximum.reduceat(root, start) == np.minimum.reduceat(root, start))
                batch = batch.filter(pa.array(~np.repeat(done, length)))
            yield batch

    return members.mapInArrow(run, members.schema)


def _near(members: DataFrame, radius: int, most: int | None) -> DataFrame:
    """Pairs (a, b) of texts of a group and different roots whose fingerprints are near; of each text the first `most` of a block.

    members: rows (key, p, q, half, k, n, fp, root, place); blocks p and q of a group meet, and one block meets itself.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import simhash

        def pairs(rows):
            key, p, q, half, k, n, fp, root, place = rows
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            runs = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(key)]))
            several = (np.maximum.reduceat(root, start) != np.minimum.reduceat(root, start))[runs]
            p, q, half, k, n, fp, root, place, runs = (x[several] for x in (p, q, half, k, n, fp, root, place, runs))
            i, j = simhash.shifted_links(fp.view(np.uint64), runs, radius)
            fits = (root[i] != root[j]) & ((p[i] == q[i]) | (half[i] != half[j])) & _fits(n, place, i, j)
            i, j = i[fits], j[fits]
            if most is not None and len(i):
                order = np.lexsort((i, j))
                i, j = i[order], j[order]
                first = np.r_[0, np.flatnonzero(j[1:] != j[:-1]) + 1]
                nth = np.arange(len(j)) - np.repeat(first, np.diff(np.r_[first, len(j)]))
                i, j = i[nth < most], j[nth < most]
            a, b = np.minimum(k[i], k[j]), np.maximum(k[i], k[j])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size >= simhash.LANES:  # the last run, of two blocks at most, may go on in the next batch
                rows = np.concatenate(held, axis=1)
                same = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1]) & (rows[2] == rows[2, -1])
                cut = int(np.argmax(same))
                if cut:
                    yield pairs(rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if held:
            yield pairs(np.concatenate(held, axis=1))

    ordered = members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "half", "k")
    return ordered.select("key", "p", "q", "half", "k", "n", "fp", "root", "place").mapInArrow(run, "a long, b long").distinct()


def _blocks(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each meeting of a text's block: with itself and with each other block of its key."""
    met = members.join(F.broadcast(blocks), "key", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))))
    return met.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("half"), "k", "n", "fp", "root", "place")


def near_copies(docs: DataFrame, text_column: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Rows (node, root) for each text that has near copies: its key (`key_of`), and the smallest key of those it hangs together with."""
    import numpy as np

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    copies = docs.select(key_of(F.col(text_column)).alias("k"), text.alias("text"))
    n = docs.count()
    rate = max(1, n // min(max(n // RATE, SAMPLE[0]), SAMPLE[1]))
    seen = _keys(copies.filter(F.pmod("k", F.lit(rate)) == 0).distinct(), shingle).groupBy("key").count().filter(F.col("count") >= OFTEN)
    last = np.array([r.key for r in seen.orderBy(F.desc("count"), "key").limit(FREQUENT).select("key").collect()], np.int64)
    with Scratch(docs.sparkSession) as scratch:
        members = scratch.keep(_groups(_keys(copies.distinct(), shingle, np.sort(last)), radius))
        ids = scratch.keep(members.select("k").distinct())
        hint = F.broadcast if ids.count() <= BROADCAST_TEXTS else lambda x: x
        sets = scratch.keep(_sets(copies.join(hint(ids), "k"), shingle))
        top = members.filter("block > 0").groupBy("key").agg(F.max("block").alias("top"))
        long_keys = top.count()
        linked = tried = part = None
        for most in ROUNDS:
            if part is None:
                pairs = members.filter("first is not null").select(F.least("k", "first").alias("a"), F.greatest("k", "first").alias("b")).distinct()
            else:
                near = F.broadcast if part.count() <= BROADCAST_TEXTS else lambda x: x
                own = _open(members.join(near(part.withColumnRenamed("node", "k")), "k", "left").select("key", "k", "n", "fp", "block", "size", F.coalesce("root", "k").alias("root"), "place"))
                pairs = _near(_blocks(own, top) if long_keys else own.select("key", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("half"), "k", "n", "fp", "root", "place"), radius, most).join(tried, ["a", "b"], "left_anti")
            pairs = scratch.keep(pairs)
            if pairs.isEmpty() and part is not None:
                break
            tried = pairs if tried is None else tried.union(pairs)
            few = F.broadcast if pairs.count() <= BROADCAST_TEXTS else lambda x: x
            # only the sets of paired texts are dealt out
            own = {c: sets.join(few(pairs.select(F.col(c).alias("k")).distinct()), "k", "left_semi").select(F.col("k").alias(c), F.col("s").alias(f"set_{c}")).dropDuplicates([c]) for c in "ab"}
            told = pairs.join(own["b"], "b").join(own["a"], "a")
            good = told.filter(F.size(F.array_intersect("set_a", "set_b")) * 9 >= (F.size("set_a") + F.size("set_b")) * 4).select("a", "b")
            good = scratch.keep(good)
            if good.isEmpty() and part is not None:
                continue
            linked = good if linked is None else linked.union(good)
            part = components(linked)
        return part
