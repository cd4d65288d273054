"""SimHash near-duplicates, compared bit-sliced.

A fingerprint has 64 bits: each is 1 where over half of the XXH64 values of the
text's word shingles have it. Two fingerprints link at `radius` or fewer
differing bits. Equal fingerprints are one row before anything is compared.

Candidates: the 64 bits are cut into m blocks, and each choice of m - radius
blocks is a table, keyed by their bits; linked fingerprints agree in at least
one. m follows from the number of fingerprints by a cost estimate, so that
buckets stay small at any size. Rows of a bucket meet in a task, where bit
planes are stored vertically (64 fingerprints a word). Many distances at once
are counted by carry-save adders into bit-sliced counters, and words whose
64 lanes all exceed the radius are abandoned half way. A bucket yields no
pairs but a spanning star for each of its connected parts.

Defined cases: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; repeated rows are kept, and
each gets the component of its fingerprint; rows without an id get the
component of the others; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Runs of a bucket up to this length are compared by shifts, longer ones in blocks.
SHORT_RUN = 512
#: Queries that meet a long run's lanes at once, and fingerprints that meet at once by shifts.
QUERIES, LANES = 256, 1 << 17
#: Fingerprints of a bucket that one task compares; larger buckets are dealt out over tasks.
HOT = 1 << 16
#: Planes after which words are abandoned.
HALF = 24


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, A-Z lower-cased."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - shingle + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp), one for each document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def tables_for(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the tables for n fingerprints: the choice of blocks with the least estimated work."""

    def cost(m: int) -> float:
        t = math.comb(m, radius)
        return t * n * 3e-6 + t * n * (n / 2) / 2 ** (64 * (m - radius) / m) * 5e-9

    m = min(range(radius + 1, radius + 5), key=cost)
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def planes_of(prints):
    """Bit planes (64, words) of uint64 fingerprints; lane i is bit i % 64 of word i // 64."""
    import numpy as np

    padded = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def lanes_of(mask):
    """Indices of the set lanes of a vector of words."""
    import numpy as np

    at = np.flatnonzero(mask)
    bits = np.unpackbits(mask[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return at[row] * 64 + bit


class Counter:
    """Bit-sliced distances up to `radius`: counter planes by carry-save adders, and lanes that exceed it."""

    def __init__(self, like, radius: int):
        import numpy as np

        self.planes = [np.zeros_like(like) for _ in range(radius.bit_length())]
        self.over, self.radius = np.zeros_like(like), radius

    def add(self, x, weight: int = 0) -> None:
        for k in range(weight, len(self.planes)):
            self.planes[k], x = self.planes[k] ^ x, self.planes[k] & x
        self.over |= x

    def add3(self, a, b, c) -> None:
        """Three differences at once: a full adder gives a sum and a carry."""
        u = a ^ b
        self.add(u ^ c)
        self.add((a & b) | (u & c), 1)

    def within(self):
        """Lanes at `radius` or less."""
        import numpy as np

        greater, equal = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for k in reversed(range(len(self.planes))):
            if self.radius >> k & 1:
                equal = equal & self.planes[k]
            else:
                greater |= equal & self.planes[k]
                equal = equal & ~self.planes[k]
        return ~(self.over | greater)

    def keep(self, at) -> None:
        self.planes, self.over = [p[at] for p in self.planes], self.over[at]


def count_planes(counter: Counter, difference, first: int, last: int) -> None:
    k = first
    while k + 3 <= last:
        counter.add3(difference(k), difference(k + 1), difference(k + 2))
        k += 3
    for j in range(k, last):
        counter.add(difference(j))


def shifted_links(prints, runs, radius: int):
    """Pairs (i, j) of linked rows of equal run; runs are short and adjacent."""
    import numpy as np

    left, right = [], []
    index = np.arange(len(prints))
    length = np.bincount(runs)[runs] if len(runs) else runs
    d = 1
    while True:
        alive = length > d
        if not alive.all():
            prints, runs, index, length = prints[alive], runs[alive], index[alive], length[alive]
        if len(prints) <= d:
            break
        if d == 1 or not alive.all():
            planes = np.concatenate([planes_of(prints), np.zeros((64, 1), np.uint64)], axis=1)
            width = planes.shape[1] - 1
        same = np.zeros(width * 64, bool)
        same[: len(runs) - d] = runs[:-d] == runs[d:]
        valid = np.packbits(same, bitorder="little").view(np.uint64)
        word, bit = d >> 6, np.uint64(d & 63)

        def shifted(k, at=None):
            own = planes[k]
            if at is None:
                low = own[word:width]
                high = own[word + 1 : width + 1]
                base = own[: width - word]
            else:
                low, high, base = own[at + word], own[at + word + 1], own[at]
            moved = low if bit == 0 else (low >> bit) | (high << (np.uint64(64) - bit))
            return base ^ moved

        reach = width - word
        counter = Counter(np.zeros(reach, np.uint64), radius)
        count_planes(counter, shifted, 0, HALF)
        at = np.flatnonzero(counter.within() & valid[:reach])  # other words are abandoned
        if len(at):
            counter.keep(at)
            count_planes(counter, lambda k: shifted(k, at), HALF, 64)
            hit = np.zeros(width, np.uint64)
            hit[at] = counter.within() & valid[at]
            i = lanes_of(hit)
            left.append(index[i])
            right.append(index[i + d])
        d += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def find_root(parent, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def star_labels(n: int, left, right):
    """The smallest index of the connected part of each of n rows."""
    parent = list(range(n))
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find_root(parent, a), find_root(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find_root(parent, i) for i in range(n)]


def block_labels(prints, radius: int):
    """Labels of the connected parts of a long run.

    Some rows meet all lanes first. If most lanes then hang together, only the
    rows outside of that part are still to meet all lanes: links inside it change nothing.
    """
    import numpy as np

    n = len(prints)
    labels, planes = np.arange(n), planes_of(prints)
    full = ~np.uint64(0)

    def meet(rows) -> None:
        for start in range(0, len(rows), QUERIES):
            own = rows[start : start + QUERIES]
            sets = [np.where((prints[own] >> np.uint64(k)) & np.uint64(1), full, np.uint64(0))[:, None] for k in range(64)]
            counter = Counter(np.zeros((len(own), planes.shape[1]), np.uint64), radius)
            count_planes(counter, lambda k, s=sets: planes[k][None, :] ^ s[k], 0, HALF)
            row, word = np.nonzero(counter.within())  # other words are abandoned
            counter.keep((row, word))
            count_planes(counter, lambda k, s=sets, r=row, w=word: planes[k][w] ^ s[k][r, 0], HALF, 64)
            hits = counter.within()
            for r in np.unique(row):
                mine = row == r
                lanes = np.zeros(planes.shape[1], np.uint64)
                lanes[word[mine]] = hits[mine]
                found = lanes_of(lanes)
                found = found[found < n]
                old = np.unique(labels[found])
                if len(old) > 1:
                    labels[np.isin(labels, old)] = old[0]

    rng, left = np.random.default_rng(n), np.arange(n)
    met = np.zeros(n, bool)
    for _ in range(8):
        tried = rng.choice(left, min(64, len(left)), replace=False)
        meet(tried)
        met[tried] = True
        value, size = np.unique(labels, return_counts=True)
        if size.max() * 2 < n:
            break
        left = np.flatnonzero((labels != value[size.argmax()]) & ~met)
        if not len(left):
            return labels
    meet(np.flatnonzero(~met) if size.max() * 2 < n else left)
    return labels


def bucket_stars(keys, prints, ids, radius: int):
    """Star links (a, b) of ids for rows sorted by key."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, len(keys)])
    runs = np.repeat(np.arange(len(starts)), lengths)
    out_a, out_b = [], []

    def emit(labels, own) -> None:
        labels = np.asarray(labels)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        out_a.append(own[labels[moved]])
        out_b.append(own[moved])

    fits = ((lengths > 1) & (lengths <= SHORT_RUN))[runs] if len(runs) else np.zeros(0, bool)
    short = np.flatnonzero(fits)
    for at in range(0, len(short), LANES):
        # a run that a cut would part goes whole with the first part
        part = short[at : at + LANES]
        if at:
            part = part[runs[part] != runs[short[at - 1]]]
        if at + LANES < len(short):
            rest = short[at + LANES : at + LANES + SHORT_RUN]
            part = np.r_[part, rest[runs[rest] == runs[short[at + LANES - 1]]]]
        if len(part):
            own = np.unique(runs[part], return_inverse=True)[1]
            emit(star_labels(len(part), *shifted_links(prints[part], own, radius)), ids[part])
    for k in np.flatnonzero(lengths > SHORT_RUN):
        span = slice(starts[k], starts[k] + lengths[k])
        emit(block_labels(prints[span], radius), ids[span])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _split(keyed: DataFrame, hot: int) -> DataFrame:
    """Rows (key, fp, rep) in which a bucket of over `hot` rows is dealt into blocks that meet pair by pair, each pair under a key of its own."""
    large = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
    if large.isEmpty():
        return keyed
    # at most rows / hot buckets
    told = keyed.join(F.broadcast(large), "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") * 2 / hot), F.lit(1)).cast("int"))
    told = told.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return told.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(pair).alias("key"), "fp", "rep")


def link_stars(prints: DataFrame, masks: list[int], radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) of ids among distinct fingerprints (fp, rep): enough to connect what links."""
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    tables = F.array(*[F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(x).cast("long")).alias("k")) for i, x in enumerate(signed)])
    keyed = prints.select("fp", "rep", F.explode(tables).alias("b")).select(F.xxhash64("b.t", "b.k").alias("key"), "fp", "rep")
    keyed = _split(keyed, hot)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list = []

        def stars(rows):
            a, b = bucket_stars(rows[0], rows[1].view(np.uint64), rows[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += batch.num_rows
            if size >= LANES:  # the last key may go on in the next batch
                rows = np.concatenate(held, axis=1)
                last = int(np.searchsorted(rows[0], rows[0, -1]))
                held, size = [rows[:, last:]], 0 if last else size
                if last:
                    yield stars(rows[:, :last])
                    size = rows.shape[1] - last
        if held:
            yield stars(np.concatenate(held, axis=1))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fingerprint as 16 hex digits, component_id), one for each document."""
    own = settle(fingerprints(docs, id_column, text_column, shingle))
    distinct = settle(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    reps = distinct.filter("rep is not null")
    found = components(link_stars(reps, tables_for(max(1, reps.count()), radius), radius))
    placed = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return own.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row, all columns as they are, of each group of texts that hang together by near copies (`similar`): that of the smallest id, null ids last."""
    from . import similar
    from .common import packed, row_hashes

    part = settle(similar.near_copies(docs, text_column))
    hint = F.broadcast if part.count() <= similar.BROADCAST_TEXTS else lambda x: x
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(packed(docs).alias("row"), F.col(id_column).alias("id"), similar.key_of(F.col(text_column)).alias("node"), F.hash(F.lit(7), text).alias("more"), *[h.alias(f"h{k}") for k, h in enumerate(row_hashes(docs))])
    # texts that stand alone are told apart by 96 bits
    found = rows.join(hint(part), "node", "left").withColumns({"group": F.coalesce("root", "node"), "more": F.when(F.col("root").isNull(), F.col("more"))})
    order = F.struct(F.col("id").isNull(), "id", "h0", "h1")
    return found.groupBy("group", "more").agg(F.min_by("row", order).alias("row")).select("row.*")
