"""Vector code compression: product codes with an exact partial-distance search.

Vectors become integers, floor(256 x), and are cut into equal consecutive parts. Each position has a codebook of
entries; a code is the entry nearest to each part. The search takes the dimensions of a part in
descending variance of the codebook, adds up squared differences for all rows and entries still
alive, and drops a pair once its sum strictly exceeds the row's best complete distance; after each dimension the
entry that leads a row is completed, which tightens that bound. Dropped pairs can't win and ties
are never dropped, so the result is that of the full search.

Training: in each round tasks assign their rows and add up components and counts by entry; the arrays of the tasks are
summed, and the new codebooks (positions x entries x components, whatever the number of rows) are all that reaches the driver.

Defined cases: vectors that are null or hold a null or non-finite component go. Integers are held within 2^26, where sums of squares stay exact.
A vector shorter than the longest, or whose length the number of parts doesn't divide, counts as if zeros followed.
Equal ids are ordered by their vectors, null ids come last; of fewer vectors than entries codebooks are smaller;
an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import match_counted, settle, sum_arrays, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26
#: Rows whose distances are held at once.
BLOCK = 2048


def nearest(x, book):
    """For rows x and entries of a codebook (both int64): the index of the nearest entry, ties to the lower, and its squared distance."""
    import numpy as np

    n, k = len(x), len(book)
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable") if x.shape[1] else []
    if not len(order):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)

    def complete(rows, entries):
        return ((x[rows] - book[entries]) ** 2).sum(axis=1)

    all_rows = np.arange(n)
    first = (x[:, order[0], None] - book[None, :, order[0]]) ** 2
    best = complete(all_rows, first.argmin(axis=1))
    rows, entries = np.nonzero(first <= best[:, None])
    sums = first[rows, entries]
    for d in order[1:]:
        sums = sums + (x[rows, d] - book[entries, d]) ** 2
        alive = sums <= best[rows]
        rows, entries, sums = rows[alive], entries[alive], sums[alive]
        # every row has its best entry left: the first of the lowest sums is completed
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        low = np.minimum.reduceat(sums, starts)
        leads = np.flatnonzero(sums == low[rows])
        leads = leads[np.flatnonzero(np.diff(rows[leads], prepend=-1))]
        best = np.minimum(best, complete(all_rows, entries[leads]))
        alive = sums <= best[rows]
        rows, entries, sums = rows[alive], entries[alive], sums[alive]
    # what is left has complete distances, each the best of its row; the first is the lowest entry
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return entries[starts], sums[starts]


def integers(column, width: int):
    """An (n, width) array of the integers of an Arrow list column without nulls, zeros where a vector ends early."""
    import numpy as np

    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, at] = np.clip(np.floor(SCALE * flat.astype(float)), -LIMIT, LIMIT).astype(np.int64)
    return out


def assigned(column, books):
    """Codes and squared distances, both (rows, parts)."""
    import numpy as np

    parts, _, step = books.shape
    x = integers(column, parts * step)
    codes, errors = np.zeros((2, len(x), parts), np.int64)
    for a in range(0, len(x), BLOCK):
        for p in range(parts):
            codes[a : a + BLOCK, p], errors[a : a + BLOCK, p] = nearest(x[a : a + BLOCK, p * step : (p + 1) * step], books[p])
    return x, codes, errors


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """Codebooks (parts, entries, components) over rows (vec_id, vector); None without rows."""
    import numpy as np
    import pyarrow as pa

    width = vectors.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return None
    step = max(1, -(-width // parts))
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column(0).combine_chunks()
    start = start.combine_chunks() if isinstance(start, pa.ChunkedArray) else start
    books = integers(start, parts * step).reshape(len(start), parts, step).transpose(1, 0, 2).copy()
    n = books.shape[1]
    for _ in range(rounds):

        def totals(batches, books=books):
            total = np.zeros((parts, n, step + 1), np.int64)
            for batch in batches:
                x, codes, _ = assigned(batch.column(0), books)
                for p in range(parts):
                    np.add.at(total[p, :, :step], codes[:, p], x[:, p * step : (p + 1) * step])
                    total[p, :, step] += np.bincount(codes[:, p], minlength=n)
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.int64()))], names=["total"])

        found = sum_arrays(vectors.select("vector").mapInArrow(totals, "total array<bigint>"), [], "total").toArrow()
        total = np.zeros(parts * n * (step + 1), np.int64)
        total[found["pos"].to_numpy()] = found["n"].to_numpy()
        total = total.reshape(parts, n, step + 1)
        used = total[:, :, step] > 0
        books[used] = np.floor_divide(total[used][:, :step], total[used][:, step:])
    return books


def encode(vectors: DataFrame, books) -> DataFrame:
    """Rows (vec_id, label, code, error) for rows (vec_id, label, vector)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            _, codes, errors = assigned(batch.column(2), books)
            names = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(errors.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, "vec_id long, label string, code string, error long")


def finite(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, label, vector) of the vectors of finite components; the label as text, marked, so that nulls are one of them."""
    vector = F.col("embedding").cast("array<double>")
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector")).filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(F.abs(x) <= F.lit(1.7976931348623157e308), F.lit(False))))


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256)."""
    from hashlib import sha256

    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    vectors = finite(embeddings)
    books = train(vectors, parts, entries, rounds)
    if books is None:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = settle(encode(vectors, books))
    totals = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    return match_counted(coded, totals, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_code_compression(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _assign(v: str, c: str) -> str:
    """The nearest entry of each part by a full search."""
    return f"""SELECT k, p, arg_min(j, e * 100 + j) AS j, min(e) AS e FROM (SELECT v.k, v.p, c.j, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS e FROM {v} v JOIN {c} c ON c.p = v.p) GROUP BY k, p"""


def _moved(a: str, c: str) -> str:
    """The codebook of the next round."""
    return f"""SELECT c.p, c.j, coalesce(m.x, c.x) AS x FROM {c} c LEFT JOIN (SELECT p, j, list(f ORDER BY i) AS x FROM (SELECT p, j, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS f FROM (SELECT v.p, a.j, unnest(range(1, len(v.x) + 1)) AS i, unnest(v.x) AS x FROM v JOIN {a} a ON a.k = v.k AND a.p = v.p) GROUP BY p, j, i) GROUP BY p, j) m ON m.p = c.p AND m.j = c.j"""


OP12_SQL = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT k, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM e, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, k - 1 AS j, x FROM v WHERE k <= 64),
a0 AS MATERIALIZED ({_assign("v", "c0")}), c1 AS MATERIALIZED ({_moved("a0", "c0")}),
a1 AS MATERIALIZED ({_assign("v", "c1")}), c2 AS MATERIALIZED ({_moved("a1", "c1")}),
a2 AS MATERIALIZED ({_assign("v", "c2")}),
r AS (SELECT k, string_agg(lower(printf('%02x', j)), '' ORDER BY p) AS code, sum(e)::BIGINT AS error FROM a2 GROUP BY k),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN r USING (k), h
"""
