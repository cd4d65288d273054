"""Language-model scoring by the subword lattice.

An existing vocabulary's pieces, with its scores, weight all segmentations of a
text: a log-space forward recursion sums them, which gives the marginal
probability of the text under a unigram model of pieces and an end. As pieces do
not cross word starts, a text's probability is the product of its words'
and the end's. Piece probabilities start from the vocabulary's scores and are
re-estimated from the training words by expectation-maximisation over the same
lattice, with the scores as a prior. Characters that no piece holds are spelt by byte pieces.

With `whole`, a training word is one arc over itself as well: its count less a discount, of all training
tokens. What the discounts free (by absolute discounting, D = n1 / (n1 + 2 n2) for n1 words that occur once and n2 that
occur twice) is the weight of the segmentations into pieces, so no probability counts twice; unknown words have those alone.
Pieces then are re-estimated from distinct words.

Word counts come from all training documents. Scores return to documents by
blocks: documents are dealt to blocks of about BLOCK bytes, each block asks for
its distinct words once, and gets their counts and probabilities. No table of words
is broadcast or collected.

Defined cases: a null text is empty: one token, the end; without training
documents counts are 0; ids may be null (then a document trains) or repeat; extra columns are ignored.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, table

VOCABULARY = os.environ.get("PERFLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
BLOCK = 16 << 20
#: Rounds of re-estimation, and the prior's weight in pieces for each piece of the vocabulary.
ROUNDS, PRIOR = 3, 0.5
#: Words up to this length are scored together; entries of a task's dictionary of words before it is let go.
TOGETHER, HELD = 48, 500_000
START = "▁"
BASE = 0x9E3779B97F4A7C15


def vocabulary(path: str = VOCABULARY):
    """Pieces (strings; one-byte pieces as bytes) and their log-probabilities by the vocabulary's scores.

    Scores of a unigram vocabulary are log-probabilities. A merge vocabulary has
    minus the rank as score; by Zipf's law the rank's probability is in proportion to 1 / (rank + 10).
    """
    import numpy as np
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            pieces.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or START in piece[1:]:
            continue
        else:
            pieces.append(piece)
        scores.append(model.get_score(i))
    scores = np.array(scores)
    if np.all(scores == np.round(scores)):
        order = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
        scores = -np.log(order + 10.0)
    return pieces, scores - np.log(np.exp(scores).sum())


class Lattice:
    """Pieces by hash, and their log-probabilities."""

    def __init__(self, pieces, logp):
        import numpy as np

        self.logp = np.asarray(logp, float)
        self.byte = np.full(256, -1)
        self.longest = max((len(p) for p in pieces if isinstance(p, str)), default=1)
        self.ids = {p: i for i, p in enumerate(pieces) if isinstance(p, str)}
        for i, p in enumerate(pieces):
            if isinstance(p, bytes):
                self.byte[p[0]] = i
        keys = np.fromiter((self.hash(p) for p in self.ids), np.uint64, len(self.ids))
        values = np.fromiter(self.ids.values(), np.int64, len(self.ids))
        self.bits = 18
        self.keys, self.values = np.zeros((1 << self.bits) + 64, np.uint64), np.full((1 << self.bits) + 64, -1, np.int32)
        self.depth = 0
        for k, v in zip(keys, values, strict=True):
            at = int((int(k) * BASE & (1 << 64) - 1) >> (64 - self.bits))
            d = 0
            while self.values[at + d] >= 0:
                d += 1
            self.keys[at + d], self.values[at + d], self.depth = k, v, max(self.depth, d + 1)

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * BASE + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, hashes):
        """Ids of pieces by hash, -1 for none: one look for most, further ones only where a slot is taken by another hash."""
        import numpy as np

        flat = hashes.ravel()
        at = ((flat * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(flat.shape, -1, np.int32)
        open_ = np.flatnonzero(self.values[at] >= 0)
        slot, wanted = at[open_], flat[open_]
        while len(open_):
            equal = self.keys[slot] == wanted
            out[open_[equal]] = self.values[slot[equal]]
            slot = slot + 1
            more = ~equal & (self.values[slot] >= 0)
            open_, slot, wanted = open_[more], slot[more], wanted[more]
        return out.reshape(hashes.shape)

    def spelling(self, char: str):
        """Ids of the byte pieces of a character."""
        return [int(self.byte[b]) for b in char.encode("utf-8", "surrogatepass")]

    def arcs(self, chars, logp=None):
        """For each length, ids of the pieces from each start (-1: none), and log-probabilities; chars: code points (words, n)."""
        import numpy as np

        n, logp = chars.shape[1], self.logp if logp is None else logp
        none = logp.dtype.type(-np.inf)
        h, ids, logs = np.zeros(chars.shape, np.uint64), [], []
        for k in range(1, min(n, self.longest) + 1):
            h = h[:, : n - k + 1] * np.uint64(BASE) + chars[:, k - 1 :] + np.uint64(1)
            found = self.find(h)
            log = np.where(found >= 0, logp[found], none)
            if k == 1:
                unknown = found < 0
                if unknown.any():
                    spelt = {c: sum(self.logp[i] if i >= 0 else -40.0 for i in self.spelling(chr(c))) for c in np.unique(chars[unknown]).tolist()}
                    log[unknown] = [spelt[c] for c in chars[unknown].tolist()]
            ids.append(found)
            logs.append(log)
        return ids, logs

    @staticmethod
    def sum_logs(terms):
        import numpy as np

        if len(terms) == 1:
            return terms[0]
        t = np.stack(terms)
        top = t.max(axis=0)
        safe = np.where(np.isfinite(top), top, t.dtype.type(0))
        t -= safe
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(t, out=t).sum(axis=0))

    def forward(self, logs, n: int):
        import numpy as np

        alpha = [np.zeros(len(logs[0]), logs[0].dtype)]
        for j in range(1, n + 1):
            alpha.append(self.sum_logs([alpha[j - k] + logs[k - 1][:, j - k] for k in range(1, min(j, len(logs)) + 1)]))
        return alpha

    def groups(self, words: list[str]):
        """(indices, code points) of words of equal length, each with its start mark; long ones alone."""
        import numpy as np

        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            step = max(1, 4096 * 8 // n)
            for i in range(0, len(at), step):
                own = at[i : i + step]
                text = "".join(START + words[k] for k in own.tolist()).encode("utf-32-le", "surrogatepass")
                yield own, np.frombuffer(text, np.uint32).reshape(len(own), n).astype(np.uint64)

    def score(self, words: list[str]):
        """Natural log of the marginal probability of each word."""
        import numpy as np

        out = np.zeros(len(words))
        for own, chars in self.groups(words):
            out[own] = self.forward(self.arcs(chars)[1], chars.shape[1])[-1]
        return out

    def expect(self, words: list[str], weight):
        """Expected counts of the pieces over words that occur `weight` times; single precision serves, as these are counts to learn from."""
        import numpy as np

        out, light = np.zeros(len(self.logp)), self.logp.astype(np.float32)
        for own, chars in self.groups(words):
            n = chars.shape[1]
            ids, logs = self.arcs(chars, light)
            alpha = self.forward(logs, n)
            beta: list = [None] * (n + 1)
            beta[n] = np.zeros(len(own), np.float32)
            for i in range(n - 1, -1, -1):
                beta[i] = self.sum_logs([logs[k - 1][:, i] + beta[i + k] for k in range(1, min(n - i, len(logs)) + 1)])
            times, at, terms = weight[own], [], []

            def posterior(k, i, rows):
                return np.exp(alpha[i][rows] + logs[k - 1][rows, i] + beta[i + k][rows] - alpha[n][rows]) * times[rows]

            # most arcs are no pieces: only those that are get a term, and all terms of a group are added at once
            for k in range(1, len(logs) + 1):
                for i in range(n - k + 1):
                    found = ids[k - 1][:, i]
                    known = np.flatnonzero(found >= 0)
                    if len(known):
                        at.append(found[known])
                        terms.append(posterior(k, i, known))
                    if k == 1 and len(known) < len(found):
                        spelt = np.flatnonzero(found < 0)
                        for c, w in zip(chars[spelt, i].tolist(), posterior(k, i, spelt).tolist(), strict=True):
                            for b in self.spelling(chr(c)):
                                out[b] += w * (b >= 0)
            if at:
                out += np.bincount(np.concatenate(at), np.concatenate(terms), len(out))
        return out


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n): how often training documents have each word of any document.

    The empty word stands for the end, and a null word for the bytes of all texts.
    """

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        train, other, size, ends = Counter(), set(), 0, 0

        def rows():
            pairs = [*train.items(), *((w, 0) for w in other if w not in train)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text, out in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                t = text.as_py() or b""
                size += len(t)
                own = t.lower().split()
                if out:
                    other.update(own)
                else:
                    train.update(own)
                    ends += 1
                if len(train) + len(other) > HELD:
                    yield rows()
                    train, other = Counter(), set()
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.array([b"", None], pa.binary()), pa.array([ends, size], pa.int64())], names=["word", "n"])

    return docs.select("text", "held_out").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS, prior: float = PRIOR):
    """Pieces and log-probabilities, and that of the end, re-estimated from counts of words."""
    import numpy as np

    pieces, start = vocabulary(path)
    logp, ends = start, counts.filter("word = X''").agg(F.sum("n")).first()[0] or 0
    sc = counts.sparkSession.sparkContext
    used = counts.filter("word is not null and word <> X'' and n > 0")
    for _ in range(rounds):
        sent = sc.broadcast((pieces, logp))

        def run(batches, sent=sent):
            import pyarrow as pa

            from . import lattice

            own = lattice.Lattice(*sent.value)
            total = np.zeros(len(own.logp))
            for batch in batches:
                words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
                total += own.expect(words, batch.column(1).to_numpy().astype(float))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "e"])

        # as many rows as pieces at most
        found = used.mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum(F.col("e").cast("decimal(38,6)")).cast("double").alias("e")).toArrow()
        expected = prior * len(pieces) * np.exp(start)
        np.add.at(expected, found.column("piece").to_numpy(), found.column("e").to_numpy())
        logp = np.log(expected) - np.log(expected.sum() + ends + 1)
    end = np.log(ends + 1) - np.log(expected.sum() + ends + 1) if rounds else 0.0
    return pieces, logp, float(end)


def with_whole(n, logp, total: int, distinct: int, discount: float):
    """Log-probabilities of words whose lattices also have an arc over the whole word, from their counts and those of their pieces alone."""
    import numpy as np

    if not total or not discount:
        return logp
    return np.logaddexp(np.log(np.maximum(n - discount, 1e-300) / total), logp + np.log(discount * distinct / total))


def score(docs: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS, block: int = BLOCK, whole: bool = False) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each document; whole: with arcs over whole training words."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    counts = settle(word_counts(base))
    facts = counts.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("n"), F.count(F.when(F.col("word").isNotNull() & (F.col("n") > 0), 1)).alias("v"), F.sum(F.when(F.col("word") == F.lit(b""), F.col("n"))).alias("ends"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("bytes"), *[F.count(F.when(F.col("word").isNotNull() & (F.col("n") == k), 1)).alias(f"n{k}") for k in (1, 2)]).first()
    total, distinct, ends = facts.n or 0, facts.v or 0, facts.ends or 0
    discount = (facts.n1 / (facts.n1 + 2 * facts.n2) if facts.n1 else 0.5) if whole else 0.0
    # arcs over whole words take known words: pieces are for words yet unseen, which distinct words tell more of than frequent ones
    pieces, logp, end = fit(counts.withColumn("n", F.when(F.length("word") > 0, F.least("n", F.lit(1))).otherwise(F.col("n"))) if whole else counts, path, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, logp))

    def weigh(batches):
        import pyarrow as pa

        from . import lattice

        own = lattice.Lattice(*sent.value)
        for batch in batches:
            logs = own.score([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs)], names=["word", "n", "logp"])

    weighed = counts.filter("word is not null and word <> X''").mapInArrow(weigh, "word binary, n long, logp double")
    n_blocks = max(1, -(-(facts.bytes or 0) // block))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))

    def asked(group):
        import pyarrow as pa

        found = set()
        for text in group.column("text").cast(pa.binary()):
            found.update((text.as_py() or b"").lower().split())
        return pa.table({"block": pa.array([group.column("block")[0].as_py()] * len(found), pa.int32()), "word": pa.array(list(found), pa.binary())})

    wanted = dealt.groupBy("block").applyInArrow(asked, "block int, word binary").join(weighed, "word")

    def told(group, given):
        import math

        import numpy as np
        import pyarrow as pa

        from . import lattice

        place = {w: i for i, w in enumerate(given.column("word").to_pylist())}
        n = np.append(given.column("n").to_numpy(), ends)
        logs = lattice.with_whole(n, np.append(given.column("logp").to_numpy(), end), total, distinct, discount) / math.log(10)
        norm = math.log10(total + distinct + 1)
        base_logs = np.log10(n + 1.0) - norm
        rows = []
        for text in group.column("text").cast(pa.binary()):
            own = [place[w] for w in (text.as_py() or b"").lower().split()]
            own.append(len(place))
            at = np.array(own, np.int64)
            rows.append((len(own), int((n[at] > 0).sum()), float(base_logs[at].sum()), float(logs[at].sum())))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        size = group.num_rows
        return pa.table({"doc_id": group.column("doc_id"), "held_out": group.column("held_out"), "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()), "train_tokens": pa.array([total] * size, pa.int64()), "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64())})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(told, schema)


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), whole=True)
