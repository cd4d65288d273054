"""Secret scans by one combined automaton.

A rule is a head (what stands before a secret, or nothing), a class of characters that the secret consists of, and the
least number of them. All rules are compiled into one minimal deterministic automaton that
searches for any of them (`automaton.build`), and every byte is read by it once. The bytes of a batch are
cut, after bytes that lead every state to the start, into thousands of lanes that step together: a step is one
lookup in the transition array for all lanes. Between such bytes lie segments that no match leaves; a segment with an
accepting state is read again by the small automata of just the rules it names, which find their leftmost
longest matches one after the other, without overlaps. Matches whose secret is too short are dropped then, as what
they covered is used up.

Defined cases: a null text is empty and has no spans; offsets are of code points, ends exclusive; rows are judged one by one, so repeated rows and
ids are alike and null ids go along; a text without bytes that part segments is one lane; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automaton
from .common import table


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    value: str
    least: int
    fold: bool = False  # letters in either case


#: The kinds that are always sought.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 8, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
)
#: Published forms of further credentials.
RULES = (
    *BASE,
    Rule("code_host", "gh[opsru]_", "[A-Za-z0-9]", 36),
    Rule("chat", "xox[abeoprs]-", "[A-Za-z0-9-]", 20),
    Rule("payment", "[sr]k_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("cloud_key", "AIza", r"[A-Za-z0-9_-]", 35),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]", 16),
    Rule("bearer", r"bearer\x20+", r"[A-Za-z0-9._~+/=-]", 20, fold=True),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$*+%-]+", "@", 1),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY", "-", 5),
)
#: Lanes that step together, bytes a lane has at least, and bytes that are scanned at once.
LANES, LANE_BYTES, BLOCK_BYTES = 8192, 512, 1 << 25


@dataclass(frozen=True)
class Compiled:
    rules: tuple[Rule, ...]
    all: automaton.Automaton  # searches for every rule
    each: tuple[automaton.Automaton, ...]  # by rule: a match from its first byte
    heads: tuple[automaton.Automaton | None, ...]
    parts: object  # by byte: whether it leads every state to the start


@lru_cache
def compiled(rules: tuple[Rule, ...] = RULES) -> Compiled:
    import numpy as np

    value = [automaton.parse(r.value, r.fold) for r in rules]
    heads = [automaton.parse(r.head, r.fold) if r.head else None for r in rules]
    # a rule without a head is a run of one class: the least length can be part of the pattern
    trees = [("cat", [h, ("rep", v, 1, None)]) if h else ("rep", v, r.least, None) for r, h, v in zip(rules, heads, value, strict=True)]
    # where a match is, is one of the first character of its secret: the search need not follow the rest, which keeps it small
    search = automaton.build([("cat", [h, v]) if h else ("rep", v, r.least, r.least) for r, h, v in zip(rules, heads, value, strict=True)], search=True)
    by_state = search.move.reshape(-1, search.n_classes)
    parts = (by_state == search.start).all(axis=0)[search.of_byte]
    if not parts[10]:
        raise ValueError("no rule may go over the end of a line")
    return Compiled(rules, search, tuple(automaton.build([t]) for t in trees), tuple(h and automaton.build([h]) for h in heads), np.ascontiguousarray(parts))


def longest(a: automaton.Automaton, text: bytes, at: int, end: int) -> int:
    """The end of the longest match from `at`, or -1."""
    state, found, move, of_byte, n = a.start, -1, a.move, a.of_byte, a.n_classes
    for i in range(at, end):
        state = move[state * n + of_byte[text[i]]]
        if state == a.dead:
            break
        if state >= a.first_accept:
            found = i + 1
    return found


def matches(c: Compiled, rule: int, text: bytes, at: int, end: int):
    """The spans of one rule between two bytes: leftmost, longest, without overlaps, secrets long enough."""
    import numpy as np

    whole, head, least = c.each[rule], c.heads[rule], c.rules[rule].least
    first = whole.move[whole.start * whole.n_classes : (whole.start + 1) * whole.n_classes][whole.of_byte] != whole.dead
    starts = np.flatnonzero(first[np.frombuffer(text, np.uint8, end - at, at)]) + at
    i = 0
    while i < len(starts):
        b = int(starts[i])
        e = longest(whole, text, b, end)
        if e < 0:
            i += 1
            continue
        if not head or e - longest(head, text, b, e) >= least:
            yield b, e
        i = int(np.searchsorted(starts, e))


def scan(c: Compiled, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, end, rule) of its spans in bytes, in order."""
    import numpy as np

    a = c.all
    joined = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - [len(t) + 1 for t in texts]
    breaks = np.flatnonzero(c.parts[buffer])  # the last byte is one
    n_lanes = int(max(1, min(LANES, len(buffer) // LANE_BYTES)))
    cuts = np.unique(breaks[np.searchsorted(breaks, np.arange(1, n_lanes + 1) * len(buffer) // n_lanes - 1)] + 1)
    starts = np.concatenate([[0], cuts[:-1]])
    lengths = cuts - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lanes longer than the step
    codes = a.of_byte.astype(np.int32)[buffer]
    state = np.full(len(starts), a.start, np.int32)
    hits: list[tuple] = []
    for step, n in enumerate(active.tolist()):
        now = a.move[state[:n] * a.n_classes + codes[starts[:n] + step]]
        state[:n] = now
        if now.max() >= a.first_accept:
            lanes = np.flatnonzero(now >= a.first_accept)
            hits.append((starts[lanes] + step, now[lanes]))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not hits:
        return found
    segment = np.searchsorted(breaks, np.concatenate([h[0] for h in hits]))
    named = np.unique(np.column_stack([segment, np.concatenate([h[1] for h in hits])]), axis=0)
    rules_of: dict[int, int] = {}
    for s, q in named.tolist():
        rules_of[s] = rules_of.get(s, 0) | a.rules_at(q)
    for s, told in rules_of.items():
        at, end = (int(breaks[s - 1]) + 1 if s else 0), int(breaks[s])
        doc = int(np.searchsorted(ends, at, side="right"))
        for r in automaton.bits(told):
            found[doc] += [(b - int(begins[doc]), e - int(begins[doc]), r) for b, e in matches(c, r, joined, at, end)]
    return [sorted(spans, key=lambda x: (x[0], x[2])) for spans in found]


def in_characters(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of code points."""
    import numpy as np

    if text.isascii() or not spans:
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[b]), int(before[e]), r) for b, e, r in spans]


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc_id, found): the spans of each document as structs (kind, start, end), by start and the rules' order."""
    c = compiled(rules)

    def run(batches):
        import pyarrow as pa

        kinds = [r.kind for r in c.rules]
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            spans, a = [], 0
            while a < len(texts):
                b, held = a, 0
                while b < len(texts) and (b == a or held + len(texts[b]) <= BLOCK_BYTES):
                    held += len(texts[b])
                    b += 1
                spans += [in_characters(t, s) for t, s in zip(texts[a:b], scan(c, texts[a:b]), strict=True)]
                a = b
            found = pa.array([[{"kind": kinds[r], "start": s, "end": e} for s, e, r in x] for x in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "found"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:bigint,end:bigint>>")


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op13_secret_scans(spark, sf_dir: str) -> DataFrame:
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE]))

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(table(spark, sf_dir, "documents")).select("doc_id", *[of(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
