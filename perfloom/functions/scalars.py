"""Scalar functions as column expressions: names, paths, texts, numbers, bands. No function here reads more than its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of frame names by category, in order of priority.
FRAME_CATEGORIES = (
    ("database", ("psycopg", "sqlalchemy", "pymongo", "redis", "asyncpg", "mysql", "sqlite", "execute_query", "select * from", "jdbc", "hibernate")),
    ("network", ("aiohttp", "httpx", "requests.api", "urllib", "socket.recv", "socket.send", "tcp_", "okhttp", "reqwest")),
    ("lock", ("lock", "mutex", "rwlock", "synchron", "semaphore", "condvar")),
    ("gc", ("gc.", "garbage", "mark_sweep", "g1_", "young_gen", "old_gen")),
    ("serde", ("json", "serde", "pickle", "msgpack", "protobuf", "marshal")),
    ("filesystem", ("read", "write", "fsync", "open(", "fs::", "fileio")),
    ("cpu", ("loop", "compute", "encode", "decode", "hash", "regex")),
)
#: Path parts of frames that are not the user's code.
RUNTIME_PATHS = ("<frozen ", "<built-in")
STRICT_PATHS = ("/lib/python3.", "/site-packages/")
#: Names that are too general to compare, and prefixes that rule a name out.
GENERIC_NAMES = ("__init__", "main", "run", "build", "new", "default", "init", "setup", "teardown", "execute", "handle", "process")
SKIPPED_PREFIXES = ("_", "test_", "should_", "it_", "describe_")
#: Languages by extension, with their kind.
LANGUAGES = (
    ("Python", "programming", "py pyi pyw"), ("Java", "programming", "java"), ("TypeScript", "programming", "ts tsx mts cts"), ("JavaScript", "programming", "js jsx mjs cjs"),
    ("Rust", "programming", "rs"), ("Go", "programming", "go"), ("Scala", "programming", "scala sc"), ("Kotlin", "programming", "kt kts"),
    ("Ruby", "programming", "rb"), ("PHP", "programming", "php"), ("C", "programming", "c h"), ("C++", "programming", "cpp cc cxx hpp hh hxx"), ("C#", "programming", "cs"),
    ("Swift", "programming", "swift"), ("Shell", "programming", "sh bash zsh fish"), ("PowerShell", "programming", "ps1"), ("Lua", "programming", "lua"), ("Perl", "programming", "pl pm"),
    ("R", "programming", "r"), ("Dart", "programming", "dart"), ("Elixir", "programming", "ex exs"), ("Erlang", "programming", "erl"), ("Haskell", "programming", "hs"),
    ("Clojure", "programming", "clj cljs cljc"), ("OCaml", "programming", "ml mli"), ("F#", "programming", "fs fsx fsi"), ("Groovy", "programming", "groovy gvy"),
    ("Vue", "programming", "vue"), ("Svelte", "programming", "svelte"), ("HTML", "markup", "html htm"), ("CSS", "markup", "css scss sass less"), ("TeX", "markup", "tex"),
    ("Markdown", "prose", "md markdown"), ("reStructuredText", "prose", "rst"), ("JSON", "data", "json"), ("YAML", "data", "yaml yml"), ("TOML", "data", "toml"), ("XML", "data", "xml"),
    ("CSV", "data", "csv"), ("SQL", "data", "sql"), ("GraphQL", "data", "graphql gql"), ("Protocol Buffer", "data", "proto"),
)
#: Languages by whole file name, all of them programming.
FILE_LANGUAGES = {"dockerfile": "Dockerfile", "makefile": "Makefile", "gnumakefile": "Makefile", "cmakelists.txt": "CMake", "rakefile": "Ruby", "gemfile": "Ruby", "build.gradle": "Gradle", "settings.gradle": "Gradle"}
#: Languages that symbols are extracted from.
SUPPORTED = ("Python", "Java", "TypeScript", "JavaScript", "Rust", "Go", "Scala", "Kotlin")


def any_part(text: Column, parts) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))


def frame_category(frame: Column) -> Column:
    """The first category, by priority, of which the frame's lower-cased name holds a part; else unknown."""
    low, out = F.lower(frame), F.lit("unknown")
    for name, parts in reversed(FRAME_CATEGORIES):
        out = F.when(any_part(low, parts), name).otherwise(out)
    return out


def hotspot_severity(self_percent: Column, total_percent: Column) -> Column:
    return F.when((self_percent >= 20) | (total_percent >= 60), "critical").when((self_percent >= 10) | (total_percent >= 35), "high").when((self_percent >= 3) | (total_percent >= 15), "medium").otherwise("low")


def is_system_frame(file: Column, more=()) -> Column:
    """Whether a frame's file is of the runtime, of installed packages, or of the paths given; a null file is not."""
    return F.coalesce(any_part(file, (*RUNTIME_PATHS, *STRICT_PATHS, *more)), F.lit(False))


def label_frames(frames: Column, more=()) -> Column:
    """An array of frames with `is_system` set from each frame's file."""
    return F.transform(frames, lambda f: f.withField("is_system", is_system_frame(f["file"], more)))


def is_internal_thread(name: Column, prefix: str) -> Column:
    return F.coalesce((F.length(name) > 0) & F.startswith(name, F.lit(prefix)), F.lit(False))


def is_synthetic(name: Column) -> Column:
    return F.startswith(name, F.lit("<"))


def is_method_call(name: Column) -> Column:
    """Whether a callee's name does not begin with an ASCII capital, as constructors do."""
    return ~name.rlike("^[A-Z]")


def is_private(name: Column) -> Column:
    return F.startswith(name, F.lit("_"))


def is_test_token(name: Column) -> Column:
    return name.rlike(r"^[Tt]est[A-Z]") | name.rlike(r"(?:^|[a-z0-9])(?:Tests?|Specs?|Mocks?)$") | name.rlike(r"(?i)(?:^|[^a-z0-9])(?:tests?|specs?|mocks?|testdata)(?:[^a-z0-9]|$)")


def is_test_filename(name: Column) -> Column:
    return is_test_token(F.regexp_replace(name, r"(?s)\.[^.]*$", ""))


def is_test_path(path: Column) -> Column:
    """Whether a directory of a root-relative path, or its file name without the last ending, is a test's."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), is_test_token) | is_test_filename(F.element_at(parts, -1))


def is_comparable_name(name: Column) -> Column:
    """Whether a symbol's name says enough to look for near duplicates: four bytes or more, neither general, private, a test's nor synthetic."""
    skipped = F.exists(F.array(*[F.lit(p) for p in SKIPPED_PREFIXES]), lambda p: F.startswith(name, p))
    return (F.octet_length(name) >= 4) & ~name.isin(*GENERIC_NAMES) & ~skipped & ~is_synthetic(name)


def is_scan_id(text: Column) -> Column:
    """Whether a text may name a stored scan: not empty, no separators, no parent steps, not hidden."""
    return F.coalesce((F.length(text) > 0) & ~text.rlike(r"[/\\\x00]") & ~F.contains(text, F.lit("..")) & ~F.startswith(text, F.lit(".")), F.lit(False))


def language(path: Column) -> Column:
    """The language of a file by its name, else by its extension, case ignored; null if unknown."""
    name = F.lower(F.substring_index(path, "/", -1))
    ext = F.when(name.rlike(r"[^/]\.[^./]+$"), F.substring_index(name, ".", -1))
    names = F.create_map(*[F.lit(x) for pair in FILE_LANGUAGES.items() for x in pair])
    exts = F.create_map(*[F.lit(x) for n, _, es in LANGUAGES for e in es.split() for x in (e, n)])
    return F.coalesce(F.try_element_at(names, name), F.try_element_at(exts, ext))


def language_kind(lang: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for n, k, _ in LANGUAGES for x in (n, k)])
    return F.when(lang.isNotNull(), F.coalesce(F.try_element_at(kinds, lang), F.lit("programming")))


def symbol_label(name: Column, parent: Column, file: Column, line: Column) -> Column:
    """A readable label: a module is its file, an anonymous symbol its place, others `parent.name` where the parent is named."""
    base, anonymous = F.substring_index(file, "/", -1), name.rlike(r"^<(anonymous|lambda)")
    named = F.when((F.length(parent) > 0) & ~is_synthetic(parent), parent)
    place = F.concat(F.lit("anon <"), base, F.lit(":"), line.cast("string"), F.lit(">"))
    own = F.when(named.isNotNull(), F.concat(named, F.lit("."), name)).otherwise(name)
    return F.when(name == "<module>", base).when(anonymous, F.concat_ws(" · ", named, place)).otherwise(own)


def relative_to(path: Column, root: str) -> Column:
    """A path without its root; others as they are."""
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(path)


def wire_type(profile_type: Column, bundle: bool = False) -> Column:
    return F.concat(profile_type, F.lit("_profile" if bundle else "_trace"))


def fingerprint(text: Column) -> Column:
    """An identity of a statement that ignores how its blanks are laid out; only equality means anything."""
    return F.xxhash64(F.regexp_replace(F.trim(text), r"\s+", " "))


def folder_fingerprint(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def truncated(text: Column, most: int) -> Column:
    """A text of over `most` bytes is cut to as many characters, with an ellipsis."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def bounded_distance(a: Column, b: Column, most: Column) -> Column:
    """The edit distance, or most + 1 beyond it."""
    d = F.call_function("levenshtein", a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def similarity(a: Column, b: Column, threshold: int = 95) -> Column:
    """round((la + lb - d) / (la + lb) * 100), 0 where the bound that the threshold allows is passed; two empty texts are alike."""
    total = F.length(a) + F.length(b)
    most = F.ceil((100 - threshold) * total / 100).cast("int")
    d = F.call_function("levenshtein", a, b, most)
    return F.when(total == 0, F.lit(100)).when(d < 0, F.lit(0)).otherwise(F.floor((total - d) / total * 100 + 0.5)).cast("long")


def finite(x: Column) -> Column:
    """0 for what is not a number or not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite(x)))


def log_share(x: Column, full: float) -> Column:
    """ln(1 + x) as a share of ln(1 + full), from 0 to 1."""
    return clamp01(F.log1p(F.greatest(x, F.lit(0.0))) / F.log1p(F.lit(float(full)))) if full > 0 else F.lit(0.0)


def smoothstep(x: Column, low: float, high: float) -> Column:
    if high <= low:
        return F.when(x >= high, F.lit(1.0)).otherwise(F.lit(0.0))
    t = clamp01((x - low) / (high - low))
    return t * t * (3 - 2 * t)


def band(score: Column, higher_is_better: bool = True) -> Column:
    s = score if higher_is_better else 1 - score
    return F.when(s >= 0.66, "green").when(s >= 0.33, "amber").otherwise("red")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded to digits, halves away from zero."""
    scale = 10**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def word_tokens(text: Column) -> Column:
    """Runs of letters, numbers and underscores."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def token_footprint(n_bytes: Column, n_words: Column | None = None, per_token: float = 2.8, per_word: float = 2.1, width: float = 0.2) -> Column:
    """struct(estimate, lo, hi) of tokens: bytes by rate, in the mean with words by rate where they are known."""
    by_bytes = F.ceil(n_bytes / per_token)
    estimate = by_bytes if n_words is None else half_up((by_bytes + half_up(n_words * per_word)) / 2)
    return F.struct(estimate.cast("long").alias("estimate"), F.floor(estimate * (1 - width)).cast("long").alias("lo"), F.ceil(estimate * (1 + width)).cast("long").alias("hi"))


def tokens_of_lines(lines: Column, per_line: float = 13.0) -> Column:
    return half_up(lines * per_line).cast("long")


def context_pressure(tokens: Column, window: int = 1_000_000, usable: float = 0.3, overhead: int = 25_000, green: int = 45_000, yellow: int = 110_000) -> Column:
    """struct(band, budget, load) of a diff of so many tokens."""
    whole = max(window * usable, 1.0)
    of = F.when(tokens < green, "green").when(tokens < yellow, "yellow").otherwise("red")
    return F.struct(of.alias("band"), F.lit(max(int(whole) - overhead, 0)).cast("long").alias("budget"), finite((tokens + overhead) / whole).alias("load"))


def duration_text(us: Column) -> Column:
    """Microseconds as `7 µs`, `1.50 ms` or `2.00 s`."""
    return F.when(us < 1000, F.concat(us.cast("long").cast("string"), F.lit(" µs"))).when(us < 1_000_000, F.concat(F.format_string("%.2f", us / 1000.0), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.2f", us / 1e6), F.lit(" s")))


def bumped(severity: Column, percent_total: Column, pagerank: Column, call_sites: Column, p90: Column) -> Column:
    """A severity raised by impact: boosts are a fifth of the tree, a rank of the top tenth, ten call sites."""
    boost = (percent_total >= 20).cast("int") + ((pagerank >= p90) & (p90 > 0)).cast("int") + (call_sites >= 10).cast("int")
    return F.when((severity == "low") & (boost == 3), "high").when((severity == "low") & (boost == 2), "medium").when((severity == "medium") & (boost >= 2), "high").otherwise(severity)


def self_category(categories: Column) -> Column:
    """The category of most signal among those of a symbol's external calls."""
    out = F.lit(None).cast("string")
    for name in reversed(("db", "network", "io", "cache", "queue", "log")):
        out = F.when(F.array_contains(categories, name), name).otherwise(out)
    return out


def in_ranges(at: Column, ranges: Column) -> Column:
    """Whether a place is in one of the ranges (s, e), ends included."""
    return F.coalesce(F.exists(ranges, lambda r: at.between(r["s"], r["e"])), F.lit(False))


#: Fixed value: bytes of a document in which a field is sought.
PREFIX_BYTES = 8192


def prefix_field(text: Column, field: str) -> Column:
    """The string value of a JSON document's field, sought in its first PREFIX_BYTES bytes alone; null if it is not there whole, is no string, or has unicode escapes."""
    head = F.call_function("make_valid_utf8", F.substring(F.encode(text, "utf-8"), 1, PREFIX_BYTES).cast("string"))
    name = f'"{field}"'
    rest = F.when(F.contains(head, F.lit(name)), F.substr(head, F.locate(name, head) + F.lit(len(name))))
    pattern = r'^\s*:\s*"((?:[^"\\]|\\["\\/ntrbf])*)"'
    return F.when(rest.rlike(pattern), F.get_json_object(F.concat(F.lit('{"v":"'), F.regexp_extract(rest, pattern, 1), F.lit('"}')), "$.v"))
