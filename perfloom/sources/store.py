"""Stores in shared folders: scans with their projections, histories, key-value tables, compact reports.

Writes go through Spark's commit protocol, so a reader sees a whole table or none of it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import settle


def scan_id(text: str) -> str:
    """The text, if it may name a scan; no separators, no steps up, not hidden."""
    if not text or re.search(r"[/\\\x00]", text) or ".." in text or text.startswith("."):
        raise ValueError(f"not a scan's name: {text!r}")
    return text


def save_json(df: DataFrame, path: str) -> None:
    """Replaces the rows of a path as JSON, whole or not at all."""
    df.write.mode("overwrite").json(path)


def save_scan(scan: str, nodes: DataFrame, meta: DataFrame, root: str, failed: Callable[[str, Exception], None] | None = None) -> None:
    """Writes a scan's nodes, then its meta row, per-entry partitions and summary under `root`.

    The envelope (nodes) must succeed; the projections beside it may fail, which is told to `failed`.
    """
    at = f"{root}/{scan_id(scan)}"
    nodes.write.mode("overwrite").parquet(f"{at}/nodes")
    kept = nodes.sparkSession.read.parquet(f"{at}/nodes")
    heads = [c for c in kept.columns if c not in ("children", "findings", "externals", "callers")]
    parts = {
        "meta": lambda: meta.withColumn("scan", F.lit(scan)).write.mode("overwrite").json(f"{at}/meta"),
        "entries": lambda: kept.write.mode("overwrite").partitionBy("entry").parquet(f"{at}/entries"),
        "summary": lambda: kept.select(*heads).groupBy("entry").agg(F.count(F.lit(1)).alias("nodes")).write.mode("overwrite").parquet(f"{at}/summary"),
    }
    for name, write in parts.items():
        try:
            write()
        except Exception as error:
            if failed is None:
                raise
            failed(name, error)


def list_scans(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The meta rows of all scans, newest first; rows that don't parse, or without a name, are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(f"{root}/*/meta")
    return rows.filter("_corrupt_record is null and scan is not null").drop("_corrupt_record").orderBy(F.desc("saved_at"), "scan")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_scan(spark: SparkSession, root: str, scan: str) -> bool:
    """Removes a scan with its projections; whether there was one. The meta row goes first, so that no list shows a scan that is half gone."""
    there = False
    for part in (f"{scan_id(scan)}/meta", scan):
        at, fs = _path(spark, f"{root}/{part}")
        there = (fs.exists(at) and fs.delete(at, True)) or there
    return there


def import_scan(spark: SparkSession, source: str, root: str, scan: str, columns: list[str], strings: list[str], replace: bool = False) -> int:
    """Takes a report from elsewhere, plain or compact, into the store under a name of its own; returns its nodes.

    The report must have the columns, of which a compact one numbers the `strings`; a name that is taken is refused, unless it is to be replaced. Projections are made anew.
    """
    at, fs = _path(spark, f"{root}/{scan_id(scan)}")
    if fs.exists(at) and not replace:
        raise FileExistsError(f"there is a scan {scan!r}")
    nodes = read_report(spark, source, strings)
    lacking = [c for c in [*columns, "entry"] if c not in nodes.columns]
    if lacking:
        raise ValueError(f"the report has no {', '.join(lacking)}")
    if fs.exists(at):
        delete_scan(spark, root, scan)
    n = nodes.count()
    save_scan(scan, nodes, spark.createDataFrame([(time.time_ns() // 1000, n)], "saved_at long, nodes long"), root)
    return n


def load_entry(spark: SparkSession, root: str, scan: str, entry: str) -> DataFrame:
    """One entry's nodes: the partition alone is read."""
    return spark.read.parquet(f"{root}/{scan_id(scan)}/entries").filter(F.col("entry") == entry)


def scan_index(metas: DataFrame, key: str) -> DataFrame:
    return metas.orderBy(key)


def next_version(history: DataFrame | None, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows with the next version numbers of their key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if history is None:
        return new.withColumn("version", place)
    last = history.groupBy(key).agg(F.max("version").alias("_last"))
    return new.withColumn("_n", place).join(last, key, "left").withColumn("version", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """A keyed table from its log: the last row of a key, unless that deletes it (`deleted`)."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("r")).select("r.*")
    return last.filter(~F.coalesce("deleted", F.lit(False)))


def conversation_list(store: DataFrame) -> DataFrame:
    """Summaries (id, title, message_count, updated_at) of conversations, newest first."""
    return store.select("id", "title", F.size("messages").alias("message_count"), "updated_at").orderBy(F.desc("updated_at"), "id")


def save_table(df: DataFrame, path: str) -> None:
    """All rows of a small table anew, as of a cache of what was discovered."""
    df.write.mode("overwrite").parquet(path)


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """Numbers (value, code) of distinct strings, from 1 by code point; 0 is the empty string. Ranges are dealt out, no task ranks all."""
    from ..operators.profile import global_rank

    distinct = values.select(F.coalesce(F.col(column), F.lit("")).alias("value")).filter("value <> ''").distinct()
    ranked = global_rank(distinct, ["value"]).select("value", (F.col("rank") + 1).alias("code"))
    return ranked.unionByName(ranked.sparkSession.createDataFrame([("", 0)], "value string, code long"))


def encode(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the codes of their string columns, and the dictionary that all columns share."""
    from ..operators.graph import settle

    all_ = None
    for c in columns:
        own = rows.select(F.col(c).alias("value"))
        all_ = own if all_ is None else all_.unionByName(own)
    codes = settle(dictionary(all_, "value"))
    out = rows
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(""))).join(codes.withColumnsRenamed({"value": c, "code": f"_{c}"}), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*rows.columns), codes


def decode(rows: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    out = rows
    for c in columns:
        out = out.join(codes.withColumnsRenamed({"value": f"_{c}", "code": c}), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*rows.columns)


def write_compact(rows: DataFrame, columns: list[str], path: str) -> None:
    coded, codes = encode(rows, columns)
    codes.write.mode("overwrite").parquet(f"{path}/strings")
    coded.write.mode("overwrite").parquet(f"{path}/rows")


def read_report(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A report's rows, whether it is a plain table or a compact one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/strings")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return decode(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/strings"), columns)
    return spark.read.parquet(path)


def flat_nodes(entries: DataFrame) -> DataFrame:
    """Nodes (id, seq, ...) of several trees, one row an id: the first by seq."""
    return entries.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).filter("_r = 1").drop("_r")


def symbol_spans(symbols: DataFrame, changed: DataFrame, most: int = 120) -> DataFrame:
    """Symbols (id, file, line, line_end) of changed files, the first `most` of each file by line."""
    from ..operators.symbols import in_scope

    own = in_scope(symbols, changed)
    # of a file's rows dealt at random, the least lines of as many shares as are wanted bound the line of the last one wanted: few rows are left to sort
    share = F.pmod(F.xxhash64("line", "id"), F.lit(8 * most))
    least = own.groupBy("file", share.alias("_share")).agg(F.min("line").alias("_least")).groupBy("file").agg(F.get(F.array_sort(F.collect_list("_least")), F.lit(most - 1)).alias("_last"))
    near = own.join(least, "file", "left").filter("_last is null or line is null or line <= _last").drop("_last")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("line", "id"))).filter(F.col("_r") <= most).drop("_r")


def profile_bundles(samples: DataFrame, window_us: int, period_ns: int) -> DataFrame:
    """Rows (start_us, stack, count, value_ns) by window: a stack's value is its count times the period."""
    start = F.expr(f"time_us div {window_us} * {window_us}")
    return samples.groupBy(start.alias("start_us"), "stack").agg(F.sum("n").alias("count")).withColumn("value_ns", F.col("count") * period_ns)


def replay(lines: DataFrame, order: str) -> DataFrame:
    """The accepted lines of a log in their order, as they were."""
    from .texts import accepted

    return accepted(lines).orderBy(order).select("raw")


#: Folders that a source walk leaves out, and endings of files without source.
SKIPPED_FOLDERS = ("node_modules", ".git", "target", "dist", "build", "vendor", "__pycache__", ".venv", "venv", ".next", "coverage")
STATIC_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "pdf", "zip", "gz", "lock", "map")


def ignored(path: Column, patterns: list[str] = ()) -> Column:
    """Whether a root-relative path is left out: by folder, ending, minified name, or lines of an ignore file (`*`, `**`, `dir/`, a leading `/`)."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    out = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*SKIPPED_FOLDERS)) | F.lower(name).rlike(rf"\.({'|'.join(STATIC_ENDINGS)})$") | name.rlike(r"[.-]min\.(js|css)$")
    for line in patterns:
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        anchored, folder = rule.startswith("/") or "/" in rule.rstrip("/"), rule.endswith("/")
        body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out = out | path.rlike(("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)"))
    return out


def source_files(paths: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """Rows (path, size, lang) of the source files of a tree (path, size), those left out by name or by the ignore lines."""
    from ..functions.scalars import language

    return paths.filter(~ignored(F.col("path"), list(patterns))).select("path", "size", language(F.col("path")).alias("lang"))


def sql_files(paths: DataFrame) -> DataFrame:
    return paths.filter(F.lower("path").endswith(".sql") & ~ignored(F.col("path")))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, size) of the files below a root, relative to it; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    return found.select(F.regexp_replace("path", rf"^.*?{re.escape(base)}/", "").alias("path"), "size")


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """Rows (stack, n) of a file of stacks: a speedscope document if it ends in .json, else folded text."""
    from .events import folded, read_lines, speedscope

    return speedscope(spark, path) if path.lower().endswith(".json") else folded(read_lines(spark, path))


def entry_declarations(files: DataFrame) -> DataFrame:
    """Rows (path, kind, name, argv) of commands that files (path, text) declare.

    Dockerfiles: the last ENTRYPOINT and CMD, in JSON or shell form; package.json: main, bin and scripts; pyproject.toml: scripts;
    compose files: `command:` of services; Cargo.toml: [[bin]] paths.
    """
    name = F.lower(F.substring_index("path", "/", -1))

    def argv(text: Column) -> Column:
        return F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.filter(F.split(text, r"\s+"), lambda w: w != ""))

    docker = files.filter(name.rlike(r"^dockerfile|\.dockerfile$")).select("path", F.posexplode(F.split(F.regexp_replace("text", r"\\\s*\n", " "), "\n")).alias("at", "line"))
    docker = docker.select("path", "at", F.lower(F.regexp_extract("line", r"(?i)^\s*(ENTRYPOINT|CMD)\s+(.*)$", 1)).alias("kind"), F.trim(F.regexp_extract("line", r"(?i)^\s*(ENTRYPOINT|CMD)\s+(.*)$", 2)).alias("rest")).filter("kind <> ''")
    docker = docker.groupBy("path", "kind").agg(F.max_by("rest", "at").alias("rest")).select("path", "kind", F.lit("").alias("name"), argv(F.col("rest")).alias("argv"))
    package = files.filter(name == "package.json").select("path", F.from_json("text", "main string, bin string, scripts map<string,string>").alias("p"))
    scripts = package.select("path", F.explode("p.scripts").alias("name", "rest")).select("path", F.lit("script").alias("kind"), "name", argv(F.col("rest")).alias("argv"))
    main = package.filter("p.main is not null").select("path", F.lit("main").alias("kind"), F.lit("").alias("name"), F.array("p.main").alias("argv"))
    binary = package.filter("p.bin is not null").select("path", F.col("p.bin").alias("b")).select("path", F.explode(F.coalesce(F.from_json("b", "map<string,string>"), F.create_map(F.lit(""), F.col("b")))).alias("name", "rest")).select("path", F.lit("bin").alias("kind"), "name", F.array("rest").alias("argv"))
    block = F.regexp_extract("text", r"(?s)\[project\.scripts\]\s*\n(.*?)(?:\n\[|\z)", 1)
    project = files.filter(name == "pyproject.toml").select("path", F.explode(F.split(block, "\n")).alias("line")).select("path", F.lit("script").alias("kind"), F.regexp_extract("line", r"^\s*\"?([\w.-]+)\"?\s*=\s*[\"']([^\"']+)[\"']", 1).alias("name"), F.array(F.regexp_extract("line", r"^\s*\"?([\w.-]+)\"?\s*=\s*[\"']([^\"']+)[\"']", 2)).alias("argv")).filter("name <> ''")
    compose = files.filter(name.rlike(r"^(docker-)?compose[^/]*\.ya?ml$")).select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s+command:\s*(.+)$"), F.lit(1))).alias("rest")).select("path", F.lit("command").alias("kind"), F.lit("").alias("name"), argv(F.regexp_replace(F.trim("rest"), r"^[\"'](.*)[\"']$", "$1")).alias("argv"))
    cargo = files.filter(name == "cargo.toml").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)\[\[bin\]\](.*?)(?=\n\[|\z)"), F.lit(1))).alias("b")).select("path", F.lit("bin").alias("kind"), F.regexp_extract("b", r"name\s*=\s*\"([^\"]+)\"", 1).alias("name"), F.array(F.coalesce(F.nullif(F.regexp_extract("b", r"path\s*=\s*\"([^\"]+)\"", 1), F.lit("")), F.lit("src/main.rs"))).alias("argv"))
    out = docker
    for part in (scripts, main, binary, project, compose, cargo):
        out = out.unionByName(part)
    return out


#: Names of a file's entry function, the preferred first.
ENTRY_NAMES = ("main", "run", "start", "serve", "handler", "app", "cli")


def match_entries(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows (entry, id, how) of entries (entry, argv) with the symbol (id, name, file, line, loc) they start.

    A word of the command that names a file, then `-m module`, then `module:function`; in a file the preferred name, else the first symbol;
    of several files the one with the most lines.
    """
    words = settle(entries.select("entry", F.posexplode("argv").alias("at", "word"), "argv"))
    clean = F.regexp_replace("word", r"^(\./)+|^/", "")
    files = words.filter(clean.rlike(r"\.[A-Za-z]+$")).select("entry", F.lit(1).alias("how"), "at", clean.alias("end"), F.lit(None).cast("string").alias("want"))
    before = F.get("argv", F.col("at") - 1)

    def paths(module: Column) -> Column:
        base = F.replace(module, F.lit("."), F.lit("/"))
        return F.explode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__main__.py")), F.concat(base, F.lit("/__init__.py"))))

    modules = words.filter((F.col("at") > 0) & (before == "-m")).select("entry", F.lit(2).alias("how"), "at", paths(F.col("word")).alias("end"), F.lit(None).cast("string").alias("want"))
    points = words.filter((F.size("argv") == 1) & F.col("word").rlike(r"^[\w.]+:[\w.]+$")).select("entry", F.lit(3).alias("how"), "at", paths(F.substring_index("word", ":", 1)).alias("end"), F.substring_index("word", ":", -1).alias("want"))
    asked = files.unionByName(modules).unionByName(points)
    parts = F.split("file", "/")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    preferred = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in ENTRY_NAMES]), F.col("name")), F.lit(0)), F.lit(len(ENTRY_NAMES) + 1))
    # of a file one symbol can be told, and one of each name: files, not symbols, meet what is asked, and what several entries ask is answered once
    place = F.struct(preferred.alias("preferred"), F.col("line").alias("line"), F.col("id").alias("id"))
    top = symbols.groupBy("file").agg(F.sum("loc").alias("lines"), F.min(place).alias("top"))
    named = symbols.filter("name is not null").groupBy("file", F.col("name").alias("want")).agg(F.min(place).alias("named"))
    questions = asked.select("end", "want").distinct()
    met = questions.join(top.select("file", "lines", "top", ends.alias("end")), "end").join(named, ["file", "want"], "left")
    hit = F.col("want").isNull() | F.col("named").isNotNull()
    rank = F.struct(F.when(hit, 0).otherwise(1).alias("other"), (-F.col("lines")).alias("lines"), F.coalesce("named", "top").alias("place"))
    answers = met.groupBy("end", "want").agg(F.min(rank).alias("answer"))
    told = asked.alias("q").join(answers.alias("a"), (F.col("q.end") == F.col("a.end")) & F.col("q.want").eqNullSafe(F.col("a.want")))
    best = told.groupBy("q.entry").agg(F.min(F.struct("q.how", "q.at", "a.answer")).alias("b"))
    return best.select("entry", F.col("b.answer.place.id").alias("id"), F.col("b.how").alias("how"))


def of_declarations(entries: DataFrame, matched: DataFrame) -> DataFrame:
    """Entries whose id some declaration starts."""
    return entries.join(matched.select("id").distinct(), "id", "left_semi")


def declaration_search(declared: DataFrame, text: str) -> DataFrame:
    """Declarations (raw, service, file, symbol, kind, line) that hold the text, those that start with it first; then by kind, file, line."""
    from ..operators.changes import search

    found = search(declared, dict.fromkeys(("raw", "service", "file", "symbol", "kind"), text))
    rank = F.when(F.startswith(F.lower("symbol"), F.lit(text.lower())), 0).when(F.contains(F.lower("symbol"), F.lit(text.lower())), 1).otherwise(2)
    return found.orderBy(rank, "kind", "file", "line")
