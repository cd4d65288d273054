"""What a call, a text or a source file is about: tables of names and patterns against columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Families of qualities other than function, and the patterns that tell them, case ignored.
FAMILIES = (
    ("reliability", ("retry", "timeout", "circuit", "fallback", "idempot", "deadline")),
    ("scalability", ("rate.?limit", "throttle", "backpressure", "queue")),
    ("performance", ("cache", "memoiz", "batch", "bulk", "prefetch")),
    ("observability", ("metric", "trace", "telemetry", r"\bspan\b", r"\blog\b", "audit")),
    ("security", ("auth", "verify", "hmac", "signature", "encrypt", "sanitiz")),
    ("input_safety", ("validate", "schema", "sanitize", "escape", "normalize")),
)


def families(text: Column) -> Column:
    """The families that a text speaks of, in the table's order."""
    hits = [F.when(text.rlike(f"(?i)({'|'.join(patterns)})"), F.lit(name)) for name, patterns in FAMILIES]
    return F.array_compact(F.array(*hits))


def module_categories(modules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (module, category): the category of the longest catalogued prefix (prefix, category) that ends at `.`, `/`, `::` or the end.

    Prefixes are made in the row, so the match is an equi-join however long the catalogue is.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.length("module")), lambda i: F.struct(F.substring(F.col("module"), F.lit(1), i).alias("prefix"), F.substring(F.col("module"), i + 1, F.lit(2)).alias("next")))
    ends = F.filter(cuts, lambda c: (c["next"] == "") | F.substring(c["next"], 1, 1).isin(".", "/") | (c["next"] == "::"))
    spread = modules.select("module").filter("module <> ''").distinct().select("module", F.explode(ends).alias("c")).select("module", "c.prefix")
    return spread.join(catalog, "prefix").groupBy("module").agg(F.max_by("category", F.length("prefix")).alias("category"))


def external_calls(calls: DataFrame, imports: DataFrame, catalog: DataFrame, receivers: DataFrame, methods: DataFrame) -> DataFrame:
    """Rows (call, category, tier) of calls (call, file, name, receiver): by an imported module, else the receiver's name, else an unambiguous method.

    An import (file, local, module) speaks for a receiver that is its local name or the module's first part.
    """
    first = F.get(F.filter(F.split("module", r"[./:]"), lambda p: p != ""), F.lit(0))
    known = imports.join(module_categories(imports, catalog), "module")
    by_name = known.select("file", F.col("local").alias("receiver"), "category").union(known.select("file", first.alias("receiver"), "category"))
    imported = calls.join(by_name.groupBy("file", "receiver").agg(F.min("category").alias("category")), ["file", "receiver"]).select("call", "category", F.lit("imported_module").alias("tier"), F.lit(1).alias("_p"))
    named = calls.withColumn("pattern", F.lower("receiver")).join(receivers, "pattern").select("call", "category", F.lit("receiver_pattern").alias("tier"), F.lit(2).alias("_p"))
    single = calls.withColumn("method", F.col("name")).join(methods, "method").select("call", "category", F.lit("method_signature").alias("tier"), F.lit(3).alias("_p"))
    return imported.union(named).union(single).groupBy("call").agg(F.min_by(F.struct("category", "tier"), "_p").alias("b")).select("call", "b.*")


#: Marks of comments by language: to the line's end, block open, block close.
COMMENTS = {"Python": ("#", None, None), "Ruby": ("#", None, None), "Shell": ("#", None, None), "SQL": ("--", "/*", "*/"), "Lua": ("--", "--[[", "]]")}
C_LIKE = ("//", "/*", "*/")


def source_stats(files: DataFrame) -> DataFrame:
    """Rows (path, code_lines, comment_lines, blank_lines, magic, numbers, todos) of files (path, text).

    Texts within quotes are blanked first. A line with code counts as code, whatever else it has; inside a block comment it is a comment.
    Numbers other than 0, 1, 2 and 100 in code are magic, unless a constant in capitals is set to them. One pass over a file's lines, in its row.
    """
    from .scalars import language

    lang = language(F.col("path"))

    def mark(k: int) -> Column:
        own = F.create_map(*[F.lit(x) for n, c in COMMENTS.items() for x in (n, c[k] or "")])
        return F.coalesce(F.try_element_at(own, lang), F.lit(C_LIKE[k]))

    # small files of many texts would be read, and so worked out, by few tasks
    dealt = files.select("path", "text").repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    rows = dealt.select("path", F.split("text", "\n").alias("lines"), *[mark(k).alias(n) for k, n in enumerate(("till_end", "open", "close"))])

    def cut(line: Column) -> Column:
        return F.regexp_replace(line, r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "''")

    def before(text: Column, m: Column) -> Column:
        # split_part wants a mark that isn't empty; a null byte is in no source text
        return F.split_part(text, F.when(m == "", F.lit("\x00")).otherwise(m), F.lit(1))

    def let(x: Column, f) -> Column:
        # x is worked out once, however often f names it: written out, a line's text would be made some hundred times
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def shut() -> Column:
        return F.when(F.col("close") == "", F.lit("\x00")).otherwise(F.col("close"))

    def step(s: Column, line: Column) -> Column:
        return let(cut(line), lambda text: after(s, line, text))

    def after(s: Column, line: Column, text: Column) -> Column:
        # what is left of an open block: the line after its close
        closes = s["inside"] & F.contains(text, shut())
        text = F.when(s["inside"], F.when(closes, F.split_part(text, shut(), F.lit(2))).otherwise("")).otherwise(text)
        text = F.when(F.col("open") != "", F.regexp_replace(text, r"/\*.*?\*/", " ")).otherwise(text)
        return let(F.struct(text.alias("text"), closes.alias("closes")), lambda t: opened(s, line, t["text"], t["closes"]))

    def opened(s: Column, line: Column, text: Column, closes: Column) -> Column:
        opens = (F.col("open") != "") & F.contains(before(text, F.col("till_end")), F.col("open")) & ~F.contains(F.split_part(text, F.when(F.col("open") == "", F.lit("\x00")).otherwise(F.col("open")), F.lit(2)), shut())
        going = (s["inside"] & ~closes) | opens
        code = before(text, F.col("till_end"))
        return let(F.struct(text.alias("text"), opens.alias("opens"), going.alias("inside"), code.alias("code")), lambda t: let(F.when(t["opens"], before(t["code"], F.col("open"))).otherwise(t["code"]), lambda code: counted(s, line, code, t["inside"])))

    def counted(s: Column, line: Column, code: Column, inside: Column) -> Column:
        has_code, blank = F.trim(code) != "", F.trim(line) == ""
        numbers = F.regexp_extract_all(code, F.lit(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])"), F.lit(0))
        named = code.rlike(r"^\s*(const |final |static |public |private )*[A-Z][A-Z0-9_]*\s*[:=]")
        todos = F.size(F.regexp_extract_all(line, F.lit(r"\b(TODO|FIXME|HACK|XXX)\b"), F.lit(0)))

        def summed(f: Column) -> Column:
            magic = F.when(f["named"], 0).otherwise(F.size(F.filter(f["numbers"], lambda x: ~x.isin("0", "1", "2", "100"))))
            return F.struct(
                (s["code"] + f["has_code"].cast("int")).alias("code"), (s["comment"] + (~f["has_code"] & ~f["blank"]).cast("int")).alias("comment"), (s["blank"] + (~f["has_code"] & f["blank"]).cast("int")).alias("blank"),
                (s["magic"] + magic).alias("magic"), (s["numbers"] + F.size(f["numbers"])).alias("numbers"), (s["todos"] + todos).alias("todos"), inside.alias("inside"),
            )

        return let(F.struct(has_code.alias("has_code"), blank.alias("blank"), numbers.alias("numbers"), named.alias("named")), summed)

    zero = F.struct(*[F.lit(0).alias(n) for n in ("code", "comment", "blank", "magic", "numbers", "todos")], F.lit(False).alias("inside"))
    return rows.select("path", F.aggregate("lines", zero, step).alias("s")).select("path", F.col("s.code").alias("code_lines"), F.col("s.comment").alias("comment_lines"), F.col("s.blank").alias("blank_lines"), "s.magic", "s.numbers", "s.todos")


def densities() -> dict[str, Column]:
    """Shares over the columns of `source_stats`: comments of all that is no blank, magic of all numbers."""
    said = F.col("code_lines") + F.col("comment_lines")
    return {"comment_density": F.when(said > 0, F.col("comment_lines") / said).otherwise(0.0), "magic_ratio": F.when(F.col("numbers") > 0, F.col("magic") / F.col("numbers")).otherwise(0.0)}


def dominant_category(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """The most frequent category (category, n) of nodes (file, category) in files (path) that their file ends in; ties by name."""
    from ..operators.symbols import in_scope

    return in_scope(nodes, files).filter("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(1)


def unsafe_step(chains: DataFrame, fields: DataFrame, prefetched: DataFrame) -> DataFrame:
    """Rows (chain, pos, field) of the first step of a chain (chain, model, path) that follows a relation which was not prefetched.

    fields: rows (model, field, target), target null for plain columns. Steps are taken one by one, each a join on (model, field).
    """
    longest = chains.agg(F.max(F.size("path"))).first()[0] or 0
    at, found = chains.select("chain", F.col("model").alias("at"), "path"), None
    for pos in range(longest):
        step = at.filter(F.size("path") > pos).withColumn("field", F.get("path", F.lit(pos)))
        met = step.join(fields.select(F.col("model").alias("at"), "field", "target"), ["at", "field"])
        bad = met.filter("target is not null").join(prefetched.select("chain", "field"), ["chain", "field"], "left_anti").select("chain", F.lit(pos).alias("pos"), "field")
        found = bad if found is None else found.unionByName(bad)
        at = met.filter("target is not null").select("chain", F.col("target").alias("at"), "path")
    if found is None:
        return chains.select("chain", F.lit(0).alias("pos"), F.lit("").alias("field")).limit(0)
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("chain").orderBy("pos"))).filter("_r = 1").drop("_r")


#: Libraries for schemas and validation by language, as they are named in imports and calls.
SCHEMA_LIBRARIES = {
    "python": ("pydantic", "jsonschema", "fastjsonschema", "marshmallow", "cerberus", "voluptuous"),
    "javascript": ("ajv", "joi", "zod", "yup", "superstruct", "valibot"),
    "typescript": ("ajv", "zod", "yup", "io-ts", "valibot", "arktype"),
    "java": ("jakarta.validation", "javax.validation", "hibernate-validator", "networknt/json-schema-validator"),
    "go": ("go-playground/validator", "xeipuuv/gojsonschema", "ozzo-validation"),
    "rust": ("serde_json", "serde_yaml", "jsonschema", "validator", "garde", "schemars"),
    "scala": ("circe", "play-json", "pureconfig", "scala-jsonschema", "cats.data.Validated"),
    "kotlin": ("konform", "kotlinx.serialization", "valiktor", "ktor", "jakarta.validation"),
}
#: What a library is also called, and endings of the languages.
ALSO = {"xeipuuv/gojsonschema": r"gojsonschema", "play-json": r"play-?json"}
ENDINGS = {"python": ("py",), "go": ("go",), "typescript": ("tsx", "ts"), "javascript": ("jsx", "js", "mjs", "cjs"), "java": ("java",), "rust": ("rs",), "scala": ("scala", "sc"), "kotlin": ("kt", "kts")}


def schema_libraries(files: DataFrame) -> DataFrame:
    """Rows (path, language, library) of the schema libraries that texts (path, texts array) of a file's language name as whole words; one projection.

    A null text names none; a file of another language has none.
    """
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    language = F.coalesce(*[F.when(ending.isin(*ends), F.lit(lang)) for lang, ends in ENDINGS.items()])

    def named(lang: str, library: str) -> Column:
        pattern = rf"\b({ALSO.get(library, re.escape(library))})\b"
        return F.when((F.col("language") == lang) & F.exists(F.coalesce("texts", F.array().cast("array<string>")), lambda t: F.coalesce(t.rlike(pattern), F.lit(False))), F.lit(library))

    found = F.array_compact(F.array(*[named(lang, x) for lang, own in SCHEMA_LIBRARIES.items() for x in own]))
    return files.withColumn("language", language).select("path", "language", F.explode(found).alias("library"))
