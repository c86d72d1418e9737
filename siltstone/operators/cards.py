"""Structure cards: outlines per file and per directory, as plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X

LISTED, MEMBERS, MODULES, SYMBOLS = 25, 8, 18, 10


def markdown_cards(docs: DataFrame) -> DataFrame:
    """docs (path, content) -> path, text: the first distinct headings; no row for a file without any."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^#{1,3}[ \t]+(.+)$")), lambda x: F.trim(x)))
    rows = docs.select("path", found.alias("heads")).where(F.size("heads") > 0)
    return rows.select("path", F.concat("path", F.lit(" — documentation page.\nSections: "), F.array_join(F.slice("heads", 1, LISTED), "; "), F.lit(".")).alias("text"))


def _in_order(value, when):
    """Distinct values of the rows that match, in the order of their first place."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("seq", value.alias("v"))))), lambda s: s["v"]))


def chunk_cards(chunks: DataFrame) -> DataFrame:
    """chunks (path, language, seq, kind, symbol, parent_symbol) -> path, text: declared types with members, and functions."""
    named = chunks.where(F.coalesce("symbol", F.lit("")) != "")
    is_type = F.col("kind") == "class_skeleton"
    members = named.where(~is_type & F.col("parent_symbol").isNotNull()).groupBy("path", F.col("parent_symbol").alias("type")).agg(F.slice(_in_order(F.col("symbol"), F.lit(True)), 1, MEMBERS).alias("members"))
    types = named.where(is_type).groupBy("path", F.col("symbol").alias("type")).agg(F.min("seq").alias("seq"))
    shown = types.join(members, ["path", "type"], "left").withColumn("v", F.when(F.size("members") > 0, F.concat("type", F.lit(" (members: "), F.array_join("members", ", "), F.lit(")"))).otherwise(F.col("type")))
    listed = shown.groupBy("path").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda s: s["v"]), 1, LISTED).alias("types"))
    functions = named.where((F.col("kind") == "function") & F.col("parent_symbol").isNull()).groupBy("path").agg(F.slice(_in_order(F.col("symbol"), F.lit(True)), 1, LISTED).alias("functions"))
    head = chunks.groupBy("path").agg(F.min("language").alias("language")).withColumn("package", X.parent(F.col("path"))).withColumn("package", F.when(F.col("package") == ".", "(root)").otherwise(F.col("package")))
    rows = head.join(listed, "path", "left").join(functions, "path", "left").where("types IS NOT NULL OR functions IS NOT NULL")
    lines = F.concat_ws("\n", F.concat("path", F.lit(" — "), "language", F.lit(" module in "), "package", F.lit(".")), F.concat(F.lit("Declares types: "), F.array_join("types", "; "), F.lit(".")), F.concat(F.lit("Declares functions: "), F.array_join("functions", ", "), F.lit(".")))
    return rows.select("path", lines.alias("text"))


def package_cards(modules: DataFrame, max_tokens: int = 400) -> DataFrame:
    """modules (package, name, symbols array) -> path, part, part_count, module_count, text; packages of two modules on.

    Eighteen modules a card; trailing ones are left out until the card is within the budget, one always stays.
    """
    entry = F.when(F.size("symbols") > 0, F.concat("name", F.lit(" defines "), F.array_join(F.slice("symbols", 1, SYMBOLS), ", "), F.lit("."))).otherwise(F.concat("name", F.lit(" (re-exports only).")))
    w = Window.partitionBy("package")
    rows = modules.withColumn("entry", entry).withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("name")) - 1).where("n >= 2")
    rows = rows.withColumn("part", (F.floor(F.col("at") / MODULES) + 1).cast("int")).withColumn("parts", F.ceil(F.col("n") / MODULES).cast("int"))
    note = F.when(F.col("parts") > 1, F.concat(F.lit(" (part "), F.col("part").cast("string"), F.lit(" of "), F.col("parts").cast("string"), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("Package "), "package", F.lit(" — contains "), F.col("n").cast("string"), F.lit(" Python modules"), note, F.lit(". Structure and organization of "), "package", F.lit(":"))
    rows = rows.withColumn("head", head)
    within = Window.partitionBy("package", "part").orderBy("at")
    size = F.length("head") + F.sum(F.length("entry") + 1).over(within)
    kept = rows.withColumn("tokens", F.greatest(F.lit(1), F.floor(size / 4))).withColumn("k", F.row_number().over(within)).where((F.col("tokens") <= max_tokens) | (F.col("k") == 1))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda s: s["entry"]), "\n")
    cards = kept.groupBy("package", "part", "parts", "n", "head").agg(body.alias("body"))
    several = F.col("parts") > 1
    return cards.select(F.concat("package", F.lit("/")).alias("path"), F.when(several, F.col("part")).alias("part"), F.when(several, F.col("parts")).alias("part_count"), F.col("n").alias("module_count"), F.concat("head", F.lit("\n"), "body").alias("text"))
