"""Catalog of a source tree: root, scripts, languages and version, from a listing (path, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import is_chinese
from ..operators.keys import keep_first

# Names of folders that hold no sources, whatever their case.
PRUNED = ("tl", "renpy", "cache", "saves", "log", "errors", "__pycache__", ".git", "lib")
SCRIPT = r"(?i)\.rpym?c?$"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file below path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def relative(files: DataFrame, root: str) -> DataFrame:
    return files.withColumn("rel", F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", ""))


def scripts(files: DataFrame, *, pruned: tuple[str, ...] = PRUNED, generated: str = "zz_") -> DataFrame:
    """Script files with kind and stem, without pruned folders and generated names, ordered whatever the case."""
    parts = F.split("rel", "/")
    folders = F.transform(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), lambda x: F.lower(x))
    name = F.element_at(parts, -1)
    rows = files.where(F.rlike("rel", F.lit(SCRIPT)) & ~F.arrays_overlap(folders, F.array(*[F.lit(p) for p in pruned])) & ~F.startswith(F.lower(name), F.lit(generated)))
    return rows.select("*", F.when(F.rlike("rel", F.lit("(?i)c$")), "compiled").otherwise("source").alias("kind"), F.regexp_replace("rel", SCRIPT, "").alias("stem")).orderBy(F.lower("rel"))


def languages(files: DataFrame, folder: str = "tl") -> DataFrame:
    """Languages that have a folder of translations, `none` aside."""
    name = F.regexp_extract("rel", rf"(?:^|/){folder}/([^/]+)/", 1)
    return files.select(name.alias("language")).where("language <> '' and lower(language) <> 'none'").distinct().orderBy(F.lower("language"))


def root_of(files: DataFrame) -> DataFrame:
    """The folder that holds the data: one named `game`, nearest the top, else the highest folder with a script."""
    folder = F.when(F.contains(F.concat(F.lit("/"), "rel"), F.lit("/game/")), F.regexp_extract(F.concat(F.lit("/"), F.col("rel")), "^(.*?/game)/", 1))
    rows = files.select(folder.alias("a"), F.when(F.rlike("rel", F.lit(SCRIPT)), F.regexp_replace(F.concat(F.lit("/"), "rel"), "/[^/]*$", "")).alias("b"))
    rows = rows.select(F.coalesce("a", "b").alias("root"), F.col("a").isNull().alias("second")).where("root is not null")
    return rows.agg(F.min(F.struct("second", F.length("root").alias("n"), "root")).alias("m")).select("m.root").where("root is not null")


def scan(files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One record of a tree: n_sources, n_compiled, languages, has_chinese, n_archives, from_archives, version, note.

    files: (rel) of a listing; texts: (text) of files that may state the version. Scripts are read from archives where
    no loose one is left that is not generated. The note is null, or says what is missing.
    """
    found = scripts(files).agg(F.count_if(F.col("kind") == "source").alias("n_sources"), F.count_if(F.col("kind") == "compiled").alias("n_compiled"))
    named = languages(files).agg(F.sort_array(F.collect_set("language")).alias("languages"), F.coalesce(F.bool_or(is_chinese(F.col("language"))), F.lit(False)).alias("has_chinese"))
    packed = files.agg(F.count_if(F.rlike("rel", F.lit(r"(?i)\.rpa$"))).alias("n_archives"))
    row = found.join(F.broadcast(named)).join(F.broadcast(packed))  # one row each
    stated = version(F.col("text"))
    row = row.join(F.broadcast(texts.agg(F.coalesce(F.min(F.when(stated != "unknown", stated)), F.lit("unknown")).alias("version")))) if texts is not None else row.withColumn("version", F.lit("unknown"))
    loose = F.col("n_sources") + F.col("n_compiled") > 0
    return row.withColumn("from_archives", ~loose & (F.col("n_archives") > 0)).withColumn("note", F.when(~loose & (F.col("n_archives") == 0), "no scripts"))


def version(text: Column) -> Column:
    """The first version that a text states, by the patterns in turn; `unknown` without one."""
    patterns = (r"""version_only\s*=\s*["']([^"']+)""", r"""(?i)version\s*[=:]\s*["']?(\d+(?:\.\d+)+)""", r"(?i)\bv(\d+(?:\.\d+)+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], F.lit("unknown"))


def lookup(entries: DataFrame, name: str) -> DataFrame:
    """The entry of a name or of its compiled twin, whatever the case: of the first archive that has one, the last."""
    low = name.lower()
    twin = low[:-1] if low.endswith("c") else low + "c"
    return keep_first(entries.where(F.lower("name").isin(low, twin)).withColumn("k", F.lit(1)), ["k"], ["archive_rank", F.desc("pos")]).drop("k")
