"""Relational core: precedence, coverage, staleness, cache migration, fallback and assembly.

Sides that a key lookup would broadcast are left to the planner, which broadcasts by measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .keys import keep_first, last_wins


def source_precedence(compiled: DataFrame, sources: DataFrame, stem: str) -> DataFrame:
    """Every compiled file, and the sources without a compiled twin."""
    lower = lambda df: df.withColumn("_stem", F.lower(F.col(stem)))
    rest = lower(sources).join(lower(compiled).select("_stem").distinct(), "_stem", "left_anti")
    return compiled.withColumn("kind", F.lit("compiled")).unionByName(rest.drop("_stem").withColumn("kind", F.lit("source")))


def overlay(df: DataFrame, name: str, rank: Sequence[str]) -> DataFrame:
    """The last of several entries of one name, whatever its case."""
    return keep_first(df.withColumn("_name", F.lower(F.col(name))), ["_name"], [F.desc(c) for c in rank]).drop("_name")


def context_split(strings: DataFrame, context: str = "character") -> tuple[DataFrame, DataFrame]:
    """Strings to translate, and names to protect."""
    return strings.where(F.col("context") != context), strings.where(F.col("context") == context)


def protect_terms(names: DataFrame, text: str, order: Sequence[str], *, least: int = 2) -> DataFrame:
    """Trimmed names of `least` characters or more, each once, where it came first."""
    term = names.withColumn("term", F.trim(F.col(text))).where(F.length("term") >= least)
    return keep_first(term, ["term"], order).select("term", *order)


def retry_only(units: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    return units.join(wanted.select(text).distinct(), text, "left_semi")


def coverage(units: DataFrame, existing: DataFrame, key: str = "identifier", *, strict: bool = False) -> DataFrame:
    """units with `covered`: the key exists, or its last or last but one segment is a digest of an existing key.

    Every last segment of an existing key counts as a digest, a suffix number too, unless strict, when it
    must be eight hex digits.
    """
    last = F.element_at(F.split(F.col(key), "_"), -1)
    digests = existing.select(last.alias("_d"))
    if strict:
        digests = digests.where(F.rlike("_d", F.lit("^[0-9a-f]{8}$")))
    digests = digests.distinct()
    parts = F.split(F.col(key), "_")
    rows = units.withColumn("_last", F.element_at(parts, -1)).withColumn("_prev", F.when(F.size(parts) > 1, F.element_at(parts, -2)))
    exact = existing.select(key).distinct().withColumn("_exact", F.lit(True))
    return (
        rows.join(exact, key, "left")
        .join(digests.select(F.col("_d").alias("_last"), F.lit(True).alias("_by_last")), "_last", "left")
        .join(digests.select(F.col("_d").alias("_prev"), F.lit(True).alias("_by_prev")), "_prev", "left")
        .withColumn("covered", F.coalesce("_exact", "_by_last", "_by_prev", F.lit(False)))
        .drop("_last", "_prev", "_exact", "_by_last", "_by_prev")
    )


def stale(extracted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Extracted keys that do not exist yet."""
    return extracted.select(key).distinct().join(existing.select(key).distinct(), key, "left_anti")


def ordered_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first, then the rows of second whose key first lacks."""
    return first.withColumn("part", F.lit(0)).unionByName(second.join(first.select(key).distinct(), key, "left_anti").withColumn("part", F.lit(1)))


def migrate_cache(cache: DataFrame, texts: DataFrame, text: str, *, same_print) -> DataFrame:
    """All of the cache if the fingerprints are equal (a Boolean or a one-row frame `same`), else the entries whose text is still there."""
    if isinstance(same_print, bool):
        return cache if same_print else cache.join(texts.select(text).distinct(), text, "left_semi")
    live = texts.select(text).distinct().withColumn("_live", F.lit(True))
    return cache.join(live, text, "left").join(F.broadcast(same_print.select("same"))).where("same or _live").drop("_live", "same")


def need_work(units: DataFrame, cache: DataFrame, text: str, translation: str = "translation") -> DataFrame:
    """Units that are not cached, or cached as they are."""
    known = cache.select(text, F.col(translation).alias("_t"))
    return units.join(known, text, "left").where(F.col("_t").isNull() | (F.col("_t") == F.col(text))).drop("_t")


def digest_fallback(existing: DataFrame, key: str = "identifier", value: str = "translation", seq: str = "seq") -> DataFrame:
    """(digest, translation): of existing keys that end in eight hex digits, the one that first appeared first, with its last value."""
    latest = last_wins(existing, key, value, seq).withColumn("digest", F.element_at(F.split(F.col(key), "_"), -1)).where(F.rlike("digest", F.lit("^[0-9a-f]{8}$")))
    return latest.groupBy("digest").agg(F.min_by(value, "first_seq").alias(value))


def assemble(units: DataFrame, new: DataFrame, existing: DataFrame, fallback: DataFrame, key: str = "identifier", value: str = "translation") -> DataFrame:
    """(key, value, origin): new before existing before the fallback by digest."""
    named = lambda df, k, v: df.select(k, F.col(value).alias(v))
    rows = units.select(key).distinct().withColumn("digest", F.element_at(F.split(F.col(key), "_"), -1))
    rows = rows.join(named(new, key, "_new"), key, "left").join(named(existing, key, "_old"), key, "left").join(named(fallback, "digest", "_fall"), "digest", "left")
    origin = F.when(F.col("_new").isNotNull(), "new").when(F.col("_old").isNotNull(), "existing").when(F.col("_fall").isNotNull(), "fallback")
    return rows.select(key, F.coalesce("_new", "_old", "_fall").alias(value), origin.alias("origin"))


def fan_out(members: DataFrame, results: DataFrame, text: str) -> DataFrame:
    """Every member with the result of its text."""
    return members.join(results, text)


def append_queue(queue: DataFrame, found: DataFrame, text: str, order: Sequence[str], *, skip_category: str = "traditional") -> DataFrame:
    """Rows to append: trimmed texts, not blank, not queued yet, each once; locally repaired categories are left out."""
    rows = found.where(F.col("category") != skip_category) if "category" in found.columns else found
    rows = rows.withColumn(text, F.trim(F.col(text))).where(F.col(text) != "")
    return keep_first(rows.join(queue.select(F.trim(F.col(text)).alias(text)).distinct(), text, "left_anti"), [text], order)


def reuse(missing: DataFrame, known: DataFrame, text: str, translation: str = "translation") -> DataFrame:
    """missing with the translation of its trimmed text where that differs from it, leading white space put back."""
    lead, rest = F.regexp_extract(F.col(text), r"(?s)^(\s*)(.*)$", 1), F.trim(F.regexp_extract(F.col(text), r"(?s)^(\s*)(.*)$", 2))
    known = known.select(F.col(text).alias("_key"), F.col(translation).alias("_t"))
    joined = missing.withColumn("_key", rest).withColumn("_lead", lead).join(known, "_key", "left")
    return joined.withColumn(translation, F.when(F.col("_t") != F.col("_key"), F.concat("_lead", "_t"))).drop("_key", "_lead", "_t")


def merge_prior(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Prior rows win over new ones of their key."""
    return prior.unionByName(new.join(prior.select(key).distinct(), key, "left_anti"))


def without_language(rows: DataFrame, translated: DataFrame, key: str, language: str) -> DataFrame:
    """Default rows that have no row in the language."""
    return rows.join(translated.where(F.col("language") == language).select(key).distinct(), key, "left_anti")


def substituted(units: DataFrame, by_key: DataFrame, by_text: DataFrame, key: str, text: str, value: str = "translation") -> DataFrame:
    """units with `value`: the one of their key, else that of their text, else the text. Both maps hold a key once."""
    a, b = by_key.select(key, F.col(value).alias("_a")), by_text.select(text, F.col(value).alias("_b"))
    return units.join(a, key, "left").join(b, text, "left").withColumn(value, F.coalesce("_a", "_b", F.col(text))).drop("_a", "_b")


def matches(lines: DataFrame, text: str, pattern: str, out: str, *keep: str) -> DataFrame:
    """(*keep, out): the first group of every match of the pattern."""
    return lines.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias(out))


def reachable(made: DataFrame, used: DataFrame, name: str, place: str) -> DataFrame:
    """(name, place): names in use, with the first place that defines them."""
    return retry_only(made, used, name).groupBy(name).agg(F.min(place).alias(place))


def drifted(units: DataFrame, existing: DataFrame, key: str = "identifier", value: str = "translation", seq: str = "seq") -> DataFrame:
    """(key, value): keys that changed while their text did not, with the translation that their digest finds; nothing is asked for."""
    new = units.select(key).distinct().join(existing.select(key).distinct(), key, "left_anti")
    known = digest_fallback(existing, key, value, seq)
    return new.withColumn("digest", F.element_at(F.split(F.col(key), "_"), -1)).join(known, "digest").select(key, value)
