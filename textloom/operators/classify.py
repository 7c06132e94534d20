"""Classification cascades and counts over translations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .relate import append_queue


def audit_category(original: Column, translation: Column, is_string: Column, language: str = "schinese") -> Column:
    """untranslated, wrong_lang, mixed, traditional, or null where nothing is wrong."""
    lang = language.replace("（", "(").split("(")[0].strip().lower()
    expected = T.EXPECTED.get(lang, "cjk")
    source, result = T.strip_markup(original), T.strip_markup(translation)
    shown = T.has(result, T.SCRIPTS[expected] if expected else T.WORD)
    foreign = F.lit(False)
    for name, pattern in T.SCRIPTS.items():
        if name != expected and not (name == "cjk" and (lang.startswith("zh") or lang in ("schinese", "tchinese"))):
            foreign = foreign | T.has(result, pattern)
    same = T.trimmed(source) == T.trimmed(result)
    out = F.when((T.trimmed(original) == "") | (T.trimmed(translation) == ""), None)
    if expected:
        out = out.when(T.has(source, T.SCRIPTS[expected]), None)
    out = out.when(same, F.when(F.when(is_string, T.has(source, T.WORD)).otherwise(T.has(source, T.RUN2)), "untranslated"))
    out = out.when(~shown, F.when(foreign | T.has(result, T.RUN2), "wrong_lang"))
    out = out.when(T.has(result, T.RUN3), "mixed")
    if lang in T.SIMPLIFIED_TARGETS:
        out = out.when(T.has_traditional(result), "traditional")
    return out


def audited(entries: DataFrame, language: str = "schinese") -> DataFrame:
    return entries.withColumn("category", audit_category(F.col("original"), F.col("translation"), F.col("is_string"), language))


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def unchanged_or_kept(entries: DataFrame) -> DataFrame:
    """Rows whose translation is their source: `unchanged` if there is something to translate in them, else `kept`."""
    plain = T.strip_markup(F.col("original"))
    word = F.when(F.col("is_string"), T.has(plain, T.WORD)).otherwise(T.has(plain, T.RUN2))
    return entries.where(F.col("original") == F.col("translation")).withColumn("state", F.when(word, "unchanged").otherwise("kept"))


def silent_alarm(entries: DataFrame, *by: str) -> DataFrame:
    """Groups with at least three untranslated rows that are 40 % of all or more."""
    hit = T.looks_untranslated(F.col("original"), F.col("translation"))
    return entries.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hit")).where("n_hit >= 3 and n_hit * 100 >= n * 40")


def state_totals(df: DataFrame, state: str, states: tuple[str, ...]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(state) == s).alias(f"n_{s}") for s in states])


def mode_vote(df: DataFrame, by: str, choice: str, seq: str) -> DataFrame:
    """The most frequent choice of each group; of equal ones that which came first."""
    votes = df.groupBy(by, choice).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return votes.groupBy(by).agg(F.max_by(F.struct(choice, "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("w")).select(by, f"w.{choice}", "w.n")


def validated(entries: DataFrame) -> DataFrame:
    """entries with `accepted`: tokens kept in order, no residue, no leak, no meta reply."""
    src, out = F.col("original"), F.col("translation")
    return entries.withColumn("accepted", (T.tokens(src) == T.tokens(out)) & ~T.has_residue(out, True) & ~T.has(out, T.LEAK) & ~T.meta_reply(src, out))


def audit_run(entries: DataFrame, queue: DataFrame, order: Sequence[str], language: str = "schinese") -> dict[str, DataFrame]:
    """A whole audit of (original, translation, is_string, *order).

    items: entries that are wrong, with their category; counts: by category; repaired: traditional items with the
    simplified translation, no request needed; queued: texts to append to the queue (text) for another request.
    """
    items = audited(entries, language).where("category is not null")
    repaired = items.where("category = 'traditional'").withColumn("translation", T.to_simplified(F.col("translation")))
    found = items.select(F.col("original").alias("text"), "category", *order)
    return {"items": items, "counts": counts(items, "category"), "repaired": repaired, "queued": append_queue(queue, found, "text", order)}
