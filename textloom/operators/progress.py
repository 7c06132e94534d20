"""State of running and paused work, as operators over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Names of the files that paused work leaves in the folder of translations.
LEFT_BEHIND = (".{}.汉化进度.json", ".{}.暂停标记.txt")


def drained(messages: DataFrame, seq: str, value: str, *, each: int = 250) -> DataFrame:
    """(tick, n, latest): messages drained `each` at a time by their number; of each tick the latest value."""
    return messages.groupBy(F.floor(F.col(seq) / each).alias("tick")).agg(F.count("*").alias("n"), F.max_by(value, seq).alias("latest"))


def smoothed(rows: DataFrame, key: str, order: str, value: str, *, share: float = 0.3, out: str = "ema") -> DataFrame:
    """(key, n, out): exponential moving average at the end of each key, which starts with the first value.

    The recursion is written as a weighted sum, so a key is sorted and spilled by the window, not held as one row;
    rows whose weight is below the least double add nothing.
    """
    w = Window.partitionBy(key)
    rows = rows.select(key, F.col(value).alias("_v"), F.row_number().over(w.orderBy(order)).alias("_k"), F.count("*").over(w).alias("_n"))
    weight = F.pow(F.lit(1.0 - share), (F.col("_n") - F.col("_k")).cast("double")) * F.when(F.col("_k") == 1, 1.0).otherwise(share)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight * F.col("_v")).alias(out))


def recoverable(files: DataFrame, language: str, folder: str = "tl") -> DataFrame:
    """(found): whether a listing (rel) holds the progress or the pause marker of a language."""
    left = F.element_at(F.split("rel", "/"), -1).isin(*[name.format(language) for name in LEFT_BEHIND])
    return files.agg(F.coalesce(F.bool_or(left & F.rlike("rel", F.lit(f"(^|/){folder}/[^/]*$"))), F.lit(False)).alias("found"))


def normal_path(path: Column) -> Column:
    """Slashes one way and single, `.` segments and the last slash gone."""
    p = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/(\\./)+", "/"), "//+", "/")
    return F.regexp_replace(p, "(?<=.)(/\\.)?/?$", "")


def pending_matches(pending: DataFrame, path: Column | str, language: str) -> DataFrame:
    """Pending tasks (path, language) of this place and language."""
    at = F.lit(path) if isinstance(path, str) else path
    return pending.where((normal_path(F.col("path")) == normal_path(at)) & (F.col("language") == language))


def follows(offset: Column, height: Column, *, margin: float = 24.0) -> Column:
    """Whether a view that stands at the offset is at the end of its log."""
    return offset >= F.greatest(F.lit(0.0), height - margin)


def distinct_errors(errors: DataFrame, message: str, seq: str) -> DataFrame:
    """(message, first_seq, n): every message once."""
    return errors.groupBy(message).agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"))


def outcomes(items: DataFrame, text: str = "text", translation: str = "translation", known: str = "known", noise: str = "noise") -> DataFrame:
    """(n_reused, n_noise, n_new, n_failed): where translations come from; known and noise are Boolean columns."""
    done = F.col(translation).isNotNull() & (F.col(translation) != F.col(text))
    k, n = F.coalesce(F.col(known), F.lit(False)), F.coalesce(F.col(noise), F.lit(False))
    done = F.coalesce(done, F.lit(False))
    return items.agg(F.count_if(k).alias("n_reused"), F.count_if(~k & n).alias("n_noise"), F.count_if(~k & ~n & done).alias("n_new"), F.count_if(~k & ~n & ~done).alias("n_failed"))
