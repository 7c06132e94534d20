"""Answers of chat services: wrappers, arrays, error hints, endpoints and model names."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

from .batching import bounded

_PAIRS = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』"}
_KEYS = ("translation", "translated", "text", "result", "output", "content", "answer")
_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S)


def unwrap(text: str) -> str:
    """One answer out of a code fence, a JSON list or object of one string, or one pair of quotes."""
    s = text.strip()
    if m := _FENCE.fullmatch(s):
        s = m[1]
    try:
        value = json.loads(s)
    except ValueError:
        value = None
    if isinstance(value, str):
        return value
    if isinstance(value, list) and len(value) == 1 and isinstance(value[0], str):
        return value[0]
    if isinstance(value, dict):
        named = [value[k] for k in _KEYS if isinstance(value.get(k), str)]
        some = named or [v for v in value.values() if isinstance(v, str)]
        return some[0] if named or len(some) == 1 else s
    return s[1:-1] if len(s) >= 2 and _PAIRS.get(s[0]) == s[-1] else s


def arrays(text: str) -> list[list[str]]:
    """Every JSON array of strings in the text, in order."""
    out, at, decoder = [], -1, json.JSONDecoder()
    while (at := text.find("[", at + 1)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(value, list) and all(isinstance(x, str) for x in value):
            out.append(value)
            at = end - 1
    return out


def array_of(text: str, expected: int) -> list[str] | None:
    """The last array of the expected length, else the first; None without one."""
    found = arrays(text)
    fit = [a for a in found if len(a) == expected]
    return fit[-1] if fit else found[0] if found else None


def name_list(text: str) -> list[str]:
    """A flat or nested list of names, each once, trimmed."""
    try:
        value = json.loads(_FENCE.sub(r"\1", text.strip()))
    except ValueError:
        return []
    flat: list[str] = []

    def walk(x):
        if isinstance(x, str) and x.strip():
            flat.append(x.strip())
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            walk(y)

    walk(value)
    return list(dict.fromkeys(flat))


def unwrapped(text: Column) -> Column:
    bounded()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(unwrap)

    return run(text)


def names_listed(text: Column) -> Column:
    """name_list() of a column."""
    bounded()

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([name_list(t) for t in texts], dtype=object)

    return run(text)


def parsed_array(text: Column, expected: Column) -> Column:
    bounded()

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([array_of(t, int(n)) for t, n in zip(texts, sizes)], dtype=object)

    return run(text, expected)


def error_hint(message: Column) -> Column:
    """First cause that the message names."""
    low = F.lower(message)
    has = lambda *words: F.rlike(low, F.lit("|".join(words)))
    return F.when(has("401", "unauthorized", "invalid api key"), "credentials").when(has("429", "rate limit", "quota"), "rate").when(has("404", "not found"), "model").when(has("timed? ?out", "timeout"), "timeout").when(has("refused", "unreachable", "resolve"), "connection").otherwise("other")


def endpoint_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def is_local(url: Column) -> Column:
    host = endpoint_host(url)
    return host.isin("localhost", "[::1]", "0.0.0.0") | F.startswith(host, F.lit("127."))


def third_generation(model: Column) -> Column:
    """Names of the model family whose prompts are short."""
    return F.rlike(model, F.lit(r"(?i)qwen[\s_-]*3"))


def model_variants(name: Column) -> Column:
    """A model and its `:latest` form stand for each other."""
    name = F.lower(F.trim(name))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array(name, F.when(F.endswith(name, F.lit(":latest")), F.regexp_replace(name, ":latest$", "")).otherwise(F.concat(name, F.lit(":latest")))))


def same_model(a: Column, b: Column) -> Column:
    """Whether two names, whatever their case, mean one model."""
    return F.coalesce(F.arrays_overlap(model_variants(a), model_variants(b)), F.lit(False))


def font_path(text: Column) -> Column:
    """The first font file that a style names, quoted or bare."""
    ext = r"\.(?:ttf|otf|ttc)"
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (rf"""(?i)font\s*=?\s*["']([^"']+{ext})["']""", rf"""(?i)["']([^"']+{ext})["']""", rf"(?i)(\S+{ext})\b")])


def duration(seconds: Column) -> Column:
    """h:mm:ss or m:ss."""
    s = seconds.cast("int")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h.cast("int"), m.cast("int"), s % 60)).otherwise(F.format_string("%d:%02d", m.cast("int"), s % 60))
