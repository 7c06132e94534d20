r"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Features count words, symbols, repeated lines and repeated five-word windows of whole texts. A base rule
fails texts of few words or of many repeated words. Five further rules each fail a text whose ratio
reaches a cutoff of its stratum (lang):

    symbols / words, repeated lines / lines, repeated words / words, and word length from above and below.

Cutoffs come from labelled good texts (the holdout: quality 1, crc32(doc_id as text) mod 5 not 0, base
rule not failed). For each stratum and rule the cutoffs of a fixed grid are tried from the most lenient;
a cutoff is admitted while the exact binomial tail P(Bin(n, a) <= k) of its k false rejections among n is
at most d / (rules * strata), and the strictest admitted one holds. k grows as cutoffs get stricter, so
the grid needs no further correction (fixed sequence), the rules and strata share d (Bonferroni). With
probability 1 - d no stratum loses more than a share `risk` of its good texts to the further rules.

Repeated windows are screened by hash: a text whose window hashes are all distinct has none; of the
others, windows that share half a hash with another one are themselves sorted and compared.

Defined cases: a null or empty text has no words and fails the base rule; a text of fewer than five words
has no window; a null lang counts as the empty one; a stratum with too few labelled texts has no cutoff;
labels that are null or repeated count as one row each, and those of absent documents are ignored; an
empty table gives no rows; repeated rows are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import keep

_SPACE = r"[\x20\x09-\x0D]+"
RISK, CONFIDENCE = 0.02, 0.95
#: Name, numerator, denominator and grid: cutoff number b stands for b / scale, b from 1 to most.
RULES = (
    ("symbols", "n_symbols", "n_words", 20, 100),
    ("dup_lines", "n_dup_lines", "n_lines", 100, 100),
    ("repeats", "n_repeat_words", "n_words", 100, 100),
    ("long_words", "word_chars", "n_words", 10, 400),
    ("short_words", "n_words", "word_chars", 200, 200),
)
#: Terms of a tail that are added singly; the rest is bounded from above.
_TERMS = 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once and never written into a row."""
    return F.transform(F.array(value), body)[0]


def features(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", _SPACE), ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # hashes of words, of pairs of them, of two pairs, of those and a fifth word; what begins in the last four words is cut off
    ahead = lambda a, n: F.slice(a, F.lit(n + 1), F.greatest(F.lit(0), F.size(a) - n))
    fold = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    fives = lambda h: fold(_let(fold(h, ahead(h, 1)), lambda two: fold(two, ahead(two, 2))), ahead(h, 4))
    hashes = F.slice(_let(F.transform("w", lambda x: F.xxhash64(x)), fives), F.lit(1), F.greatest(F.lit(0), F.size("w") - 4))
    rows = rows.select(
        "doc_id", "lang", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        hashes.alias("h"),
    )
    # half a hash and the position in one number, sorted: neighbours of equal halves may be equal windows
    packed = F.transform("h", lambda x, i: F.shiftleft(x, 32).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(packed))).drop("h")
    half = lambda x: F.shiftright(x, 32)
    near = lambda x, j: ((j > 0) & (half(F.get("s", j - 1)) == half(x))) | ((j < F.size("s") - 1) & (half(F.get("s", j + 1)) == half(x)))
    place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    rows = rows.withColumn("p", F.transform(F.filter("s", near), place)).drop("s")
    window = lambda i: F.struct(F.concat_ws(" ", *[F.col("w")[i + k] for k in range(5)]).alias("k"), i.alias("i"))
    twin = lambda s: lambda x, j: ((j > 0) & (F.get(s, j - 1)["k"] == x["k"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["k"] == x["k"]))
    equal = _let(F.sort_array(F.transform("p", window)), lambda s: F.transform(F.filter(s, twin(s)), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct((i + 5).alias("end"), (a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n"))
    covered = F.coalesce(F.aggregate(F.sort_array(equal), start, step, lambda a: a["n"]), F.lit(0)).cast("long")
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"), covered.alias("n_repeat_words"))


def _lgamma(x: Column) -> Column:
    """ln gamma of x >= 1: Stirling's series at x + 8."""
    y = x + 8
    shift = sum((F.ln(x + k) for k in range(1, 8)), F.ln(x))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n * p, else 1. Terms from k down; what is beyond _TERMS is bounded by a geometric series."""
    kd, nd = k.cast("double"), n.cast("double")
    first = F.exp(_lgamma(nd + 1) - _lgamma(kd + 1) - _lgamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log(1 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), F.lit(0.0).alias("ratio"))

    def step(a: Column, i: Column) -> Column:
        ratio = (kd - i + 1) * (1 - p) / ((nd - kd + i) * p)
        term = a["term"] * ratio
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"), ratio.alias("ratio"))

    terms = F.least(k, F.lit(_TERMS)).cast("int")
    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["sum"] + F.when(k > terms, a["term"] * a["ratio"] / (1 - a["ratio"])).otherwise(0.0))
    return F.when(kd < nd * p, F.least(F.lit(1.0), first * total)).otherwise(1.0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _bin(num: str, den: str, scale: int, most: int) -> Column:
    """The strictest cutoff number that the ratio reaches."""
    return F.when(F.col(den) > 0, F.least(F.lit(most), F.floor(F.col(num) * scale / F.col(den)))).otherwise(0).cast("int")


def cutoffs(found: DataFrame, labels: DataFrame, *, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(lang, rule, cut): the strictest admitted cutoff number, where there is one."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    holdout = found.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).where(~base_failed()).join(good, "doc_id")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), _bin(*r[1:]).alias("bin")) for i, r in enumerate(RULES)]))
    counts = holdout.select("lang", each.alias("e")).groupBy("lang", "e.rule", "e.bin").agg(F.count("*").alias("c"))
    most = F.element_at(F.array(*[F.lit(r[4]) for r in RULES]), F.col("rule") + 1)
    grid = counts.groupBy("lang", "rule").agg(F.sum("c").alias("n")).select("lang", "rule", "n", F.explode(F.sequence(F.lit(1), most)).alias("bin"))
    strata = counts.agg(F.count_distinct("lang").alias("strata"))
    down = Window.partitionBy("lang", "rule").orderBy(F.desc("bin"))
    tried = grid.join(counts, ["lang", "rule", "bin"], "left").withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(down))
    tail = binomial_tail(F.col("k"), F.col("n"), risk / len(RULES))
    return tried.withColumn("p", tail).join(F.broadcast(strata)).where(F.col("p") <= F.lit(1 - confidence) / (F.lit(len(RULES)) * F.col("strata"))).groupBy("lang", "rule").agg(F.min("bin").alias("cut"))


def judged(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """features() with base_failed and kept (false if base_failed or a rule's cutoff is reached)."""
    found = keep(features(docs), "features")
    cuts = keep(cutoffs(found, labels, risk=risk, confidence=confidence), "cutoffs")
    wide = cuts.groupBy("lang").agg(*[F.min(F.when(F.col("rule") == i, F.col("cut"))).alias(f"cut_{i}") for i in range(len(RULES))])
    over = [F.coalesce(_bin(*r[1:]) >= F.col(f"cut_{i}"), F.lit(False)) for i, r in enumerate(RULES)]
    verdict = over[0]
    for x in over[1:]:
        verdict = verdict | x
    return found.join(wide, "lang", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | verdict)).drop(*[f"cut_{i}" for i in range(len(RULES))])
