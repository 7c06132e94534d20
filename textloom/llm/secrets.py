"""Secret scans: fixed patterns, and a guess-cost dynamic program over values in a credential context.

Base kinds (leftmost, not overlapping, per kind): `assign`, `access`, `hex`; matches that are too short
are dropped. The method adds spans of kind `guess`: a value that stands after a credential word (login,
passphrase, pin, credentials, auth, bearer, private key ... or a base word in a form that `assign` does
not take) is cut into the cheapest sequence of common words, dates, repeats, keyboard walks and
brute-force spans; the product of their guesses, in log10, is its cost. A value whose cost reaches
`least_cost` cannot be guessed and is reported. Base spans stay whatever their cost. What reads like prose
is not reported: after a space alone (no ':' or '='), letters of one case without digits or five consonants
in a row; anywhere, text without ASCII letters and digits.

Words are the common ones below and, with `words`, those of a public tokenizer's word-level vocabulary file, in
its order, which is that of their frequency.

Defined cases: null and empty texts have no spans (base_sha256 is that of the empty string); spans count
code points, end exclusive; overlapping spans of different kinds are all reported, and redaction merges
them; repeated rows are scanned each for itself; a very long value is priced whole, in time linear in its
length; other columns pass through `redacted` unchanged, save n_chars where it is there.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._worker import in_batches

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret.
LEAST_COST = 12.0
REDACTED = "<secret>"

_FLAGS = re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}", _FLAGS)
_HEX = re.compile(r"[0-9a-f]{16,}", _FLAGS)
_CREDENTIAL = r"(?:pass(?:word|wd|phrase|code)?|pwd|(?<![A-Za-z0-9])pin|login|credentials?|secret|token|auth(?:orization)?|bearer|api[ _-]?key|private[ _-]?key|access[ _-]?key)"
#: A value in a credential context: the word, up to two joining words, a sign or spaces, then the value.
_CONTEXT = re.compile(
    _CREDENTIAL + r"""["']?(?:\x20(?:is|was|for|to)){0,2}(\x20*[:=]\x20*|\x20+)["']?([^\s"'<>,;]{8,})""",
    _FLAGS | re.IGNORECASE,
)
_NAME = re.compile(rf"(?:[A-Za-z0-9]*_)*{_CREDENTIAL}", _FLAGS | re.IGNORECASE)
#: Of a value that is not reported, so many characters at its end may open the next context.
_AGAIN = 64
#: Forms of dates; each can begin at a place, and all do that match there.
_DATES = tuple(
    re.compile(x, _FLAGS)
    for x in (
        r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
)
#: Letters that do not follow each other in prose.
_UNSPOKEN = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}", _FLAGS | re.IGNORECASE)
_PLAIN = re.compile(r"[A-Za-z0-9]")
_WORDS = {
    w: rank
    for rank, w in enumerate(
        "password the and you for with that this have from pass admin login welcome secret token test user root guest master hello love dragon monkey shadow sunshine princess football baseball letmein iloveyou trustno superman batman access default changeme qwerty abc key api data system service server client public private example sample demo info mail web site home work my your name number code phrase word is was are not one two all can out day time new old good bad man king star blue red green black white summer winter spring autumn january february march april may june july august september october november december monday friday sunday money power magic flower freedom whatever michael jordan hunter ranger soccer hockey killer george charlie andrew thomas robert daniel jessica jennifer michelle ashley nicole amanda matrix computer internet network database config dev prod stage local host cloud bearer basic auth session cookie".split(),
        1,
    )
}
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {pair for row in _ROWS for x in (row, row[::-1]) for pair in zip(x, x[1:])} | {(a, b) for r, s in zip(_ROWS, _ROWS[1:]) for a, b in [*zip(r, s), *zip(s, r)]}
_LEET = str.maketrans("@4301$5!7", "aaeoissit")
#: Repeats and walks begin in the first _SPAN places of their run, or end so many later at most. Nothing else can be
#: cheapest: a span that begins deeper, after another of the same run, costs less as one with it, and no word or date is longer.
_SPAN = 32
#: Least and most letters of a word of a vocabulary file.
_WORD_LETTERS = (4, 24)

_known: dict[str | None, tuple[dict[str, int], int]] = {}


def dictionary(words: str | None = None) -> tuple[dict[str, int], int]:
    """Ranks of words, and the letters of the longest. words: a word-level vocabulary file of the `tokenizers` library."""
    if words not in _known:
        ranks = dict(_WORDS)
        if words:
            least, most = _WORD_LETTERS
            vocab = json.load(open(words))["model"]["vocab"]
            for token, _ in sorted(vocab.items(), key=lambda x: x[1]):
                word = token.removesuffix("</w>")
                if word != token and least <= len(word) <= most and word.isascii() and word.isalpha():
                    ranks.setdefault(word, len(ranks) + 1)
        _known[words] = ranks, max(map(len, ranks))
    return _known[words]


def _kind(c: str) -> int:
    return 8 if not c.isalnum() or not c.isascii() else 1 if c.isdigit() else 2 if c.islower() else 4


#: Guesses of a character by the kinds that a brute-force span mixes: digits, lower case, upper case, others.
_ALPHABET = [sum(n for k, n in enumerate((10, 26, 26, 33)) if mask >> k & 1) for mask in range(16)]


def guess_cost(value: str, words: str | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation of value.

    Two brute-force spans never meet: what lies between two patterns is one span, priced by the alphabet it mixes.
    """
    n = len(value)
    ranks, longest = dictionary(words)
    low = value.lower()
    if len(low) != n:  # a few letters grow in lower case
        low = value
    plain = low.translate(_LEET)
    kinds = [_kind(c) for c in value]
    masks = [m for m in range(1, 16) if not m & ~sum(set(kinds))]
    price = {m: math.log10(_ALPHABET[m]) for m in masks}
    brute = dict.fromkeys(masks, math.inf)  # cheapest that ends here in a span over the alphabet
    pattern = [0.0] + [math.inf] * n  # cheapest that ends in a pattern, or at the start
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if kinds[i] == 1:
            for form in _DATES:
                if m := form.match(low, i):
                    dates.setdefault(m.end(), []).append(i)
    walk = repeat = 1
    for end in range(1, n + 1):
        kind = kinds[end - 1]
        brute = {m: min(pattern[end - 1], brute[m]) + price[m] if m & kind else math.inf for m in masks}
        cost = math.inf
        for k in range(2, min(end, longest) + 1):
            word = plain[end - k : end]
            if rank := ranks.get(word):
                raw = value[end - k : end]
                extra = (0 if raw == raw.lower() else math.log10(2 if raw[1:] == raw[1:].lower() else 2 * k)) + (0 if low[end - k : end] == word else math.log10(4))
                cost = min(cost, best[end - k] + math.log10(rank + 1) + extra)
        for i in dates.get(end, ()):
            cost = min(cost, best[i] + math.log10(365 * 60 if end - i > 4 else 120))
        if end > 1:
            repeat = repeat + 1 if value[end - 1] == value[end - 2] else 1
            walk = walk + 1 if (low[end - 2], low[end - 1]) in _NEXT else 1
        for k in _lengths(repeat):
            cost = min(cost, best[end - k] + math.log10(_ALPHABET[kind] * k))
        for k in _lengths(walk):
            cost = min(cost, best[end - k] + math.log10(94 * 4 * k))
        pattern[end] = cost
        best[end] = min(cost, *brute.values())
    return best[n]


def _lengths(run: int) -> range | list[int]:
    """Lengths of the spans that end at the place where a run is so long."""
    return range(3, run + 1) if run <= 2 * _SPAN else [*range(3, _SPAN + 1), *range(run - _SPAN + 1, run + 1)]


def _prose(value: str, assigned: bool) -> bool:
    if not _PLAIN.search(value):
        return True
    if assigned or any(c.isdigit() for c in value) or _UNSPOKEN.search(value):
        return False
    return value[1:].islower() or value.isupper() or not any(c.isupper() for c in value[1:])


def _guessed(text: str, least_cost: float, words: str | None) -> Iterator[tuple[int, int]]:
    """Values in a credential context that cost least_cost at least."""
    at = 0
    while m := _CONTEXT.search(text, at):
        a, b = m.span(2)
        at = max(a, b - _AGAIN)
        assigned = ":" in m[1] or "=" in m[1]
        before = text[m.start() - 1 : m.start()]
        if not assigned and before.isascii() and before.isalnum():
            continue  # the end of another word
        while b > a and text[b - 1] in ".,:;!?)]}":
            b -= 1
        value = text[a:b]
        if b - a >= 8 and not _prose(value, assigned) and not _NAME.fullmatch(value) and guess_cost(value, words) >= least_cost:
            yield a, b
            at = m.end(2)


def spans(text: str, least_cost: float = LEAST_COST, words: str | None = None) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out += [(a, 3, b) for a, b in _guessed(text, least_cost, words)]
    return sorted(out)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scanned(docs: DataFrame, *, least_cost: float = LEAST_COST, words: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, counts of base kinds, base_sha256, spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            counts, shas, all_spans = ([], [], []), [], []
            for text in batch.column("text"):
                found = spans(text.as_py() or "", least_cost, words)
                base = [x for x in found if x[1] < 3]
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                all_spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(all_spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return in_batches(rows, run, DIGEST)


def redact(text: str, least_cost: float = LEAST_COST, mark: str = REDACTED, words: str | None = None) -> str:
    """text with every run of overlapping spans replaced by mark."""
    out, at, until = [], 0, -1
    for a, _, b in spans(text, least_cost, words):
        if a >= until:
            if until >= 0:
                at = until
            out += [text[at:a], mark]
            until = b
        until = max(until, b)
    return text if until < 0 else "".join([*out, text[until:]])


def redacted(docs: DataFrame, *, least_cost: float = LEAST_COST, mark: str = REDACTED, words: str | None = None) -> DataFrame:
    """docs with secrets replaced in text; n_chars, where docs has it, counts the new text of changed rows."""
    schema = docs.schema
    text_at = schema.names.index("text")
    chars_at = schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            new = [redact(t, least_cost, mark, words) if t else t for t in texts]
            columns = list(batch.columns)
            columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(b) if a != b else c for a, b, c in zip(texts, new, columns[chars_at].to_pylist())], batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return in_batches(docs, run, schema)
