"""Markup and names behind numbered tokens: stateful numbering, so Arrow-batched Python."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .batching import bounded

_MARK = re.compile(r"\[[^\[\]]*\]")
_TAG = re.compile(r"\{[^{}]*\}")
_TOKENS = {kind: re.compile(rf"@@{kind}(\d+)@@") for kind in "pn"}
_BOTH = re.compile(r"@@[pn]\d+@@")
_EAST = re.compile(r"[㐀-䶿一-鿿぀-ヿ가-힯]")

RESULT = "struct<text:string,held:map<int,string>>"
GUARDED = "struct<text:string,p:map<int,string>,n:map<int,string>>"
_FIELD = re.compile(r"\w+:")


class _Numbers:
    """The smallest numbers that no token of the text has."""

    def __init__(self, text: str, kind: str):
        self.kind, self.used, self.held, self.next = kind, {int(n) for n in _TOKENS[kind].findall(text)}, {}, 0

    def __call__(self, m: re.Match) -> str:
        while self.next in self.used:
            self.next += 1
        self.used.add(self.next)
        self.held[self.next] = m.group(0)
        return f"@@{self.kind}{self.next}@@"


def protect(text: str) -> tuple[str, dict[int, str]]:
    """Inserts, then tags, then line ends behind @@pN@@."""
    token = _Numbers(text, "p")
    for pattern in (_MARK, _TAG, re.compile("\n")):
        text = pattern.sub(token, text)
    return text, token.held


def protect_names(text: str, names: list[str]) -> tuple[str, dict[int, str]]:
    """Names behind @@nN@@, the longest first; Latin ones as whole words."""
    token = _Numbers(text, "n")
    for name in sorted(filter(None, names), key=len, reverse=True):
        pattern = re.escape(name)
        if not _EAST.search(name):
            pattern = rf"(?<![\w一-鿿]){pattern}(?![\w一-鿿])"
        text = re.sub(pattern, token, text)
    return text, token.held


def restore(text: str, held: dict[int, str], kind: str = "p") -> str:
    """Tokens back to what they hold; unknown ones stay."""
    return _TOKENS[kind].sub(lambda m: held.get(int(m[1]), m[0]), text)


def preserved(source: str, result: str) -> bool:
    """The same tokens in order, none newly glued to an ASCII letter or digit."""
    a, b = list(_BOTH.finditer(source)), list(_BOTH.finditer(result))
    if [m[0] for m in a] != [m[0] for m in b]:
        return False
    edge = lambda s, i: s[i] if 0 <= i < len(s) and s[i].isascii() and s[i].isalnum() else ""
    return all(not (new := edge(result, y)) or new == edge(source, x) for m, n in zip(a, b) for x, y in ((m.start() - 1, n.start() - 1), (m.end(), n.end())))


def guard(text: str, names: list[str]) -> tuple[str, dict[int, str], dict[int, str]]:
    """protect_names(), then protect(): the text, what its markup tokens hold, and what its name tokens do."""
    named, n = protect_names(text, names)
    shown, p = protect(named)
    return shown, p, n


_MAP = pa.map_(pa.int32(), pa.string())


def _each(run, type_: str, kinds: list[pa.DataType], *columns: Column) -> Column:
    """run over the rows of the columns; null where one is. Several kinds make a struct with the fields that type_ names."""
    bounded()

    def rows(*arrays):
        done = [None if None in r else run(*r) for r in zip(*[a.to_pylist() for a in arrays])]
        if len(kinds) == 1:
            return pa.array(done, kinds[0])
        held = lambda x: list(x.items()) if isinstance(x, dict) else x
        parts = [pa.array([None if d is None else held(d[i]) for d in done], kind) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(parts, [f.split(":")[0] for f in _FIELD.findall(type_)], mask=pa.array([d is None for d in done], pa.bool_()))

    many = {1: lambda a: rows(a), 2: lambda a, b: rows(a, b), 3: lambda a, b, c: rows(a, b, c)}[len(columns)]
    return F.arrow_udf(many, type_)(*columns)


def protected(text: Column) -> Column:
    return _each(protect, RESULT, [pa.string(), _MAP], text)


def names_protected(text: Column, names: list[str]) -> Column:
    return _each(lambda t: protect_names(t, names), RESULT, [pa.string(), _MAP], text)


def restored(text: Column, held: Column, kind: str = "p") -> Column:
    return _each(lambda t, m: restore(t, dict(m), kind), "string", [pa.string()], text, held)


def guarded(text: Column, names: list[str]) -> Column:
    """guard() as struct (text, p, n): one Python worker for both steps."""
    return _each(lambda t: guard(t, names), GUARDED, [pa.string(), _MAP, _MAP], text)


def unguarded(text: Column, p: Column, n: Column) -> Column:
    """Markup, then names, back to what the maps of guarded() hold."""
    return _each(lambda t, a, b: restore(restore(t, dict(a)), dict(b), "n"), "string", [pa.string()], text, p, n)


def keeps_tokens(source: Column, result: Column) -> Column:
    """preserved() of two columns."""
    return _each(preserved, "boolean", [pa.bool_()], source, result)
