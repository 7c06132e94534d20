"""guess_cost against every segmentation of short values, with the price of each kind of span written out anew."""

import datetime
import math
import random
import re
from functools import cache

import pytest

from textloom.llm import secrets
from textloom.llm.op4 import words_path

KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = {"@": "a", "4": "a", "3": "e", "0": "o", "1": "i", "$": "s", "5": "s", "!": "i", "7": "t"}
LEAST_RUN = 3


def is_date(x):
    if re.fullmatch(r"(19|20)[0-9]{2}", x):
        return 120
    for form, parts in ((r"([0-9]{4})[-/._]?([0-9]{2})[-/._]?([0-9]{2})", (1, 2, 3)), (r"([0-9]{2})[-/._]?([0-9]{2})[-/._]?([0-9]{4})", (3, 2, 1))):
        if m := re.fullmatch(form, x, re.A):
            y, mo, d = (int(m[k]) for k in parts)
            if 1900 <= y < 2100 and 1 <= mo <= 12 and 1 <= d <= 31:
                return 365 * 60
    return None


def near(a, b):
    a, b = a.lower(), b.lower()
    for y, row in enumerate(KEYS):
        for x, key in enumerate(row):
            if key == a:
                beside = [row[k] for k in (x - 1, x + 1) if 0 <= k < len(row)]
                above = [KEYS[k][x] for k in (y - 1, y + 1) if 0 <= k < len(KEYS) and x < len(KEYS[k])]
                return b in beside + above
    return False


def brute(x):
    size = 0
    for pattern, n in (("[0-9]", 10), ("[a-z]", 26), ("[A-Z]", 26), ("[^0-9a-zA-Z]", 33)):
        size += n * bool(re.search(pattern, x))
    return len(x) * math.log10(size)


def patterned(x, ranks):
    """Prices of x as one span of a pattern."""
    low, out, n = x.lower(), [], len(x)
    plain = "".join(LEET.get(c, c) for c in low)
    if n > 1 and plain in ranks:
        case = 1 if x == low else 2 if x[1:] == low[1:] else 2 * n
        out.append(math.log10(ranks[plain] + 1) + math.log10(case) + (math.log10(4) if plain != low else 0))
    if (guesses := is_date(low)) is not None:
        out.append(math.log10(guesses))
    if n >= LEAST_RUN and len(set(x)) == 1:
        out.append(math.log10(10 ** (brute(x) / n) * n))
    if n >= LEAST_RUN and all(near(a, b) for a, b in zip(x, x[1:])):
        out.append(math.log10(94 * 4 * n))
    return out


def least(value, ranks):
    @cache
    def best(at, after_brute):
        if at == len(value):
            return 0.0
        found = []
        for end in range(at + 1, len(value) + 1):
            part = value[at:end]
            found += [p + best(end, False) for p in patterned(part, ranks)]
            if not after_brute:
                found.append(brute(part) + best(end, True))
        return min(found, default=math.inf)

    return best(0, False)


@pytest.mark.parametrize("words", [None, "file"])
def test_least_over_all_segmentations(words):
    words = words and words_path()
    ranks, _ = secrets.dictionary(words)
    rng = random.Random(3)
    some = rng.sample(sorted(ranks), 40)
    parts = [*some, *(w.capitalize() for w in some[:9]), "p4ssw0rd", "2001", "20011111111", "1999-12-31", "31.12.2001", "aaaa", "1111", "!!!", "qwerty", "zxcv", "1qaz", "Zk8", "w", "Q", "7", "_", "é", "ß漢"]
    for _ in range(250):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))[:26]
        assert abs(secrets.guess_cost(value, words) - least(value, ranks)) < 1e-6, value
    for _ in range(150):
        value = "".join(rng.choice("a1sQ_20é") for _ in range(rng.randint(1, 14)))
        assert abs(secrets.guess_cost(value, words) - least(value, ranks)) < 1e-6, value


def test_dates_of_every_length_begin_at_a_place():
    assert abs(secrets.guess_cost("20011111111") - (math.log10(120) + math.log10(70))) < 1e-9


@pytest.mark.parametrize("value", ["a" * 200, "pass" + "s" * 150, "qw" * 60, "x7" + "1" * 90 + "19991231"])
def test_long_runs_are_one_span(value):
    ranks, _ = secrets.dictionary()
    assert abs(secrets.guess_cost(value) - least(value, ranks)) < 1e-6


def test_long_values_take_linear_time():
    began = datetime.datetime.now()
    for value in ("a" * 30_000, "qw" * 15_000, "aB3$" * 7_500):
        secrets.guess_cost(value, words_path())
    assert (datetime.datetime.now() - began).total_seconds() < 60


def test_gates():
    def guessed(text, words=None):
        return [text[a:b] for a, k, b in secrets.spans(text, words=words) if k == 3]

    assert guessed("my passphrase is kxvqzjwphtrbnmfdlg") == ["kxvqzjwphtrbnmfdlg"]
    assert guessed("password: Zk8wQ2mé5xT1") == ["Zk8wQ2mé5xT1"]
    assert guessed("token: 这是一个很长的句子没有空格") == guessed("the password international-communication") == []
    assert guessed("passphrase: internationalcommunication", words_path()) == []
