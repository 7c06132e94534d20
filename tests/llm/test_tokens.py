import json
import random

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import tokens
from textloom.llm._text import text_buffers
from textloom.llm.op3 import tokenizer_path

#: Letters with and without case, marks that compose, contractions, digits, kinds of white space, control characters.
POOL = "aAbHhZ'’stTrReE mM lL dD 09 ½²Ⅷ .,!?-=<>\t\n\r\x0b\x0c\x01\x00\x7f\x85\xa0 　éÉßÿ×÷ΣσςİıḴ̸́⃣漢字한글がが…»😀‍<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("remembered", [tokens.REMEMBERED, 50])
def test_chunks_against_the_library(library, monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    rng = random.Random(7)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    table = tokens.Chunks(tokenizer_path())
    got = []
    for k in range(0, len(texts), 500):  # rows of one slice follow each other without a gap
        ids, at = table.encode(*text_buffers(pa.array(texts[k : k + 500])))
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(tokenizer_path()))
    spec["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tokens.Chunks(str(path))


def test_no_rows():
    ids, at = tokens.Chunks(tokenizer_path()).encode(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert len(ids) == 0 and at.tolist() == [0]
