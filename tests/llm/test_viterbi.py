import random

import pytest

from textloom.llm.op5 import model_path
from textloom.llm.viterbi import MARK, Counter, token_counts, vocabulary

from .util import EDGES, docs, prose


@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer, models

    normal, _ = vocabulary(model_path())
    return Tokenizer(models.Unigram([("<unk>", 0.0), *normal, *((f"<0x{b:02X}>", 0.0) for b in range(256))], unk_id=0, byte_fallback=True))


def test_against_the_tokenizer(spark, unigram):
    texts = EDGES + [prose(k, 40) for k in range(20)] + ["a  b   c", "  lead", "trail  ", "x\n\n y", "tab\tq", "zzz zzzz zzzzz", "日本語 テキスト"]
    rows = {r.doc_id: r for r in token_counts(docs(spark, texts), model_path()).collect()}
    for i, t in enumerate(texts):
        want = len(unigram.encode(MARK + t.replace(" ", MARK)).ids) if t else 0
        assert (rows[i].n_tokens, rows[i].n_bytes) == (want, len((t or "").encode())), t


def test_ties_go_to_the_earlier_start():
    from tokenizers import Tokenizer, models

    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), (MARK, -1.0)]
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0))
    count = Counter(pieces, False)
    r = random.Random(9)
    chunks = ["ab", "aba", "abab", "baab", "abba", "aab", "xab", "axxb", "xx"] + ["".join(r.choices("aabbx", k=r.randint(1, 14))) for _ in range(400)]
    for chunk in chunks:
        assert count(chunk) == len(t.encode(chunk).ids), chunk


def test_a_vocabulary_that_crosses_chunks_is_refused():
    with pytest.raises(ValueError):
        Counter([("a" + MARK + "b", -1.0)], True)


def test_empty_table(spark):
    assert token_counts(docs(spark, []), model_path()).collect() == []
