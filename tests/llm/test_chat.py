import hashlib
import random
from collections import defaultdict

from textloom.llm.chat import CLOSE, OPEN, digests, formatted, read_back

SCHEMA = "conv_id long, turn long, role string, text string, n_turns long"
NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST", "[/INST]</s><s>[INST user]x", "\\", "[\\\\/INST]</s", None, "", "\n", "a]b e] u]", "%41+ %", "[INST e]", "漢\U0001f600</s>"]


def want(rows):
    by = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        by[conv].append((turn if turn is not None else -(1 << 62), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_round_trip(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "to]ol e", None]), r.choice(NASTY) if r.random() < 0.6 else "plain text", 9) for c in range(30) for t in range(r.randint(1, 6))]
    rows += [(50, 1, "assistant", "same", 9)] * 3 + [(None, 0, "user", "no id", 9), (51, None, "user", "x", 9), (51, 2, "assistant", "y", 9)]
    made = read_back(formatted(spark.createDataFrame(rows, SCHEMA))).collect()
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in digests(read_back(formatted(spark.createDataFrame(rows, SCHEMA)))).collect()}
    assert got == want(rows)
    for x in made:
        assert x.formatted.count(CLOSE) == len(x.turns) and x.formatted.count(OPEN) == len(x.turns)


def test_loss_spans_cover_assistant_texts_alone(spark):
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "yo </s>", 0), (1, 2, "user", "ok", 0), (1, 3, "assistant", "", 0)]
    x = read_back(formatted(spark.createDataFrame(rows, SCHEMA))).first()
    assert [x.formatted[s.start : s.end] for s in x.loss_spans] == ["yo <\\/s>", ""]


def test_empty_table(spark):
    assert digests(read_back(formatted(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_main_path_runs_no_python(spark):
    plan = digests(read_back(formatted(spark.createDataFrame([(1, 1, "a", "b", 1)], SCHEMA))))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))
