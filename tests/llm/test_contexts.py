"""Contexts of personal data: words of the whole text, and rounds until nothing is added."""

import re

from gristmill.llm import pii


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["spans"] for r in pii.spans(df).orderBy("doc_id").collect()]


def test_contexts_hold_neighbouring_tokens(shipped):
    seeds = [f"please ring ext7 desk9 +1 (20{i}) 555-01{i:02} any time" for i in range(8)]
    got = found(shipped, [*seeds, "you may ring ext7 desk9 5550-1234-77 now"])
    assert got[-1] == "phone:24:36"


def test_contexts_equal_brute_force(shipped):
    texts = [" ".join(f"{'w' * (i % 5)}{i * 7919 % 1000}" if i * j % 3 else "word" for i in range(90)) for j in range(1, 9)] + ["1 " * 200, "a@b.cc" * 3, "7", "x" * 100 + " 5 " + "y" * 100 + " 6"]
    df = shipped.createDataFrame(list(enumerate(texts)), "rid long, text string")
    for kind, (rule, needs) in {"token": (pii.TOKEN, "[0-9@]"), "email": (pii.PATTERNS["email"], "@")}.items():
        got = sorted((r["rid"], r["start"], r["before"], r["after"]) for r in pii._matches(df, {kind: (rule, needs)}).collect())
        if kind == "token":
            want = [(i, m.start(), t[max(0, m.start() - pii.NEAR) : m.start()], t[m.end() : m.end() + pii.NEAR]) for i, t in enumerate(texts) for m in re.finditer(rule, t)]
            assert got == sorted(want)
        else:
            assert all(b == texts[i][max(0, s - pii.NEAR) : s] for i, s, b, _ in got) and got


def test_rounds_go_on_until_nothing_is_added(shipped):
    # Each of a step's four patterns holds the eight known values and two new ones: 0.8 known; the new ones are the next step's known values.
    known, texts = [f"+1 (20{i}) 555-01{i:02}" for i in range(8)], []
    for step in ("amber", "birch", "cedar", "delta", "ember", "fjord"):
        new = [f"{step}{i}-77" for i in range(8)]
        texts += [f"{step} q{'abcd'[j]} {v}" for j in range(4) for v in known + new[2 * j : 2 * j + 2]]
        known = new
    assert all(found(shipped, texts))
