"""Learned operators against plain Python: toxic matches, site posteriors, rounds of the pattern graph, labels that disagree."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import pii, quality, toxicity


def naive_matches(lexicon, folded):
    hits, words, at = {}, folded.split(), 0
    starts = []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    for s, w in zip(starts, words, strict=True):
        got = [(v, len(t) + 1) for t, v in lexicon.weights.items() if w.startswith(t)]
        # A term may also run on over words, as the text has one space between them.
        got += [(v, len(t) + 1) for t, v in lexicon.weights.items() if " " in t and folded.startswith(f" {t}", s)]
        if got:
            hits[s] = max(got, key=lambda x: x[0])[0]
    for e in lexicon.exceptions:
        k = len(e.split())
        for i in range(len(words) - k + 1):
            if words[i : i + k] == e.split():
                for j in range(i, i + k):
                    hits.pop(starts[j], None)
    return hits


def test_matches_equal_a_naive_scan():
    rnd = random.Random(4)
    for _ in range(300):
        make = lambda k: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, k)))
        lexicon = toxicity.Lexicon({make(4): rnd.choice([1.0, 2.0, 3.5]) for _ in range(rnd.randint(0, 5))}, [" ".join(make(4) for _ in range(rnd.randint(1, 2))) for _ in range(rnd.randint(0, 4))])
        folded = toxicity.fold(" ".join(make(6) for _ in range(rnd.randint(0, 30))))
        got = {k: v for k, (v, _) in toxicity.matches(lexicon.matcher(), folded).items()}
        assert got == naive_matches(lexicon, folded)


def test_disagreeing_labels_are_toxic_or_poor(shipped):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["zorg", "plain", "word", "other", "fine"][i % 3 :]) for _ in range(30))) for i in range(60)]
    docs = shipped.createDataFrame(rows + rows[:9], "doc_id long, text string")
    labels = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(60)]
    both = labels + [(i, 1, 0) for i in range(60)] + [(None, 0, 1), (3, None, None), (6, 7, 7)]
    one, two = ([tuple(r) for r in toxicity.scored(docs, shipped.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect()] for x in (labels, both))
    assert one == two and len(one) == 69
    spread = [quality.train(docs, shipped.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, both)]
    assert spread[0] == spread[1]


def test_posteriors_equal_plain_python(shipped):
    rnd = random.Random(7)
    rows = [(i, h := rnd.choice(["a", "a", "a", "b", "c", f"h{i}"]), f"{h}/{rnd.randint(0, 3)}", rnd.gauss({"a": 1.5, "b": -2.0}.get(h, 0.0), 1.0)) for i in range(500)]
    known = quality.Classifier((), (), (), 0.5)
    got = {r["doc_id"]: r for r in quality.combined(shipped.createDataFrame(rows, "doc_id long, host string, path string, logit double"), known).collect()}
    p = {i: 1 / (1 + math.exp(-x)) for i, _, _, x in rows}
    by_path, by_host, path_host = defaultdict(list), defaultdict(list), {}
    for i, h, u, _ in rows:
        by_path[h, u].append(p[i])
        by_host[h].append(p[i])
        path_host[h, u] = h
    overall = min(0.999, max(0.001, sum(p.values()) / len(p)))
    spread = lambda x: sum(v * (1 - v) for v in x) / len(x)

    def strength(groups):  # (n, mean, inner spread, parent)
        many = [g for g in groups if g[0] > 1]
        between = np.mean([(m - up) ** 2 - v / n for n, m, v, up in many])
        most = np.mean([up * (1 - up) for _, _, _, up in many])
        return min(1e4, max(1.0, most / max(between, 1e-9) - 1))

    host_k = strength([(len(x), sum(x) / len(x), spread(x), overall) for x in by_host.values()])
    post = {h: (sum(x) + host_k * overall) / (len(x) + host_k) for h, x in by_host.items()}
    path_k = strength([(len(x), sum(x) / len(x), spread(x), post[path_host[k]]) for k, x in by_path.items()])
    for i, h, u, logit in rows:
        hx, ux = by_host[h], by_path[h, u]
        h_rest = (sum(hx) - p[i] + host_k * overall) / (len(hx) - 1 + host_k)
        site = (sum(ux) - p[i] + path_k * h_rest) / (len(ux) - 1 + path_k)
        prior = min(0.999, max(0.001, site))
        score = 1 / (1 + math.exp(-(logit + math.log(prior / (1 - prior)) - math.log(overall / (1 - overall)))))
        assert got[i]["p_site"] == pytest.approx(site, abs=1e-9) and got[i]["score"] == pytest.approx(score, abs=1e-9)
        assert got[i]["keep"] == (score >= 0.5)
    # A host of one document leans on the global share alone.
    lone = next(i for i, h, _, _ in rows if len(by_host[h]) == 1)
    assert got[lone]["p_site"] == pytest.approx(overall, abs=1e-9)


def test_quality_holds_out(shipped, sf):
    docs, labels = (shipped.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.scored(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).join(labels.where("quality is not null"), "doc_id")
    held = out.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    assert len(held) >= 10 and sum(r["keep"] == bool(r["quality"]) for r in held) / len(held) > 0.9


def grown_by_hand(texts):
    """Spans that the rounds add, in plain Python: doc -> {(kind, start, end)}."""
    rules = [(k, re.compile(pii.PATTERNS[k].replace(r"|\G", ""))) for k in pii.KINDS]
    edges, tokens, known = defaultdict(set), [], {}

    def patterns(text, a, b):
        before, after = text[max(0, a - pii.NEAR) : a].lower(), text[b : b + pii.NEAR].lower()
        last, two, first = re.search(r"(\S+)\s*$", before), re.search(r"(\S+\s+\S+)\s*$", before), re.match(r"\s*(\S+)", after)
        return ([f"2 {re.sub(r'\s+', ' ', two[1])}"] if two else []) + ([f"1 {last[1]} _ {first[1]}"] if last and first else [])

    for d, text in enumerate(texts):
        base = [(k, m.start(), m.end()) for k, rule in rules for m in rule.finditer(text) if k != "phone" or 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        for k, a, b in base:
            for p in patterns(text, a, b):
                edges[p].add(text[a:b].lower())
                known[p, text[a:b].lower()] = k
        for m in re.finditer(pii.TOKEN, text):
            if not any(a < m.end() and m.start() < b for _, a, b in base):
                for p in patterns(text, m.start(), m.end()):
                    edges[p].add(m[0].lower())
                    tokens.append((d, m.start(), m.end(), m[0].lower(), p))
    learned = {}
    while True:
        trusted = {}
        for p, values in edges.items():
            kinds = defaultdict(int)
            for v in values:
                k = known.get((p, v)) or learned.get(v)
                if k:
                    kinds[k] += 1
            if kinds:
                c, k = max((c, k) for k, c in kinds.items())
                if c >= pii.SUPPORT and c / len(values) >= pii.TRUST:
                    trusted[p] = (c / len(values), k)
        step = defaultdict(list)
        for p, (t, k) in trusted.items():
            for v in edges[p]:
                if (p, v) not in known:
                    step[v].append((t, k))
        new = {v: learned.get(v) or max(x)[1] for v, x in step.items()}
        if len(new) == len(learned):
            break
        learned = new
    out = defaultdict(dict)
    for d, a, b, _, p in tokens:
        if p in trusted:
            out[d][a, b] = min(trusted[p][1], out[d].get((a, b), "z"))
    return {d: sorted(f"{k}:{a}:{b}" for (a, b), k in x.items()) for d, x in out.items()}


def test_rounds_equal_plain_python(shipped):
    rnd = random.Random(12)
    texts = []
    for i in range(260):
        lead = rnd.choice(["please write to", "call me at", "his account is", "see also the"])
        rule = {"please write to": f"bob{rnd.randint(0, 40)}@example.org", "call me at": f"+49 30 555{rnd.randint(1000, 1040)}"}
        value = rule[lead] if lead in rule and rnd.random() < 0.93 else f"user{rnd.randint(0, 5)}x"
        texts.append(f"some words {lead} {value} {rnd.choice(['today', 'now', 'again please'])}")
    df = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = grown_by_hand(texts)
    got = {}
    for r in pii.spans(df).collect():
        extra = set(r["spans"].split(",")) - set(r["base"].split(",")) - {""}
        if extra:
            got[r["doc_id"]] = sorted(extra)
    assert got == want and len(want) > 5
