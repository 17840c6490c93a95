"""The compiled table against merging by rank, for made-up vocabularies too."""

import random

import numpy as np
import pytest

from gristmill.llm import bpe, queries


def merged(word, ranks):
    """Tokens of a word by repeated merging of the pair of least rank, leftmost first."""
    while True:
        best = min(((ranks[p][0], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return word
        i = best[1]
        word = [*word[:i], ranks[word[i], word[i + 1]][1], *word[i + 2 :]]


@pytest.mark.parametrize("seed", range(12))
def test_random_vocabularies(seed):
    rnd = random.Random(seed)
    letters = b"abc"[: rnd.randint(1, 3)]
    labels, merges = [bytes([b]) for b in letters], []
    for _ in range(rnd.randint(0, 40)):
        x, y = rnd.randrange(len(labels)), rnd.randrange(len(labels))
        if labels[x] + labels[y] not in labels:
            merges.append((x, y, len(labels)))
            labels.append(labels[x] + labels[y])
    automaton = bpe.Automaton({"labels": labels, "merges": merges, "special": {}})
    ranks = {(x, y): (k, z) for k, (x, y, z) in enumerate(merges)}
    for _ in range(300):
        word = bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 24)))
        assert automaton.encode_word(word) == merged([letters.index(b) for b in word], ranks)
    alive = {z for _, _, z, _ in bpe.live(merges)} | set(range(len(letters)))
    for p in alive:
        for t in alive:
            pair = merged([letters.index(b) for b in labels[p] + labels[t]], ranks)
            assert automaton.arc(p, t) == (pair == [p, t])


def test_arcs_of_the_vocabulary():
    vocabulary = bpe.read_vocabulary(queries.vocabulary())
    automaton = bpe.Automaton(vocabulary)
    labels, ranks = vocabulary["labels"], {(x, y): (k, z) for k, (x, y, z) in enumerate(vocabulary["merges"])}
    single = {label: i for i, label in enumerate(labels) if len(label) == 1}
    rnd, made = random.Random(1), [z for _, _, z in vocabulary["merges"]]
    for _ in range(3000):
        p, t = rnd.choice(made[: rnd.choice([300, 3000, 50_000])]), rnd.choice(made[: rnd.choice([300, 3000, 50_000])])
        pair = merged([single[bytes([b])] for b in labels[p] + labels[t]], ranks)
        assert automaton.arc(p, t) == (pair == [p, t])
    # Ranges of a state are disjoint and rise.
    start, end = np.array(automaton.start), np.array(automaton.end)
    for a, b in zip(automaton.first[:500], automaton.first[1:501], strict=True):
        assert (start[a:b] < end[a:b]).all() and (end[a : b - 1] < start[a + 1 : b]).all()
