r"""Byte-level BPE as a deterministic automaton over merge gadgets.

Compilation goes through the merges in rank order.  Each merge (x, y) -> z of
rank k adds one gadget to the token automaton: the arc z from wherever x then y
could be read, and from then on no arc y out of a state entered by x.  So an
arc t out of the state of token p exists unless some gadget (x, y), x on the
right edge of p and y on the left edge of t, fired while both were still whole:
k < the rank at which x is merged away inside p, and k <= that of y inside t
(equal ranks: the left pair is merged first).  The token automaton is
deterministic: every prefix of a word has exactly one state, its last token.

Tokens that have x on their right edge are x's descendants in the forest "right
part of"; numbered depth first, parts of later merges before those of earlier
ones, the ones in which x outlives rank k are neighbours.  The same holds for
labels and left parts.  So a gadget closes the arcs of a rectangle, states by
labels, and the whole automaton is compiled into one table: for each state the
sorted, disjoint ranges of labels without an arc.

A byte trie gives the labels leaving a position.  Encoding a pre-split word is
one left-to-right pass: from each position follow the trie, and enter the state
of a label when the table has the arc.  Time is linear in the word's
length.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import freed

#: The published pre-split pattern of this kind of vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a worker's table of encoded words, which is emptied when full.
WORDS = 300_000
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level vocabularies write their labels."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Labels by id, merges as id triples in rank order, and special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, alphabet = spec["model"], byte_alphabet()
    vocab = model["vocab"]
    labels: list[bytes] = [b""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
    for token, i in vocab.items():
        labels[i] = bytes(alphabet[c] for c in token)
    merges = []
    for pair in model["merges"]:
        x, y = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((vocab[x], vocab[y], vocab[x + y]))
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    for content, i in special.items():
        labels[i] = content.encode()
    return {"labels": labels, "merges": merges, "special": special}


def live(merges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(x, y, z, rank) of the merges that can fire: x then y is what the merges before make of their letters."""
    gadgets: dict[int, dict[int, int]] = {}
    #: Pieces on the left and right edges of made tokens, each with the rank at which it is merged away inside.
    left: dict[int, list[tuple[int, int]]] = {}
    right: dict[int, list[tuple[int, int]]] = {}
    out, results = [], {z for _, _, z in merges}
    for rank, (x, y, z) in enumerate(merges):
        if any(t in results and t not in left for t in (x, y)):
            continue  # a part that no merge before makes
        inner_x = right.get(x) or [(x, rank)]
        inner_y = left.get(y) or [(y, rank)]
        dead = z in left
        for a, a_end in inner_x:
            row = gadgets.get(a)
            if row:
                for b, b_end in inner_y:
                    k = row.get(b)
                    if k is not None and k < a_end and k <= b_end:
                        dead = True
                        break
            if dead:
                break
        if dead:
            continue
        gadgets.setdefault(x, {})[y] = rank
        out.append((x, y, z, rank))
        # Outermost first; a token itself is never merged away.
        whole_x, whole_y = left.get(x) or [(x, NEVER)], right.get(y) or [(y, NEVER)]
        left[z] = [(z, NEVER), (x, rank), *whole_x[1:]]
        right[z] = [(z, NEVER), (y, rank), *whole_y[1:]]
    return out


class _Forest:
    """Tokens below the token that is their left (0) or right (1) part, numbered depth first, parts of later merges before those of earlier ones."""

    def __init__(self, made: dict[int, tuple[int, int, int]], side: int, size: int):
        self.below: dict[int, list[tuple[int, int]]] = {}
        for z, m in made.items():
            self.below.setdefault(m[side], []).append((-m[2], z))
        for row in self.below.values():
            row.sort()
        self.place, self.end, k = [0] * size, [0] * size, 0
        stack = [t for t in range(size - 1, -1, -1) if t not in made]
        while stack:
            t = stack.pop()
            if t < 0:
                self.end[~t] = k
                continue
            self.place[t], k = k, k + 1
            stack.append(~t)
            stack += [z for _, z in reversed(self.below.get(t, []))]

    def reach(self, part: int, rank: int, equal: bool) -> tuple[int, int]:
        """Numbers of the tokens with this part on their edge, whole until after that rank (equal: or until it)."""
        row = self.below.get(part, [])
        i = bisect_right(row, (-rank, 1 << 60)) if equal else bisect_left(row, (-rank, -1))
        return self.place[part], self.end[row[i - 1][1]] if i else self.place[part] + 1


class Automaton:
    def __init__(self, vocabulary: dict):
        self.labels: list[bytes] = vocabulary["labels"]
        self.special: dict[str, int] = vocabulary["special"]
        merges = live(vocabulary["merges"])
        made = {z: (x, y, rank) for x, y, z, rank in merges}
        # Byte trie of the labels that the merges can make: single bytes and merge results.
        self.next: dict[int, int] = {}
        self.label_at: list[int] = [-1]
        alone = set(self.special.values())
        for t, label in enumerate(self.labels):
            if t in alone or not label or (len(label) > 1 and t not in made):
                continue
            node = 0
            for b in label:
                key = node << 8 | b
                if key not in self.next:
                    self.next[key] = len(self.label_at)
                    self.label_at.append(-1)
                node = self.next[key]
            self.label_at[node] = t
        self._compile(merges, made)

    def _compile(self, merges: list[tuple[int, int, int, int]], made: dict[int, tuple[int, int, int]]) -> None:
        """The table: from first[state], the ranges start[i] <= label < end[i] without an arc; states and labels by their forest's numbers."""
        size = len(self.labels)
        right, left = _Forest(made, 1, size), _Forest(made, 0, size)
        self.state_at, self.arc_at = right.place, left.place
        gadgets = [(*right.reach(x, rank, False), *left.reach(y, rank, True)) for x, y, _, rank in merges]
        low, high, start, end = np.array(gadgets, np.int64).reshape(-1, 4).T
        many = high - low
        state = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else low
        # One number line, a stretch of it for each state; overlapping ranges become one.
        start, end = state * size + np.repeat(start, many), state * size + np.repeat(end, many)
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        new = np.concatenate([[True], (start[1:] > end[:-1]) | (start[1:] // size > start[:-1] // size)]) if len(start) else np.empty(0, bool)
        at = np.nonzero(new)[0]
        end = np.maximum.reduceat(end, at) if len(at) else end
        state = start[at] // size if len(at) else start
        self.first = np.searchsorted(state, np.arange(size + 1)).tolist()
        self.start, self.end = (memoryview((x - state * size).astype(np.uint32)) for x in (start[at], end))

    def arc(self, p: int, t: int) -> bool:
        """Whether the state of token p has an arc labelled t."""
        s, label = self.state_at[p], self.arc_at[t]
        low = self.first[s]
        i = bisect_right(self.start, label, low, self.first[s + 1])
        return i == low or self.end[i - 1] <= label

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        state = [-1] * (n + 1)
        nxt, label_at, labels = self.next, self.label_at, self.labels
        first, start, end, arc_at = self.first, self.start, self.end, self.arc_at
        for i in range(n):
            node, j, p = 0, i, state[i]
            if i and p < 0:
                continue
            if i:
                low = first[self.state_at[p]]
                high = first[self.state_at[p] + 1]
            while j < n:
                node = nxt.get(node << 8 | word[j])
                if node is None:
                    break
                j += 1
                t = label_at[node]
                if t >= 0 and state[j] < 0:
                    if i:
                        label = arc_at[t]
                        k = bisect_right(start, label, low, high)
                        if k > low and end[k - 1] > label:
                            continue
                    state[j] = t
        out, j = [], n
        while j:
            out.append(state[j])
            j -= len(labels[state[j]])
        out.reverse()
        return out


class _Words(dict):
    """Pre-split word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = self.automaton.encode_word(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """Encoder and decoder of whole texts."""

    def __init__(self, vocabulary: dict):
        import regex

        self.automaton = Automaton(vocabulary)
        self.split = regex.compile(SPLIT).findall
        self.words = _Words(self.automaton)
        special = sorted(self.automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = special

    def encode(self, text: str) -> bytes:
        if not self.marks or not any(m in text for m in self.marks):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        out = []
        for k, piece in enumerate(self.special.split(text)):
            if k % 2:
                out.append(struct.pack("<I", self.automaton.special[piece]))
            else:
                out.extend(map(self.words.__getitem__, self.split(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        labels = self.automaton.labels
        return b"".join([labels[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(key: str, vocabulary) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary.value)
    return _CODECS[key]


def _mapped(df: DataFrame, key: str, vocabulary, source: str, fields: list[T.StructField], step) -> DataFrame:
    """df with new columns made from column source, batch by batch."""
    clash = [f.name for f in fields if f.name in df.columns]
    df = df.drop(*clash)
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, vocabulary)
        for batch in batches:
            # Slices of bounded text size, so that a batch of very long texts stays small in memory.
            sizes, start, n = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), 0, batch.num_rows
            while start < n:
                stop, size = start, 0
                while stop < n and (stop == start or size < 8 << 20):
                    size += sizes[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                new = step(codec, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(f.name for f in fields)])
                start = stop

    return df.mapInArrow(freed(run), schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Add the token ids of column text: ids (binary, little-endian unsigned 32-bit) and their number.

    Null and empty texts give no ids.  Strings of special tokens in a text
    become those tokens.  Columns of df that have the new names are replaced.
    The vocabulary file at path is read on the driver; executors get it by a
    broadcast whose size depends on the vocabulary alone.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def step(codec: Codec, texts: list) -> list[pa.Array]:
        out = [codec.encode(t) if t else b"" for t in texts]
        return [pa.array(out, pa.binary()), pa.array([len(b) // 4 for b in out], pa.int64())]

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())]
    return _mapped(df, path, vocabulary, text, fields, step)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add column decoded: the text spelled by the labels of the ids (null ids: empty text)."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def step(codec: Codec, packed: list) -> list[pa.Array]:
        return [pa.array([codec.decode(b) if b else "" for b in packed], pa.string())]

    return _mapped(df, path, vocabulary, ids, [T.StructField(decoded, T.StringType())], step)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """encode() and decode() in one pass: adds ids, n_tokens and decoded, replaces column text."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def step(codec: Codec, texts: list) -> list[pa.Array]:
        out = [codec.encode(t) if t else b"" for t in texts]
        return [pa.array(out, pa.binary()), pa.array([len(b) // 4 for b in out], pa.int64()), pa.array([codec.decode(b) for b in out], pa.string())]

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    return _mapped(df, path, vocabulary, text, fields, step).drop(text)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text of documents: one row for each, repeated rows included; null and empty texts have no ids."""
    out = round_trip(df.select("doc_id", "text"), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
