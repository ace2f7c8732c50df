"""Byte-pair encoding by last-token states.

For a byte-level vocabulary whose merges are ranked in the order of their ids,
the encoding of a prefix is the encoding of a shorter prefix and one more token:
its *last token*.  A token ``t`` that ends a prefix is the last one exactly if
no merge crosses the boundary between it and the last token before it.  So one
left-to-right pass over a word finds the last token of each prefix, and with it
the exact token count of each prefix; no merge queue is run.

Whether a merge crosses the boundary of two tokens depends on those two alone.
While a token is built from bytes, the piece at its edge goes through a fixed
chain of ever later merges (its *spine*), so two spines are walked side by side
in the order of ranks and every pair that exists at the same time is looked up.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable

import regex

#: The split before merges, as the byte-level pre-tokenizer defines it (fixed value).
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
NEVER = 1 << 60
#: Longer words are not remembered.
LONGEST = 256


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the lazily grown tables of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        names = {name: i for name, i in model["vocab"].items() if all(c in alphabet for c in name)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {k: v for k, v in names.items() if k not in self.special}
        self.text = {i: as_bytes(name) for name, i in names.items()}
        self.ids = {b: i for i, b in self.text.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}
        last = -1
        for m in model["merges"]:
            a, b = (names[x] for x in (m if isinstance(m, list) else m.split(" ")))
            t = names["".join(m) if isinstance(m, list) else m.replace(" ", "")]
            if t <= max(last, a, b):
                raise ValueError("merge ranks must follow the order of ids")
            last = t
            self.parts[t] = (a, b)
            self.merged[a << 16 | b] = t
        self.pieces = {**self.text, **{i: s.encode() for s, i in self.special.items()}}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._clean: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._heads = {b[:n] for b in self.text.values() for n in range(1, len(b) + 1)}
        self._states: dict[bytes, int] = {b"": 0}
        self._names: list[bytes] = [b""]
        self._ends: list[tuple] = [()]
        self.steps: dict[int, int] = {}

    def _spine(self, t: int, side: int) -> list[int]:
        chain = [t]
        while chain[-1] in self.parts:
            chain.append(self.parts[chain[-1]][side])
        return chain[::-1]

    def _crossed(self, a: int, b: int) -> int:
        """The first merge across the boundary of a and b, or NEVER."""
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            next_a = left[i + 1] if i + 1 < len(left) else NEVER
            next_b = right[j + 1] if j + 1 < len(right) else NEVER
            m = self.merged.get(left[i] << 16 | right[j], NEVER)
            if m < next_a and m <= next_b and m != NEVER:
                return m
            if next_a == next_b == NEVER:
                return NEVER
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def stands(self, pair: int) -> bool:
        """Whether the tokens of ``pair`` (first << 16 | second) can follow one another."""
        ok = self._pairs[pair] = self._crossed(pair >> 16, pair & 0xFFFF) == NEVER
        return ok

    def clean(self, t: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        if t not in self._clean:
            self._clean[t] = t not in self.parts or (self.clean(self.parts[t][0]) and self.clean(self.parts[t][1]) and self._crossed(*self.parts[t]) == t)
        return self._clean[t]

    def step(self, key: int) -> int:
        """The state after ``key`` (state << 8 | byte): the longest end of the input that begins a token."""
        name = self._names[key >> 8] + bytes((key & 0xFF,))
        while name and name not in self._heads:
            name = name[1:]
        if name not in self._states:
            self._states[name] = len(self._names)
            self._names.append(name)
            ends = (self.ids.get(name[i:]) for i in range(len(name)))
            self._ends.append(tuple((t, len(self.text[t])) for t in ends if t is not None and self.clean(t)))
        out = self.steps[key] = self._states[name]
        return out

    def extend(self, word: bytes, states: list[int], last: list[int], counts: list[int]) -> None:
        """Go on from the prefix whose states are given to the whole of ``word``."""
        steps, pairs, ends = self.steps, self._pairs, self._ends
        state = states[-1]
        for i in range(len(last), len(word) + 1):
            key = state << 8 | word[i - 1]
            state = steps[key] if key in steps else self.step(key)
            for t, n in ends[state]:
                if n == i:
                    break
                pair = last[i - n] << 16 | t
                if pairs[pair] if pair in pairs else self.stands(pair):
                    break
            else:
                raise ValueError("a byte has no token")
            states.append(state)
            last.append(t)
            counts.append(counts[i - n] + 1)

    def chain(self, last: list[int]) -> array:
        """The tokens of a word, from the last tokens of its prefixes."""
        ids, i = array("I"), len(last) - 1
        while i:
            ids.append(last[i])
            i -= len(self.text[last[i]])
        ids.reverse()
        return ids

    def sections(self, text: str) -> list[tuple[bool, str]]:
        """The text around special strings, and those, marked True."""
        if self.special_split is None or not any(s in text for s in self.special):
            return [(False, text)]
        return [(s in self.special, s) for s in self.special_split.split(text) if s]


class Memo(dict):
    """Results by word, in two generations of at most ``most`` words, so its memory is bounded.

    ``make`` computes a missing result.  Dropped words are computed again when they return.
    """

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def room(self) -> None:
        """Call between documents; starts a new generation when this one is full."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= LONGEST:
            self[word] = out
        return out


def trie_walk(voc: Vocabulary, words: Iterable[str]):
    """Yields (word, token ids) of distinct words, each shared prefix computed once.

    Sorted words are the leaves of their trie in depth-first order, and the
    common prefix of neighbours is the node the walk returns to; the states on
    the path to it are kept on a stack.  Memory: the words and one path.
    """
    states, last, counts, before = [0], [-1], [0], b""
    for raw in sorted({w.encode() for w in words}):
        most, keep = min(len(raw), len(before)), 0
        if raw[:most] == before[:most]:
            keep = most
        else:
            while raw[keep] == before[keep]:
                keep += 1
        del states[keep + 1 :], last[keep + 1 :], counts[keep + 1 :]
        voc.extend(raw, states, last, counts)
        before = raw
        yield raw.decode(), voc.chain(last)
