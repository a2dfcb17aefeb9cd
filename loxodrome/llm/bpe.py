"""Byte-level BPE by depth-first traversal of a trie of distinct words.

A token sequence is the BPE encoding of its bytes exactly if every token encodes to itself and every two neighbours are
the encoding of their joint bytes. So each prefix of a word has one *last token*: the suffix token that is compatible with
the last token of the prefix before it. Walking the trie of the distinct words depth first and keeping the last token of
every node on the path computes what words share once; a word's encoding is read back along its last tokens.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import regex
from tokenizers import pre_tokenizers

#: The pre-tokenizer pattern of byte-level BPE files (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokenizing at single spaces is safe unless white space runs across the space.
RUN_AT_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Beyond these the Unicode tables of two regular expression engines may differ, and the library's own splitter is asked.
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: Encoded pieces of a generation that a worker remembers (two at most); the oldest go when it is full, which changes speed and not results.
REMEMBERED = 300_000


def byte_chars() -> dict[str, int]:
    """The printable stand-ins by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["normalizer"] or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        chars = byte_chars()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_ids = special
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        to_bytes = lambda token: bytes(chars[c] for c in token)
        vocab = file["model"]["vocab"]
        self.ids = {to_bytes(token): i for token, i in vocab.items() if token not in special}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.ids.items()} | {i: token.encode() for token, i in special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(PATTERN)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.itself: dict[int, bool] = {}
        self.compatible: dict[int, bool] = {}
        self.first: dict[str, bytes] = {}  # encoded pieces at the start of a text
        self.later: dict[str, bytes] = {}  # encoded pieces that follow a space
        self.older: dict[str, bytes] = {}  # the same of the generation before

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE by merge rank, for a token or two."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            rank, at = min((self.merges.get(pair, (1 << 60,))[0], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def fits(self, key: int) -> bool:
        """Whether two tokens (the first in the key's upper half) are the encoding of their joint bytes."""
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            before, token = key >> 32, key & 0xFFFFFFFF
            known = self.compatible[key] = self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return known

    def alone(self, token: int) -> bool:
        if (known := self.itself.get(token)) is None:
            known = self.itself[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) of each distinct word, by one preorder walk of their trie.

        Sorted words list the trie's leaves in preorder; `last` is the path from the root to the current node and holds
        each node's last token, so a word continues where it leaves the path of the word before it.
        """
        get, compatible, fits, alone = self.ids.get, self.compatible.get, self.fits, self.alone
        out, last, starts, before = {}, [], [], b""
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:], starts[shared:]
            for end in range(shared + 1, len(word) + 1):
                grown = starts[-1] if starts else 0  # first the path's last token with the new byte, then from the shortest
                start, least = grown, max(0, end - self.longest)
                following = end - 1
                while True:
                    if (token := get(word[start:end])) is not None:
                        if not start:
                            if alone(token):
                                break
                        elif compatible(key := last[start - 1] << 32 | token) or fits(key):
                            break
                    if following == grown:
                        following -= 1
                    if following < least:
                        raise ValueError("the vocabulary lacks a byte")
                    start, following = following, following - 1
                last.append(token)
                starts.append(start)
            found, end = [], len(word)
            while end:
                found.append(last[end - 1])
                end = starts[end - 1]
            out[word] = array("I", found[::-1]).tobytes()
            before = word
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if BEYOND_LATIN.search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; equal to the library's with add_special_tokens=False. A null text has none.

        Texts split at single spaces into pieces, whose encodings don't depend on their surroundings; the distinct new
        pieces of the whole batch share one trie.
        """
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first, self.older, self.later = {}, self.later, {}
        plans = []
        new_first, new_later, whole = set(), set(), {}
        for text in texts:
            plan = []
            for part in (self.special.split(text) if self.special and text else [text or ""]):
                if part in self.special_ids:
                    plan.append(part)
                elif not part:
                    continue
                elif RUN_AT_SPACE.search(part):
                    plan.append(own := self.pieces(part))
                    whole |= dict.fromkeys(own)
                else:
                    head, *rest = part.split(" ")
                    plan.append((head, rest))
                    new_first.add(head)
                    new_later.update(rest)
            plans.append(plan)
        new_first -= self.first.keys()
        new_later -= self.later.keys()
        self.later.update((p, self.older[p]) for p in new_later & self.older.keys())
        new_later -= self.older.keys()
        cut = {p: self.pieces(p) for p in new_first}
        cut_later = {p: [" " + p] if p.isascii() and p.isalpha() else self.pieces(" " + p) for p in new_later}
        tokens = {t for group in (cut, cut_later) for own in group.values() for t in own} | whole.keys()
        known = self.encode_words([t.encode() for t in tokens])
        ids = {t: known[t.encode()] for t in tokens}
        for memory, group in ((self.first, cut), (self.later, cut_later)):
            memory.update((p, b"".join([ids[t] for t in own])) for p, own in group.items())
        out = []
        for plan in plans:
            parts = []
            for x in plan:
                if isinstance(x, str):
                    parts.append(array("I", [self.special_ids[x]]).tobytes())
                elif isinstance(x, list):
                    parts.extend([ids[t] for t in x])
                else:
                    parts.append(self.first[x[0]])
                    parts.extend(map(self.later.__getitem__, x[1]))
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of little-endian unsigned 32-bit ids, special tokens kept."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_ENCODERS: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """The encoder of a file, built once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieBpe(path)
    return _ENCODERS[path]
