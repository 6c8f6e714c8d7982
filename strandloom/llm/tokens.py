"""Token ids of whole texts by the tokenizers library, with a cache of space-led pieces."""

from __future__ import annotations

import array
import json
import os
import re
import sys
import types

import numpy as np

#: White space beyond these four is rare; a text with it goes through the library whole.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")
#: Letters with no mark in their lower case, and with what stands before and after them no other normal form.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: A piece of these alone is cut by the patterns below; any other goes through the library.
PLAIN = re.compile(rf"[\t\n\r -~{LETTERS}]*")
SIMPLE = re.compile(rf"[{LETTERS}]+")
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pre-tokenizers of the two kinds of vocabulary, over plain pieces.
SPACED = re.compile(rf"{SHORT}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
BARE = re.compile(rf"{SHORT}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
#: A text is cut at each space; where white space leads to a space, only at those after something else.
RUN = re.compile("[ \t\n\r] ")
AFTER = re.compile("(?<=[^ \t\n\r]) ")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives one array of ids for each text, the same as the library's for the whole text.

    No token of these vocabularies reaches from a character that is not white space over a space, so the words between
    are encoded alone; words recur, and each is encoded once. A new word of plain characters is cut as the vocabulary's
    pre-tokenizer cuts it, and the library's model encodes the cuts; any other goes through the library whole. The
    cache is emptied when it has grown to `most` entries of at most LONG characters, so memory is bounded.
    """

    #: Longest word that is kept, and longest one with marks in it: longer ones recur less than their parts.
    LONG, LONG_MARKED = 64, 8

    def __init__(self, path: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made["pre_tokenizer"]
        #: Whether a space before a word belongs to its token.
        self.spaced = pre["type"] == "ByteLevel"
        lowered = any(n["type"] == "Lowercase" for n in (made["normalizer"] or {}).get("normalizers", []))
        # Other kinds of vocabularies have other cuts: they go through the library whole.
        self.known_kind = self.spaced and made["normalizer"] is None and pre["use_regex"] and not pre["add_prefix_space"] or lowered and pre["type"] == "Sequence"
        self.letters = byte_letters()
        self.most = most
        #: Ids of words that follow a space; of what follows none, under a key with \x01 before it.
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= self.LONG:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = ids
        return ids

    def ids(self, cut: str) -> bytes:
        """The model's ids of one cut of a pre-tokenizer."""
        letters = cut.encode().decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def cut(self, cut: str) -> bytes:
        """The ids of one cut, from the cache if it is there."""
        key = cut if not self.spaced else cut[1:] if cut[0] == " " and len(cut) > 1 else "\x01" + cut
        found = self.known.get(key)
        return self.keep(key, self.ids(cut)) if found is None else found

    def word(self, word: str, led: bool) -> bytes:
        """The ids of one word, led by a space or not."""
        text = " " + word if led and self.spaced else word if self.spaced else word.lower()
        if SIMPLE.fullmatch(word):
            found = self.ids(text)
        elif PLAIN.fullmatch(word):
            found = b"".join(map(self.cut, (SPACED if self.spaced else BARE).findall(text)))
            if len(word) > self.LONG_MARKED:
                return found
        else:
            found = self.whole(text if self.spaced else word).tobytes()
        return self.keep(word, found) if led or not self.spaced else found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = []
        for text in texts:
            if not text or not self.known_kind or "\x01" in text or ODD_SPACE.search(text):
                out.append(self.whole(text))
                continue
            words = AFTER.split(text) if self.spaced and RUN.search(text) else text.split(" ")
            got = list(map(self.known.get, words))
            if self.spaced:
                got[0] = self.word(words[0], False)
            if None in got:
                for at, found in enumerate(got):
                    if found is None:
                        # It may occur twice in this text.
                        found = self.known.get(words[at])
                        got[at] = self.word(words[at], True) if found is None else found
            out.append(np.frombuffer(b"".join(got), dtype="<u4"))
        return out


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which later tasks of the same worker find with its pieces known."""
    held = sys.modules.setdefault("strandloom_worker_state", types.ModuleType("strandloom_worker_state")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
