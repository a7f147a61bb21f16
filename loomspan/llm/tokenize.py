"""Token ids of whole texts with a public tokenizer file, each distinct chunk encoded once a worker.

Both pre-tokenisers in use never join characters across the chunk borders chosen here, so the ids of a text
are the ids of its chunks, one after the other:

* ``byte_bpe``: texts in which no white space follows white space are cut before every blank and line end; a
  chunk is a word with the single character of white space before it. Other texts are cut by BYTE_CHUNK;
* ``word_bpe``: white space is dropped, and a chunk is what stands between.

A full stop or comma at the end of a chunk and after a letter is a piece of its own, so such chunks are put
together from two known ones. A chunk of letters alone is one piece for both pre-tokenisers, and goes to the
tokenizer's model as such. Other chunks not seen before are encoded together, in one call for some thousands,
and told apart by the ids of a mark between them. The four controls U+001C to U+001F, which Python counts as
white space and the tokenisers don't, send a text to the tokenizer whole, and so do the mark and the start of
a special token. Long chunks hardly come again and are not kept; the memo is emptied when it is full, so memory
is bounded.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence

import numpy as np

BYTE_CHUNK = re.compile(r"\s+(?!\S)| ?\S+|\s+")
#: White space but blank and line end, and runs of those two.
RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
DIGIT = "\u0663"
START = "\x1c"
#: Characters whose lower case depends on others, or that composition may change.
UNEVEN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: b for b in PRINTABLE} | {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
KEPT: dict[tuple[str, bool], ChunkTokenizer | RankTokenizer] = {}


def chunk_tokenizer(path: str, words: bool) -> ChunkTokenizer | RankTokenizer:
    """The worker's tokenizer for a file, with the memo of earlier tasks."""
    key = (path, words)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
    if key not in KEPT:
        KEPT[key] = ChunkTokenizer(path, words) if words else RankTokenizer(path)
    return KEPT[key]


class RankTokenizer:
    """Byte-level ids of a tokenizers file whose merges rank as their ids, merged by tiktoken.

    The ids are those of the tokenizers library, which the tests hold them against; it alone takes about twice
    the CPU seconds. Texts with the start of a special token go to that library.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the merges' ranks are not the order of their ids")
        letters = {chr(c): b for b, c in BYTE_LETTERS.items()}
        parts = [*(chr(c) for c in BYTE_LETTERS.values()), *("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])]
        ranks = {bytes(letters[c] for c in p): vocabulary[p] for p in parts}
        self.encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """The packed ids of each text; empty for an empty one."""
        return [array("I", self.tokenizer.encode(x, add_special_tokens=False).ids if "<|" in x else self.encode(x)).tobytes() for x in texts]


def odd(text: str) -> bool:
    """Whether only the tokenizer itself can cut a text."""
    return "<|" in text or any(c in text for c in CONTROLS) or (DIGIT in text and not text.isascii())


def simple(text: str) -> bool:
    """Whether white space is single blanks and line ends between words, perhaps at either end."""
    return not any(c in text for c in RUNS) and text[0] not in " \n" and text[-1] not in " \n" and (text.isascii() or not WIDE.search(text))


class ChunkTokenizer(dict):
    """Maps a chunk to its ids as little-endian unsigned 32-bit integers."""

    TOGETHER, KEPT_LENGTH = 1_000, 10

    def __init__(self, path: str, words: bool, most: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.most = words, most
        # A line end, or a digit that is no part of a longer piece; texts with that digit are encoded whole.
        self.mark = f" {DIGIT} " if words else "\n"
        self.mark_ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.blank = "" if words else " "
        self.line_end = self._encode("\n")
        self.stops = {c: self._encode(c) for c in ".,"}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str, lead: str) -> bytes:
        """The ids of a word of letters, by the model."""
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(lead + piece)]).tobytes()

    def _bare(self, word: str) -> bytes:
        """The ids of a word without a blank before it."""
        core = word[:-1] if word[-1:] in self.stops else word
        if core.isalpha() and not UNEVEN.search(core):
            return self._letters(core, "") + (self.stops[word[-1]] if core != word else b"")
        return self._encode(word)

    def _learn(self, chunks: Sequence[str]) -> None:
        """Encodes letters by the model, and other chunks together, the mark between them, whose ids cut theirs out."""
        letters = [c for c in chunks if c.isalpha() and not UNEVEN.search(c) and (not self.words or c == c.lower())]
        lead = "" if self.words else "\u0120"
        for c in letters:
            self[c] = self._letters(c, lead)
        if len(letters) == len(chunks):
            return
        chunks = [c for c in chunks if c not in self]
        for k in range(0, len(chunks), self.TOGETHER):
            part = chunks[k : k + self.TOGETHER]
            text = self.mark + self.blank + (self.mark + self.blank).join(part) + self.mark
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            n = len(self.mark_ids)
            hit = ids[: len(ids) - n + 1] == self.mark_ids[0]
            for j in range(1, n):
                hit &= ids[j : len(ids) - n + 1 + j] == self.mark_ids[j]
            at = np.flatnonzero(hit)
            packed = ids.tobytes()
            self.update((c, packed[a:b]) for c, a, b in zip(part, (4 * (at[:-1] + n)).tolist(), (4 * at[1:]).tolist(), strict=True))

    def _chunks(self, text: str) -> list[str]:
        if self.words:
            return text.split() if UNEVEN.search(text) else text.lower().split()
        # Without its blank a word stands for the blank and itself; a line end and the text's start stay.
        if not simple(text):
            return [c if c.isspace() else c[1:] if c[0] == " " else START + c for c in BYTE_CHUNK.findall(text)]
        return (START + text).replace("\n", " \n").split(" ")

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """The packed ids of each text; empty for an empty one."""
        if len(self) >= self.most:
            self.clear()
        whole = [odd(x) for x in texts]
        flat: list[str] = []
        ends = []
        for x, w in zip(texts, whole):
            if x and not w:
                flat += self._chunks(x)
            ends.append(len(flat))
        found = list(map(self.get, flat))
        unseen = [k for k, v in enumerate(found) if v is None]
        new = {flat[k] for k in unseen}
        stopped = [c for c in new if c[-1] in ".," and c[-2:-1].isalpha() and not UNEVEN.match(c[-2])]
        new.difference_update(stopped)
        new.update(c[:-1] for c in stopped if c[:-1] not in self)
        special = [c for c in new if not self.words and (c[0] == START or c[0] == "\n" or c.isspace())]
        new.difference_update(special)
        for c in special:  # white space, and words at the start of a text, which bear a mark, or of a line
            self[c] = self._encode(c) if c.isspace() else (self.line_end if c[0] == "\n" else b"") + self._bare(c[1:])
        self._learn(list(new))
        self.update((c, self[c[:-1]] + self.stops[c[-1]]) for c in stopped)
        for k in unseen:
            found[k] = self[flat[k]]
        for c in new.union(stopped, special):
            if len(c) > self.KEPT_LENGTH:
                self.pop(c, None)
        return [self._encode(x) if w else b"".join(found[a:b]) for x, w, a, b in zip(texts, whole, [0, *ends], ends)]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
