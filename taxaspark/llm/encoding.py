"""Texts to token ids inside tasks: the tokenizers library, asked once for each distinct word."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import numpy as np

ODD_SPACE = re.compile(r"[^\S \n]")
#: Pieces that a worker remembers, at most, and their longest length: some 250 MB in all.
REMEMBERED, LONGEST = 1_000_000, 40
#: What stands between new pieces that the library gets as one text, and how many those are.
BREAK, TOGETHER = "\x01", 32


class WordEncoder:
    """Encodes whole texts with a tokenizer file; ids come back as little-endian unsigned 32-bit bytes.

    Both vocabularies used here split a text into words before they merge, and no word reaches across a single space or
    line break between two other characters. So a text is cut there and each distinct piece is encoded once and, if
    short, remembered, up to ``limit`` pieces. A text with any other run of white space, or with the string of one of
    the vocabulary's special tokens, goes to the library as a whole. ``space_joins``: the space before a word, or the
    line break, belongs to its ids (byte-level vocabularies).
    """

    def __init__(self, path: str, space_joins: bool, limit: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        self.space_joins, self.limit, self.memo = space_joins, limit, {}
        stop = self.tokenizer.encode(BREAK, add_special_tokens=False).ids
        self.stop = stop[0] if len(stop) == 1 and not space_joins else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _as_found(self, piece: str) -> str:
        return " " + piece if self.space_joins and piece[:1] != "\n" else piece

    def _new(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that aren't remembered, ``TOGETHER`` to a text where a break between them has an id of its own."""
        if self.stop is None or any(BREAK in x for x in pieces):
            return self._whole([self._as_found(x) for x in pieces])
        out = []
        for e in self.tokenizer.encode_batch_fast([f" {BREAK} ".join(pieces[i : i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)], add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            ends, raw = (4 * np.flatnonzero(ids == self.stop)).tolist(), ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)])]
        return out

    def _pieces(self, text: str) -> list[str] | None:
        if self.space_joins and ("  " in text or " \n" in text or "\n " in text or "\n\n" in text) or self.special and self.special.search(text):
            return None
        return text.replace("\n", " \n").split(" ") if self.space_joins else text.replace("\n", " ").split(" ")

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text. A piece is looked up once; its white space is looked at only where it is new."""
        texts, get = list(texts), self.memo.get
        pieces = [self._pieces(t) for t in texts]
        heads = [None] * len(texts)
        if self.space_joins:  # what no space is before
            heads = [p and p[0] for p in pieces]
            pieces = [p and p[1:] for p in pieces]
        found = [p and list(map(get, p)) for p in pieces]
        missing = [[i for i, x in enumerate(f) if x is None] if f else [] for f in found]
        wanted = {p[i] for p, m in zip(pieces, missing) for i in m}
        odd = {x for x in wanted if ODD_SPACE.search(x)}
        whole = [p is None or bool(h and ODD_SPACE.search(h)) or bool(odd) and any(p[i] in odd for i in m) for p, h, m in zip(pieces, heads, missing)]
        new, fresh = list(wanted - odd), {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            fresh.update(zip(part, self._new(part)))
        first = iter(self._whole([h for h, w in zip(heads, whole) if h is not None and not w]))
        rest = iter(self._whole([t for t, w in zip(texts, whole) if w]))
        out = []
        for p, f, m, h, w in zip(pieces, found, missing, heads, whole):
            if w:
                out.append(next(rest))
                continue
            for i in m:
                f[i] = fresh[p[i]]
            out.append(b"".join(f if h is None else [next(first), *f]))
        self.memo.update(islice(((x, v) for x, v in fresh.items() if len(x) <= LONGEST), max(0, self.limit - len(self.memo))))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, space_joins: bool) -> WordEncoder:
    """The worker process's encoder for a file; it serves later tasks too, until ``release_memory`` drops it."""
    return WordEncoder(path, space_joins)


def batches_of(texts: list[str], rows: int = 500, size: int = 1 << 22) -> Iterable[tuple[int, int]]:
    """(begin, end) of runs of ``texts`` with at most ``rows`` texts, and ``size`` characters or one text."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (i - begin >= rows or held + len(t) > size):
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if texts:
        yield begin, len(texts)
