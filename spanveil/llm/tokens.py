"""Token ids of whole texts by a public tokenizer of words."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Pieces whose ids a worker remembers; each takes about 170 bytes.
PIECES = 1_500_000
#: Pieces handed to the tokenizer as one text.
RUN = 64

#: Small letters, and numbers, below U+0250. What else is there is neither.
_LETTERS, _NUMBERS, _BLANKS = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾", r" \t-\r\x85\xa0"
#: Texts below U+0250 that a tokenizer of words parts as below once they are small. The
#: capital I with a dot becomes two characters; `<|` may begin a special token.
_UNUSUAL = re.compile("[^\x00-ɏ]|İ|<\\|")
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
)
_BLANK_SEPARATED = re.compile(r"[^ \t-\r]+")


class WordTokenizer:
    """Ids of texts by a tokenizer file that makes texts small and parts them into words.

    Words repeat, so the ids of each are kept. Texts with other than Latin letters are parted at
    white space only, over which no token of such a file reaches.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        suffix = json.loads(Path(path).read_text())["model"].get("end_of_word_suffix")
        ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if suffix:
            ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        #: Which ids end a word, if the vocabulary marks them.
        self.ends = ends if suffix else None

    @staticmethod
    def _split(text: str | None) -> list[str]:
        if not text:
            return []
        # Some letters leave the range, and some enter it, when they are made small.
        small = text.lower()
        if _UNUSUAL.search(text) or _UNUSUAL.search(small):
            return _BLANK_SEPARATED.findall(text)
        return _PIECES.findall(small)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4") for one in found]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces; words of letters go together, cut where the vocabulary ends words."""
        plain = [p for p in pieces if self.ends is not None and p.isalpha()]
        for start in range(0, len(plain), RUN * 256):
            some = plain[start : start + RUN * 256]
            runs = [some[k : k + RUN] for k in range(0, len(some), RUN)]
            for run, ids in zip(runs, self._ids([" ".join(r) for r in runs]), strict=True):
                cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
                if len(cuts) == len(run) + 1:
                    data = ids.tobytes()
                    parts = [data[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
                else:
                    parts = [x.tobytes() for x in self._ids(run)]
                self.known.update(zip(run, parts, strict=True))
        odd = [p for p in pieces if self.ends is None or not p.isalpha()]
        self.known.update((p, x.tobytes()) for p, x in zip(odd, self._ids(odd), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self._split(text) for text in texts]
        distinct = set().union(*split) if split else set()
        if len(self.known) + len(distinct) > PIECES:
            self.known.clear()
        known = self.known
        self._learn([piece for piece in distinct if piece not in known])
        get = known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, once for each Python worker."""
    return WordTokenizer(path)
