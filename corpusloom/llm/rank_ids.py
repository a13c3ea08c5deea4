r"""Token ids of whole texts by a file of ranks, as arrays, with a pattern that needs no look ahead.

PATTERN's `\s+(?!\S)` leaves the last blank of a run to the word that follows. It is the one part
that an automaton cannot decide, so the whole pattern is matched by going back and forth, which
fails on runs of more than a million blanks. Texts are therefore cut before the last blank of
every run of two or more that something follows; within the parts `\s+` takes the same runs, and
no piece of PATTERN goes over a cut, as only a piece's first character is ever a blank before
others. Where cuts are close together and runs short, and with other patterns, the tokenizer works
on the whole text as it is.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.llm.lengths import rank_encoder, read_ranks

_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
PATTERN = _WORDS + r"|\s+(?!\S)|\s+"
#: What `\s` is to the tokenizer (White_Space), as characters: both engines below read them alike.
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(_BLANK + "{2,}")
#: With a special token, texts that are searched for one are searched for a fixed string; it is never allowed.
_SPECIAL = "<|none|>"
#: Parts of fewer characters on average cost more than the look ahead, which is sure to work on shorter runs than LONG.
CLOSE, LONG = 32, 10_000


def blank_runs(texts: pa.Array) -> list[bool]:
    """Which texts hold two blanks in a row."""
    return pc.match_substring_regex(texts, _BLANK + _BLANK).fill_null(False).to_pylist()


class RankIds:
    def __init__(self, path: str, pattern: str):
        self.tokenizer = path, pattern
        self.short_cut = None
        if pattern == PATTERN:
            import tiktoken

            ranks = read_ranks(path)
            self.short_cut = tiktoken.Encoding("parts", pat_str=_WORDS + r"|\s+", mergeable_ranks=ranks, special_tokens={_SPECIAL: max(ranks.values()) + 1})

    def _part(self, text: str) -> np.ndarray:
        return self.short_cut.encode_to_numpy(text, disallowed_special=())

    def ids(self, text: str, runs: bool = True) -> np.ndarray:
        """`runs` may be false for a text without two blanks in a row."""
        if not text:
            return np.empty(0, dtype=np.uint32)
        found = [m.span() for m in _RUN.finditer(text)] if runs and self.short_cut else []
        cuts = [b - 1 for _, b in found if b < len(text)]
        if self.short_cut is None or (CLOSE * len(cuts) > len(text) and all(b - a < LONG for a, b in found)):
            return np.array(rank_encoder(*self.tokenizer).encode_ordinary(text), dtype=np.uint32)
        if not cuts:
            return self._part(text)
        return np.concatenate([self._part(text[a:b]) for a, b in pairwise([0, *cuts, len(text)])])


_LOADED: dict[tuple[str, str], RankIds] = {}


def rank_ids(path: str, pattern: str) -> RankIds:
    """One for each file, pattern and process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankIds(path, pattern)
    return _LOADED[path, pattern]
