"""Token ids of whole texts by a public tokenizer file, with words kept once encoded.

For vocabularies that drop white space (`word_bpe_49k.json`), a text's ids are those of its
blank-separated chunks in a row, so chunks are looked up; new ones are cut by the tokenizer's own
pattern and only unseen word parts go through its merges. Whatever the short cut does not surely
cover (unusual letters, other white space, special tokens, another kind of file) goes through the
tokenizer itself.
Nothing is loaded before a worker encodes its first text.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are worked on at once.
AT_ONCE = 8_000_000
#: The pattern by which word_bpe_49k.json cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[!-&(-/:-@\[-`{-~¡-©«-¬®-±´¶-¸»¿×÷']+")
_PLAIN = re.compile(r"[!-~¡-¬®-ÿ]+")


_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def _byte_letters() -> dict[int, str]:
    """For letters up to U+00FF, the printable letters that stand for their UTF-8 bytes in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown}
    letter |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, 256)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else np.array(ids, dtype="<u4").tobytes()


def _halved(kept: dict, most: int) -> None:
    if len(kept) > most:
        for k in list(islice(kept, len(kept) // 2)):
            del kept[k]


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit bytes; `path` names the file.

    Of words, and of word parts, at most so many are kept; then the older half goes.
    """

    def __init__(self, path: str, most_words: int = 800_000, most_parts: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        cut = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [n.get("type") for n in (kind.get("normalizer") or {}).get("normalizers", [])]
        self.short_cut = (cut[0].get("pattern") or {}).get("Regex") == PATTERN and norm == ["NFC", "Replace", "Lowercase"] and kind["model"].get("end_of_word_suffix") == "</w>"
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.bare = Tokenizer(self.whole.model)
        self.letters = _byte_letters()
        # Known chunks as one Arrow array, and their ids in a row: a few dozen bytes a chunk.
        self.words = pa.array([], pa.large_string())
        self.flat, self.size = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        self.parts: dict[str, bytes] = {}
        self.most_words, self.most_parts = most_words, most_parts

    def _plain(self, texts: Sequence[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.whole.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        cut: list[tuple[str, list[str] | None]] = []
        for w in words:
            if _PLAIN.fullmatch(w):
                low = w.lower()
                parts = _PARTS.findall(low)
                cut.append((w, parts if sum(map(len, parts)) == len(low) else None))
            else:
                cut.append((w, None))
        new = list({p for _, ps in cut if ps for p in ps if p not in self.parts})
        for p, e in zip(new, self.bare.encode_batch_fast([p.translate(self.letters) for p in new], add_special_tokens=False), strict=True):
            self.parts[p] = _packed(e.ids)
        known = self.parts
        return [self._plain([w])[0] if ps is None else b"".join([known[p] for p in ps]) for w, ps in cut]

    def _known(self, chunks: pa.Array) -> np.ndarray:
        """Where each of different chunks is among the known ones; those that are not are learned."""
        if len(self.words) > self.most_words:
            half = len(self.words) // 2
            self.words, self.size = pa.concat_arrays([self.words.slice(half)]), self.size[half:]
            self.flat = self.flat[-int(self.size.sum()) :].copy()
        at = pc.index_in(chunks, value_set=self.words)
        if at.null_count:
            new = chunks.filter(pc.is_null(at))
            ids = self._learn(new.to_pylist())
            place = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
            place[place < 0] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.size = np.concatenate([self.size, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), dtype="<u4")])
            return place
        return at.to_numpy(zero_copy_only=False)

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """Works on some texts at a time, so that what it keeps stays small."""
        out: list[bytes] = []
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the words kept are many
        try:
            start, held = 0, 0
            for k, t in enumerate(texts):
                if held and held + len(t) > AT_ONCE:
                    out += self._some(texts[start:k])
                    start, held = k, 0
                held += len(t)
            if start < len(texts):
                out += self._some(texts[start:])
        finally:
            if collects:
                gc.enable()
        return out

    def _some(self, texts: Sequence[str]) -> list[bytes]:
        """Chunks are told apart once for all texts; their ids are gathered from those of the different ones."""
        if not self.short_cut:
            return self._plain(texts)
        _halved(self.parts, self.most_parts)
        odd = [any(s in t for s in self.special) for t in texts]
        lists = pc.ascii_split_whitespace(pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        at = self._known(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, dtype=np.int64)
        size, flat, first = self.size, self.flat, np.cumsum(self.size) - self.size
        n = size[at]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - (ends - n), n)]
        cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return [self._plain([t])[0] if o else ids[a:b].tobytes() for t, o, a, b in zip(texts, odd, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
