"""Exact ids of a word-level BPE tokenizer file, at a rate a corpus needs.

The tokenizers library reads the file and is the reference. Files of the form this module knows
(NFC, white space and lower-case normalisation, a letter/number/other split, byte-level symbols
with an end-of-word suffix, ids in merge order) take a faster way to the same ids: words are split
by ``re``, looked up in a bounded cache, and unknown ones are merged by tiktoken with the suffix
written as one marker byte. That way is open to texts of Latin-1 characters without unusual
controls; every other text, and every other file, goes through the library itself.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np

MARK = "\x00"
CACHE = 300_000
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: letters first: the branches that begin with an apostrophe match nothing that begins with a letter
_WORD = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^\t-\r \x85\xa0{_LETTER}{_NUMBER}]+")
#: characters outside the fast way: all above Latin-1, and controls but for plain white space
_ODD = re.compile("[^\t-\r -~\xa0-\xff]")


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level BPE files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.special = tuple(t["content"] for t in spec.get("added_tokens") or ())
        self.cache: dict[str, bytes] = {}
        self.fast = self._fast_encoder(spec)

    def _fast_encoder(self, spec: dict):
        try:
            kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
            pre = spec["pre_tokenizer"]["pretokenizers"]
            model = spec["model"]
            known = kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": SPLIT} and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"]
        except (KeyError, TypeError):
            return None
        if not known:
            return None
        import tiktoken

        back = {s: b for b, s in byte_symbols().items()}
        vocab = model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(back[c] for c in (token[:-4] if end else token)) + MARK.encode() * end

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(vocab) - len(pairs)
        if any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(pairs)):
            return None  # ids are not in merge order
        ranks: dict[bytes, int] = {}
        for token, i in vocab.items():
            if token not in self.special:
                ranks[raw(token)] = i
        ranks[MARK.encode()] = len(vocab) + 10  # never left alone: every symbol joins the mark first
        self.ends = np.zeros(len(vocab) + 11, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        return tiktoken.Encoding("word_bpe", pat_str=f"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: empty)."""
        out: list[bytes | None] = [None] * len(texts)
        slow, split, new = [], [], set()
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
            elif self.fast is None or _ODD.search(t) or any(x in t for x in self.special):
                slow.append(i)
            else:
                w = _WORD.findall(t.lower())
                split.append((i, w))
                new.update(w)
        if words := list(new.difference(cache)):
            ids = np.array(self.fast.encode_ordinary(MARK.join(words) + MARK), np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(words):
                raise AssertionError("a word's end was lost")
            data = ids.tobytes()
            ends = (cut * 4).tolist()
            cache.update(zip(words, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        get = cache.__getitem__
        for i, w in split:
            out[i] = b"".join(map(get, w))
        if slow:
            for i, e in zip(slow, self.slow.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out


