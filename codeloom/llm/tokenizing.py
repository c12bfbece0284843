"""Encoding of whole texts with a public tokenizer, one cache of encoded words per worker."""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np

#: The cache is emptied when it holds so many words; this bounds a worker's memory.
MAX_CACHED = 450_000
#: ASCII marks that the pre-tokenizer keeps in one piece apart from letters; no apostrophe, which may join letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

# The front of the tokenizer for which texts may be cut at white space and plain words sent to the model.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_space(settings: dict) -> bool:
    """Whether a tokenizer file's front is the known one: white space ends pieces and is dropped, letters are lowered."""
    normal, before = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    steps, parts = normal.get("normalizers") or [], before.get("pretokenizers") or []
    return (
        [x.get("type") for x in steps] == NORMALIZERS
        and steps[1].get("pattern") == {"Regex": r"\s+"}
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and (parts[0]["pattern"], parts[0]["behavior"], parts[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        and settings.get("post_processor") is None
        and all(x["content"].startswith("<|") for x in settings.get("added_tokens") or ())
    )


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level tokenizers: printable Latin-1 for itself, others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Encodes UTF-8 texts to token ids, identically to the tokenizer on the whole text.

    Of a tokenizer that never joins characters over white space, such as ``word_bpe_49k.json``,
    the ids of a text are those of its pieces between
    ASCII white space, one after the other, and frequent pieces are encoded once. The tokenizer's file tells whether it is
    one of these (``splits_at_space``); others get every text as a whole.
    """

    def __init__(self, path: str, max_cached: int = MAX_CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.in_pieces = splits_at_space(json.loads(self.tokenizer.to_str()))
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.max_cached, self.cache = max_cached, {}

    def _ids(self, word: str) -> list[int]:
        """Plain words, in lower case with marks behind, go straight to the tokenizer's model; others all the way."""
        core = word.rstrip(MARKS)
        if not core or core.isalpha() and core == core.lower() and unicodedata.is_normalized("NFC", core):
            pieces = [p for p in (core, word[len(core) :]) if p]
            return [t.id for p in pieces for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.alphabet))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, new: set[bytes], words: list[bytes]) -> None:
        if len(self.cache) + len(new) > self.max_cached:
            self.cache.clear()
            new = set(words)
        for w in new:
            self.cache[w] = array(self.code, self._ids(w.decode("utf-8", "replace"))).tobytes()

    def encode(self, text: bytes | None) -> bytes:
        """The ids as little-endian integers of ``self.dtype``; null counts as empty."""
        text = text or b""
        if not self.in_pieces:
            return array(self.code, self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        # ASCII letters are lowered by the tokenizer too, but not in the name of a special token.
        words = (text if b"<|" in text else text.lower()).split()
        if new := set(words).difference(self.cache):
            self._learn(new, words)
        return b"".join(map(self.cache.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
