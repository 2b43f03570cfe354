"""Token ids of whole texts inside tasks.

The tokenizer of `default_tokenizer` drops white space and never joins what it separates, so a text is
the sequence of its white-space separated chunks. A file whose normalizer and word pattern are not
those below goes through the library, whole texts at a time. Ids of chunks and of the words inside them come from tables of bounded
size; a new word goes through the library's model. Chunks with anything but ASCII signs and Latin
letters go through the whole library, which normalises them.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Entries of the two tables per Python worker, and the longest entry that is kept, in bytes.
KEPT_CHUNKS, KEPT_WORDS, KEPT_BYTES = 500_000, 1_000_000, 40
#: The id written after each document.
END_ID = 2

_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed by the tokenizer file: how a chunk falls into words, and the letters that stand for bytes.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """`encode` equals the library's ids of the whole text, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_chunks = _known(json.loads(self.tokenizer.to_str()))
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word if word.isascii() else "".join(_LETTER[b] for b in word.encode())
            ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.words) < KEPT_WORDS and len(word) <= KEPT_BYTES:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._word, _WORDS.findall(text.lower())))

    def encode(self, data: bytes) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not self.by_chunks:
            return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        chunks, known = data.split(), self.chunks
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        out = []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if len(known) < KEPT_CHUNKS and len(chunk) <= KEPT_BYTES:
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)


def _known(file: dict) -> bool:
    """Whether a text's chunks can be encoded on their own, in the way of this module."""
    steps = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    return (
        (file.get("normalizer") or {}).get("normalizers") == _NORMALIZER
        and steps[0] == split
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex")
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and file."""
    return ChunkEncoder(path)
