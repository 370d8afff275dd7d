"""Token ids of whole texts from a tokenizers vocabulary, with a bounded memo of words."""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache


def default_tokenizer() -> str:
    """Path of the vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Ids of words, found when first asked for; at most ``cap`` are kept."""

    def __init__(self, tokenizer, cap: int):
        super().__init__()
        self.tokenizer, self.merges, self.cap = tokenizer, tokenizer.model.tokenize, cap

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word.islower() and max(word) <= "\u00ff":
            seen = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = [t.id for t in self.merges(seen)]
        elif (core := word.rstrip("!#$%&*,.:;?|")) != word and core.isalpha() and core.islower() and max(core) <= "\u00ff":
            return self[core] + self[word[len(core) :]]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.cap:
            self.clear()
        self[word] = got
        return got


#: A comma or stop after another mark: the two are one word of the vocabulary's splitter, which takes
#: the separators U+001C to U+001F for marks.
_MARKS = re.compile("[^\\w\\s][.,]|[_\x1c-\x1f][.,]")
#: Normaliser and splitter that encoding word by word stands for (fixed values of the vocabulary's format).
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def is_by_words(tokenizer) -> bool:
    """Whether the vocabulary normalises and splits as encoding word by word needs."""
    state = json.loads(tokenizer.to_str())
    parts = [(state.get("normalizer") or {}).get("normalizers"), (state.get("pre_tokenizer") or {}).get("pretokenizers")]
    return parts == [_NORMALIZER, _SPLITTER] and not state["model"].get("continuing_subword_prefix")


class WordEncoder:
    """Encodes texts word by word.

    For a vocabulary in lower case that drops white space and never merges over it, the ids of a text
    are those of its space-separated words in a row; a comma or stop after a letter or digit is a word
    of its own. So a memo of words, bounded by ``cap``, saves most of the merging. Words of lower-case
    Latin letters go straight to the vocabulary's merges, all others through the whole tokenizer. Texts
    of any other vocabulary go through the whole tokenizer as they are. Ids come as bytes of
    little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str, cap: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = _Words(self.tokenizer, cap) if is_by_words(self.tokenizer) else None

    def encode_one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.memo is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            if not _MARKS.search(text):
                text = text.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        words = text.replace("\n", " ").split(" ")
        return b"".join(map(self.memo.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept over tasks."""
    return WordEncoder(path)
