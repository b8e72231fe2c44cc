"""Token ids of whole texts with a public tokenizer, word by word.

``word_bpe_49k`` drops white space and never joins characters across it, so a
text's ids are those of its space-separated words in order. Words repeat, so
each Python worker keeps the ids of words it has met in a dictionary, emptied
when it passes ``CACHE_WORDS`` entries or ``CACHE_CHARS`` characters, or when
another step's task needs the room (:func:`llm.common.lean_worker`). A new
word is taken apart as the tokenizer's own first steps would do it (trailing
punctuation is a piece of its own; ASCII letters count in lower case), and
what is then left is encoded by the library. ``tests/llm`` compares this with
encoding whole texts; a tokenizer with other first steps gets whole texts.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator

import public_tokenizers

from llm.common import kept_in_worker

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CACHE_WORDS = 600_000
CACHE_CHARS = 24_000_000
#: Code points below this have no decompositions that NFC would put together
#: anew, so a lower-case word of them passes the normalizer unchanged.
PLAIN_BELOW = "ɐ"


class _Words(dict):
    """Ids of words, as bytes; a word not met yet is encoded on access."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = tokenizer
        self.tokenize = tokenizer.model.tokenize
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.chars = 0

    def forget(self) -> None:
        self.clear()
        self.chars = 0

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?")
        if core != word and core and core[-1] < PLAIN_BELOW and core[-1].lower().isalpha():
            ids = self[core] + self[word[len(core):]]
        elif word.isascii() and (low := word.lower()) != word:
            ids = self[low]
        elif word.isalpha() and word == word.lower() and max(word) < PLAIN_BELOW:
            piece = word if word.isascii() else self.as_bytes(word)[0][0]
            ids = array("I", [t.id for t in self.tokenize(piece)]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        self.chars += len(word)
        return ids


_loaded: dict[str, tuple] = {}


def _load(path: str) -> tuple:
    """The tokenizer, and its words if it goes word by word."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _loaded[path] = tokenizer, _Words(tokenizer) if _by_words(tokenizer) else None
    return _loaded[path]


@kept_in_worker
def forget_words() -> None:
    for _, words in _loaded.values():
        if words is not None:
            words.forget()


def _by_words(tokenizer) -> bool:
    """Whether the tokenizer's first steps are those this module relies on."""
    c = json.loads(tokenizer.to_str())
    first = [s["type"] for s in (c["normalizer"] or {}).get("normalizers", [])]
    then = (c["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (first == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in then] == ["Split", "ByteLevel"]
            and r"[^\s\p{L}\p{N}]+" in then[0]["pattern"].get("Regex", "")
            and then[0]["invert"] and not then[1]["use_regex"]
            and not any(a["lstrip"] or a["rstrip"] for a in c["added_tokens"])
            and c["truncation"] is None and c["padding"] is None)


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts."""

    def __init__(self, path: str | None = None, end_id: int = END_ID):
        self.tokenizer, self.words = _load(path or tokenizer_path())
        self.end = array("I", [end_id]).tobytes()

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text with the end id appended, as little-endian
        unsigned 32-bit integers. An empty text gives the end id alone."""
        words = self.words
        for text in texts:
            if words is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                yield array("I", ids).tobytes() + self.end
                continue
            if len(words) > CACHE_WORDS or words.chars > CACHE_CHARS:
                words.forget()
            text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            yield b"".join(map(words.__getitem__, text.split(" "))) + self.end
