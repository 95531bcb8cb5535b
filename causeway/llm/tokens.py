"""Token ids of whole texts by the tokenizers library, each distinct stretch of text encoded once."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Stretches of text, of 64 characters at most, in each of two generations that a worker process keeps; about 200 bytes each.
MOST_KEPT = 300_000
#: A byte-level BPE pre-tokenizer always cuts before white space that follows anything
#: else, and between letters and a full stop or comma that ends a word.
_STRETCH = re.compile(
    "[ \n]*[A-Za-zÀ-ÖØ-öø-ɏ]+(?![^ \n.,])|[.,]+(?![^ \n])|[ \n]*[^ \n]+|[ \n]+"
)
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: A full stop or comma after anything but a letter or digit may belong to what stands before it.
_JOINED = re.compile("[^A-Za-z0-9À-ÖØ-öø-ɏ][.,]")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stretches(text: str) -> list[str]:
    """Parts of a text whose ids, put together, are the ids of the text."""
    return [text] if _OTHER_SPACE.search(text) else _STRETCH.findall(text)


def plain_words(text: str) -> list[str] | None:
    """Parts of a text with plain spacing, None of any other text.

    They begin at single spaces (left off), line breaks, and full stops and commas after
    a letter or digit; the first is marked by a carriage return, which such a text has not.
    """
    odd = not text or text[0] in " \n.," or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n"))
    if odd or _OTHER_SPACE.search(text) or _JOINED.search(text):
        return None
    words = text.replace("\n", " \n").replace(".", " .").replace(",", " ,").split(" ")
    words[0] = "\r" + words[0]
    return words


class _Kept(dict):
    """Ids by part of a text; what is missing comes from the older generation or is encoded."""

    def __init__(self, encode, old):
        self.encode, self.old = encode, old

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = array("I", self.encode(part)).tobytes()
        if len(part) <= 64:
            self[part] = ids
        return ids


class Encoder:
    """Ids of texts by a tokenizer file. Each distinct word is encoded once while it is kept;
    a word of letters alone is one pre-token, so it goes straight to the BPE model."""

    def __init__(self, path: str, most_kept: int = MOST_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most_kept = Tokenizer.from_file(path), most_kept
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(hidden)})
        self.rest()

    def rest(self) -> None:
        """Keep nothing."""
        self.words, self.parts = _Kept(self.word, {}), _Kept(self.whole, {})

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        if word.isalpha():
            return [t.id for t in self.model.tokenize(f" {word}".encode().decode("latin-1").translate(self.letters))]
        return self.whole(word[1:] if word[:1] == "\r" else word if word[:1] in ("\n", ".", ",") else f" {word}")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            words = plain_words(text)
            out.append(b"".join(map(self.words.__getitem__, words) if words else map(self.parts.__getitem__, stretches(text))))
        if len(self.words) > self.most_kept:
            self.words = _Kept(self.word, dict(self.words))
        if len(self.parts) > self.most_kept // 4:
            self.parts = _Kept(self.whole, dict(self.parts))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, most_kept: int = MOST_KEPT) -> Encoder:
    return Encoder(path, most_kept)


def grouped(texts: list[str], most_chars: int = 1 << 19):
    """(place of the first, texts) in groups of bounded size."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most_chars:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]
