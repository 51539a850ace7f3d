"""Words of a text for comparisons in which only the wording counts."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

from chronoloom.llm.skeleton import skeleton

WORD = re.compile(r"[^\W_]+")
#: Tags of entity markers ([E1], </head>) and of markup (<b>, </p>, &nbsp;).
TAGS = re.compile(r"[\[<]/?[A-Za-z]\w{0,11}[\]>]|</?[A-Za-z][^<>\n]{0,200}>|&#?\w{1,8};")
MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


#: Signs inside a number: 37.2 and v5.15.9 are one word, as they are once the signs are lost.
IN_NUMBER = re.compile(r"(?<=\d)[.,](?=\d)")


def folded(text: str | None, tags: bool = True) -> list[str]:
    """Lower-case words without accents, punctuation, markup and invisible characters; look-alikes and widths are one.

    Null, empty and wordless texts give no words.
    """
    if not text:
        return []
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", skeleton(text)))
    if tags and ("<" in text or "[" in text or "&" in text):
        text = TAGS.sub(" ", text)
    return WORD.findall(IN_NUMBER.sub("", text).casefold())


class WordHashes(dict):
    """64-bit hashes of words, kept per worker; emptied when large, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))
