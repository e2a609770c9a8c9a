"""Splitting of whole texts into pre-tokens exactly as a tokenizer library does.

The `regex` module knows a newer Unicode version than the tokenizer libraries. Characters that a library classes
differently are replaced, for the split only, by a character of the class the library gives them; the pre-tokens are
then cut from the original text. Below U+0530 all versions agree.

Where every blank stands between two characters that are not white space, no pre-token of these patterns reaches over a
blank except by beginning with it. Such texts are cut at blanks, and the work on a word is done once per distinct word.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

AGREED_BELOW = "԰"
#: A letter, a digit, a sign: a character is of the class of that one to which the library joins it.
CLASS_MARKS = "a1!"


class Splitter:
    """Callable that gives the pre-tokens of a text; `library_class` tells the mark of a character's class, or a blank."""

    def __init__(self, pattern: str, library_class: Callable[[str], str]):
        self.pattern = regex.compile(pattern)
        self.library_class = library_class
        self.changed: dict[str, str] = {}
        self.blank_run = regex.compile(r" \s|\s ")

    def own_class(self, char: str) -> str:
        return next((m for m in CLASS_MARKS if len(self.pattern.findall(m + char)) == 1), " ")

    def replacement(self, char: str) -> str:
        if char not in self.changed:
            wanted = self.library_class(char)
            self.changed[char] = char if wanted == self.own_class(char) else wanted
        return self.changed[char]

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or max(text) < AGREED_BELOW:
            return self.pattern.findall(text)
        swaps = {ord(c): r for c in set(text) if c >= AGREED_BELOW and (r := self.replacement(c)) != c}
        if not swaps:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(swaps))]

    def behind_blank(self, words: list[str]) -> tuple[list[str], list[str], list[int]]:
        """Some words, as `words` cuts them, in another order; the pre-tokens of each with the blank before it, one after another; and
        where each one's begin. They are split as one text, but for those that are empty or end with white space, which would
        reach over the next blank."""
        joined = [w for w in words if w and not w[-1].isspace()]
        single = [w for w in words if not w or w[-1].isspace()]
        pieces = self(" " + " ".join(joined)) if joined else []
        begins = [i for i, p in enumerate(pieces) if p[0] == " "]
        if len(begins) != len(joined):  # a pattern that takes no blank to the word behind it
            joined, single, pieces, begins = [], words, [], []
        for word in single:
            begins.append(len(pieces))
            pieces += self(" " + word)
        return joined + single, pieces, begins

    def words(self, text: str) -> list[str]:
        """The text cut at its blanks: the first part stands alone, the others follow a blank. One part only if some blank
        stands beside other white space."""
        return [text] if self.blank_run.search(text) else text.split(" ")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    places = {b: 256 + i for i, b in enumerate(others)}
    return [chr(places.get(b, b)) for b in range(256)]
