"""Splitting of texts before byte-pair merging."""

from __future__ import annotations

import re
from functools import cache, reduce
from itertools import batched

import regex

#: Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are split as a stream, so that no list of all pieces is held.
LONG = 1 << 20


#: Texts with characters beyond the basic plane are split by ``regex`` itself.
_BEYOND = re.compile("[\U00010000-\U0010ffff]").search
_CLASSES = (r"\p{L}", r"\p{N}", r"\s")


@cache
def _ranges(name: str) -> str:
    """The basic plane's characters of a class, as the inside of a bracket expression of ``re``."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{name}+", every))


def narrow(pattern: str):
    """The pattern for ``re``, with its classes spelled out for the basic plane;
    None if it has other escapes or groups' flags.  ``re`` splits such texts in
    half of the time that ``regex`` takes."""
    rest = pattern
    for name in (*_CLASSES, r"\S"):
        rest = rest.replace(name, "x")
    if "\\" in rest or regex.search(r"\(\?[^!=:]", rest) or regex.search(r"[+*?}]\+", rest):
        return None
    out = regex.sub(r"\[[^\]]*\]", lambda m: reduce(lambda x, name: x.replace(name, _ranges(name)), _CLASSES, m[0]), pattern)
    for name in _CLASSES:
        out = out.replace(name, f"[{_ranges(name)}]")
    return re.compile(out.replace(r"\S", f"[^{_ranges(_CLASSES[2])}]"))


def splitter(pattern: str = PATTERN):
    """text -> iterator over lists of pieces; the lists' concatenation is the whole text's split."""
    wide = regex.compile(pattern)
    basic = narrow(pattern) or wide

    def split(text: str):
        compiled = wide if _BEYOND(text) else basic
        if len(text) <= LONG:
            yield compiled.findall(text)
        else:
            for some in batched((m.group() for m in compiled.finditer(text)), 1 << 16):
                yield list(some)

    return split


class Memo(dict):
    """piece -> value of ``make(piece)``.  Two generations of ``most`` entries:
    a full one becomes the old one, and what is used again moves back.  Pieces
    of over ``longest`` characters are not kept."""

    def __init__(self, make, most: int = 300_000, longest: int = 64):
        super().__init__()
        self._make, self._most, self._longest, self._old = make, most, longest, {}

    def __missing__(self, piece):
        value = self._old.get(piece)
        if value is None:
            value = self._make(piece)
        if len(piece) <= self._longest:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[piece] = value
        return value
