"""Names in texts: one automaton finds all names of a set in one pass over a text."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Hashable, Iterable

import ahocorasick


class _Folds(dict):
    """Case folding of single characters, so that places in a text stay as they are."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = ord(next((f for f in (c.casefold(), c.lower()) if len(f) == 1), c))
        return self[code]


_FOLDS = _Folds()


def fold(text: str) -> str:
    """The text in one case, character by character."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def is_letter(c: str) -> bool:
    """Whether a character is a letter or a number."""
    return c.isalnum() if c.isascii() else unicodedata.category(c)[0] in "LN"


class Names:
    """Names of brands, in an automaton of all of them: what a pass over a text costs doesn't depend on their number."""

    def __init__(self, names: Iterable[tuple[Hashable, str | None]]):
        owners: dict[str, set] = defaultdict(set)
        for brand, name in names:
            if name:
                owners[fold(name)].add(brand)
        self._found = ahocorasick.Automaton()
        for name, brands in owners.items():
            self._found.add_word(name, (len(name), tuple(brands)))
        self._any = bool(owners)
        if owners:
            self._found.make_automaton()

    def first_places(self, text: str | None) -> dict[Hashable, int]:
        """The first place of each brand's names that no letter or digit adjoins, whatever their case. Brands without one aren't there."""
        out: dict[Hashable, int] = {}
        if not text or not self._any:
            return out
        for end, (size, brands) in self._found.iter(fold(text)):
            low = end - size + 1
            if (low and is_letter(text[low - 1])) or (end + 1 < len(text) and is_letter(text[end + 1])):
                continue
            for brand in brands:
                if out.get(brand, len(text)) > low:
                    out[brand] = low
        return out
