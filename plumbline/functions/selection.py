"""Selections: rules that pick names out of a list of names."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from plumbline.errors import EngineError

Pick = Callable[[Sequence[str]], list[str]]


@dataclass(frozen=True)
class Selection:
    pick: Pick
    negative: bool = False

    def __neg__(self) -> Selection:
        return Selection(self.pick, not self.negative)


def _by(test: Callable[[str], bool]) -> Selection:
    return Selection(lambda names: [n for n in names if test(n)])


def starts_with(*prefixes: str) -> Selection:
    return _by(lambda n: n.lower().startswith(tuple(p.lower() for p in prefixes)))


def ends_with(*suffixes: str) -> Selection:
    return _by(lambda n: n.lower().endswith(tuple(s.lower() for s in suffixes)))


def contains(*parts: str) -> Selection:
    return _by(lambda n: any(p.lower() in n.lower() for p in parts))


def matches(pattern: str) -> Selection:
    return _by(lambda n: re.search(pattern, n, re.IGNORECASE) is not None)


def everything() -> Selection:
    return Selection(list)


def all_of(wanted: Sequence[str]) -> Selection:
    """Exactly these names; a missing one is an error."""
    return Selection(lambda names: [_known(w, names) for w in wanted])


def between(first: str | int, last: str | int) -> Selection:
    """The names from one to another, by their places; backwards if the first comes later."""

    def pick(names: Sequence[str]) -> list[str]:
        a, b = (names.index(_named(x, names)) for x in (first, last))
        return list(names[a : b + 1]) if a <= b else list(names[b : a + 1])[::-1]

    return Selection(pick)


def exclude(*wanted: str | int | Selection) -> Selection:
    return Selection(lambda names: [n for w in wanted for n in (w.pick(names) if isinstance(w, Selection) else [_named(w, names)])], True)


def _known(name: str, names: Sequence[str]) -> str:
    if name not in names:
        raise EngineError("select", f"column '{name}' not found; there are {', '.join(names)}")
    return name


def _named(x: str | int, names: Sequence[str]) -> str:
    """A name, or a place counted from 1."""
    if isinstance(x, int):
        if not 1 <= x <= len(names):
            raise EngineError("select", f"there is no column {x}")
        return names[x - 1]
    return _known(x, names)


def resolve(names: Sequence[str], wanted: Sequence[str | int | Selection]) -> list[str]:
    """Names in the order in which they are first asked for; negative rules take away, and start from all names if they come first."""
    out: list[str] = []
    for k, w in enumerate(wanted):
        if isinstance(w, int) and w < 0:
            w = exclude(-w)
        elif isinstance(w, str) and w.startswith("-") and w not in names:
            w = exclude(w[1:])
        if not isinstance(w, Selection):
            out += [n for n in [_named(w, names)] if n not in out]
        elif w.negative:
            gone = set(w.pick(names))
            out = [n for n in (names if k == 0 else out) if n not in gone]
        else:
            out += [n for n in w.pick(names) if n not in out]
    return out
