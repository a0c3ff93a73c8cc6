"""Regexes that run faster and match the same.

Java tries a pattern at every place of a text, and Unicode word bounds and look-behinds cost the most there. So a
look-ahead for the characters that a match can begin with goes in front of them, and alternatives are grouped by
their first letter."""

from __future__ import annotations

import re
from functools import cache

_CATEGORIES = {"CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w", "CATEGORY_SPACE": r"\s"}


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() else f"\\u{code:04x}" if code < 0x10000 else ""


def _first(items) -> tuple[set[str], bool] | None:
    """The members of a character class that holds all first characters, and whether there may be none; None: not known."""
    found: set[str] = set()
    for op, arg in items:
        name = str(op)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "LITERAL":
            own = ({_char(arg)}, False)
        elif name == "IN":
            own = (set(), False)
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    own[0].add(_char(x))
                elif str(kind) == "RANGE":
                    own[0].add(f"{_char(x[0])}-{_char(x[1])}")
                elif str(x) in _CATEGORIES:
                    own[0].add(_CATEGORIES[str(x)])
                else:
                    return None
        elif name == "BRANCH":
            parts = [_first(x) for x in arg[1]]
            if None in parts:
                return None
            own = (set().union(*(p[0] for p in parts)), any(p[1] for p in parts))
        elif name == "SUBPATTERN":
            own = _first(arg[-1])
        elif name == "MAX_REPEAT":
            own = _first(arg[2])
            if own is not None and arg[0] == 0:
                own = (own[0], True)
        else:
            return None
        if own is None or "" in own[0] or "-" in own[0]:
            return None
        found |= own[0]
        if not own[1]:
            return found, False
    return found, True


@cache
def quick(pattern: str) -> str:
    """``pattern`` with a look-ahead for its first characters in front; as it is, if they aren't known."""
    try:
        found = _first(re._parser.parse(pattern))  # type: ignore[attr-defined]
    except re.error:
        return pattern
    if found is None or found[1] or not found[0]:
        return pattern
    return f"(?=[{''.join(sorted(found[0]))}])(?:{pattern})"


#: Letters that a match in any case takes for plain ones.
_ODD = {"i": "\u0131\u0130", "s": "\u017f", "k": "\u212a"}


@cache
def lead(pattern: str) -> str:
    """What stands before the flags of a pattern that is matched in any case: a look-ahead for its first characters and, where it begins with a word's bound,
    the plain one, which holds wherever that of Unicode does. Both cost less than with flags; empty, if the characters aren't known."""
    try:
        found = _first(re._parser.parse(pattern))  # type: ignore[attr-defined]
    except re.error:
        return ""
    if found is None or found[1] or not found[0]:
        return ""
    signs, plain = set(), True
    for c in found[0]:
        if c == r"\d":
            signs.add(r"\p{Nd}")
        elif c in ("a-z", "A-Z"):
            signs |= {"a-z", "A-Z", *_ODD.values()}
        elif c == "0-9":
            signs.add(c)
        elif len(c) == 1 and c.isalnum() and len(c.lower()) == len(c.upper()) == 1 and c < "\u0100" and c not in "\u00b5\u00ff":
            signs |= {c.lower(), c.upper(), _ODD.get(c.lower(), "")}
        elif c.startswith(r"\u00"):
            signs.add(c)
            plain = False
        else:
            return ""
    bound = r"\b" if plain and pattern.startswith(r"\b") else ""
    return f"(?=[{''.join(sorted(signs))}]){bound}"


def grouped(alternatives: list[str]) -> str:
    """An alternation in which those with the same first letter stand together, in their order; they exclude all
    others. As it is, if an alternative doesn't begin with a letter as such."""
    groups: dict[str, list[str]] = {}
    for a in alternatives:
        if not a[:1].isalpha() or a[1:2] in ("?", "*", "+", "{") or "|" in re.sub(r"\([^()]*\)", "", a):
            return "|".join(alternatives)
        groups.setdefault(a[0].lower(), []).append(a)
    return "|".join(f"(?:{'|'.join(g)})" if len(g) == 1 else f"(?=[{g[0][0].lower()}{g[0][0].upper()}])(?:{'|'.join(g)})" for g in groups.values())


def _looks(items) -> int:
    """How much a parsed pattern looks at in look-arounds, at most."""
    n = 0
    for op, arg in items:
        name = str(op)
        if name in ("ASSERT", "ASSERT_NOT"):
            n += arg[1].getwidth()[1] + _looks(arg[1])
        elif name == "BRANCH":
            n += sum(map(_looks, arg[1]))
        elif name in ("SUBPATTERN", "ATOMIC_GROUP") or name.endswith("_REPEAT"):
            n += _looks(arg if name == "ATOMIC_GROUP" else arg[-1])
        elif name in ("GROUPREF", "GROUPREF_EXISTS"):
            n += 1 << 32
    return n


def _holds_digit(items) -> bool:
    """Whether every match holds a digit."""

    def digit(op, arg) -> bool:
        name = str(op)
        if name == "LITERAL":
            return chr(arg).isdecimal()
        if name == "RANGE":
            return 48 <= arg[0] <= arg[1] <= 57
        if name == "CATEGORY":
            return str(arg) == "CATEGORY_DIGIT"
        if name == "IN":
            return all(digit(*x) for x in arg)
        if name == "BRANCH":
            return all(map(_holds_digit, arg[1]))
        return (name == "SUBPATTERN" or (name.endswith("_REPEAT") and arg[0] > 0)) and _holds_digit(arg[-1])

    return any(digit(*x) for x in items)


@cache
def around_digit(pattern: str, blank: int) -> int | None:
    """How wide a match is at most, with all that is looked at around it, where no more than ``blank`` signs of white space stand in a row;
    None if that isn't bounded or known, or if a match may be without a digit."""
    try:
        own = re._parser.parse(re.sub(r"(?<!\\)\\s[*+]", rf"\\s{{0,{blank}}}", pattern))  # type: ignore[attr-defined]
    except re.error:
        return None
    widest = own.getwidth()[1] + _looks(own) + 1  # and the sign before or behind it, for a word's bound
    return widest if widest < 1 << 16 and _holds_digit(own) else None
