"""Long lists of terms, looked up by tokens instead of tried one after another.

A text is cut into tokens, runs of word characters and single other ones, as the terms are. At each token that begins a term, the
longest term that stands there counts. That is what an alternation in list order finds: where two terms begin alike and
both match, the shorter one, if it comes first in the list, always wins, so the longer one can never be found and is left out
beforehand; of those that are left the longest comes first. So the work follows the text and not the list. The list is a broadcast
variable of checked size."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .spans import CLOSE, OPEN

#: Code points of all terms together.
MOST = 64_000_000


@cache
def _tokens():
    import regex

    return regex.compile(r"\w+|[^\w]", regex.DOTALL).findall


def folded(token: str) -> str:
    """A token in the case in which a case-insensitive regex compares it: sign by sign, through its upper case."""
    if token.isascii():
        return token.lower()
    out = []
    for c in token:
        c = c.upper() if len(c.upper()) == 1 else c
        out.append(c.lower() if len(c.lower()) == 1 else c.lower()[0])
    return "".join(out)


def _is_word(token: str) -> bool:
    return len(token) > 1 or token.isalnum() or unicodedata.category(token) in ("Mn", "Me", "Mc", "Pc") or _tokens()(token + "a") == [token + "a"]


class Terms:
    """The terms that can be found, by their first token."""

    def __init__(self, terms: Iterable[str]):
        self.known: dict[tuple[str, ...], bool] = {}
        lengths: dict[str, set[int]] = {}
        for term in terms:
            key = tuple(map(folded, _tokens()(term)))
            if key and key not in self.known and not any(key[:k] in self.known and self._ends(key, k) for k in range(1, len(key))):
                self.known[key] = True
                lengths.setdefault(key[0], set()).add(len(key))
        self.lengths = {t: sorted(n, reverse=True) for t, n in lengths.items()}

    @staticmethod
    def _ends(key, k: int) -> bool:
        return k == len(key) or not _is_word(key[k])

    def marked(self, text: str) -> str:
        """The text with each term between two marks."""
        tokens = _tokens()(text)
        keys = [folded(t) for t in tokens]
        out, at, i = [], 0, 0
        while i < len(keys):
            for n in self.lengths.get(keys[i], ()):
                z = i + n
                if z <= len(keys) and tuple(keys[i:z]) in self.known and (i == 0 or not _is_word(tokens[i - 1])) and self._ends(tokens, z):
                    out += [*tokens[at:i], OPEN, *tokens[i:z], CLOSE]
                    at = i = z
                    break
            else:
                i += 1
        return "".join([*out, *tokens[at:]]) if out else text


def term_marks(terms: list[str]):
    """A function from a column of texts without marks to the texts with each term marked; see the module."""
    size = sum(map(len, terms))
    if size > MOST:
        raise ValueError(f"the list has {size} code points; {MOST} fit an executor")
    held = SparkSession.active().sparkContext.broadcast(Terms(terms))

    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(held.value.marked, na_action="ignore")

    found = F.pandas_udf(mark, StringType())

    def of(text: Column) -> Column:
        return found(text)

    return of
