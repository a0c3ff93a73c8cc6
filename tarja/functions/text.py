"""Scalar functions on strings and predicates on names, as columns; nothing here needs a UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms
from .patterns import grouped

LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: White space, with the four separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"


def _plain(c: str) -> str:
    """A character's compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def char_class(chars: Iterable[str]) -> str:
    """The inside of a regex class for the characters, as ranges of code points."""
    ranges: list[list[int]] = []
    for p in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in ranges)


#: Every character that folding changes, with what it gives: another one, several, or, for a mark, nothing.
FOLDED = {c: _plain(c) for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if not unicodedata.is_normalized("NFKD", c) or unicodedata.combining(c)}
FOLDED = {c: plain for c, plain in FOLDED.items() if c != plain}
#: Syllables of Hangul give two or three letters each, which follow from their number.
SYLLABLES = ("\uac00", "\ud7a3")
ONE = {c: plain for c, plain in FOLDED.items() if len(plain) == 1}
NONE = "".join(c for c, plain in FOLDED.items() if not plain)
MORE = {c: plain for c, plain in FOLDED.items() if len(plain) > 1 and not SYLLABLES[0] <= c <= SYLLABLES[1]}
LATIN_END = "\u0250"
LATIN = {c: plain for c, plain in ONE.items() if c < LATIN_END}
#: A text with no other characters than these is folded by LATIN alone.
EASY = char_class(c for c in map(chr, range(ord(LATIN_END))) if c not in MORE)
_GROWING = char_class(c for c, plain in FOLDED.items() if len(plain) > 1)
#: Plain characters are told first, at little cost.
GROWS = rf"[[^\x00-\x7f]&&[{_GROWING}]]"


def literal(term: str) -> str:
    """A term as a regex, escaped for Java and RE2 alike."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def any_of(options: Iterable[str]) -> str:
    return "|".join(literal(t) for t in options)


def strings(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row, even where ``use`` names it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- B: scalars


def _syllable(c: Column) -> Column:
    """The letters of a syllable of Hangul: 19 first ones, 21 middle ones, 27 last ones or none."""
    n = F.ascii(c) - ord(SYLLABLES[0])
    part = lambda first, count, k: F.substring(F.lit("".join(map(chr, range(first, first + count)))), k + 1, F.lit(1))
    last = F.when(n % 28 > 0, part(0x11A8, 27, (n % 28 - 1).cast("int"))).otherwise("")
    return F.concat(part(0x1100, 19, F.floor(n / 588).cast("int")), part(0x1161, 21, F.floor(n % 588 / 28).cast("int")), last)


def _grown(s: Column) -> Column:
    """The text with each character that stands for several as these."""

    def one(c: Column) -> Column:
        more = F.get(F.split(F.lit("\n".join(MORE.values())), "\n"), F.instr(F.lit("".join(MORE)), c) - 1)
        return F.when((c >= SYLLABLES[0]) & (c <= SYLLABLES[1]) & (F.length(c) == 1), _syllable(c)).otherwise(F.coalesce(more, c))

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(f"[{_GROWING}]|[^{_GROWING}]+"), F.lit(0)), one), "")


def fold_latin(s: Column) -> Column:
    """``fold`` of a text of Latin letters, as tokens are."""
    return F.translate(s, "".join(LATIN), "".join(LATIN.values()))


def fold(s: Column) -> Column:
    """Compatibility decomposition without combining marks, over all code points."""
    whole = F.translate(F.when(s.rlike(GROWS), _grown(s)).otherwise(s), "".join(ONE) + NONE, "".join(ONE.values()))
    return F.when(s.rlike(f"[^{EASY}]"), whole).otherwise(fold_latin(s))


def normalize_filter(s: Column) -> Column:
    """B1: no accents, upper case, white space collapsed."""
    return F.trim(F.upper(F.regexp_replace(fold(s), rf"(?U){SPACE}+", " ")))


def normalize_token(s: Column) -> Column:
    """B2."""
    return F.regexp_replace(F.upper(fold(s)), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def normal(token: Column) -> Column:
    """B2 of what ``tokenize`` gives."""
    return F.upper(fold_latin(token))


def tokenize(s: Column) -> Column:
    """Runs of Latin letters."""
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(f"({LETTERS})"), F.lit(1))


def clean_name(s: Column) -> Column:
    """White space collapsed, "e outros" and all after it cut, one closing mark dropped."""
    one = F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(one, AND_OTHERS, ""), LAST_MARK, ""))


def clean_metadata_name(s: Column) -> Column:
    """B4 without a leading honorific."""
    bare = F.trim(F.regexp_replace(clean_name(s), LEADING_HONORIFIC, ""))
    return F.btrim(F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(" -;:,"))


def digits_only(s: Column) -> Column:
    """B6."""
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\D", "")


def cpf_valid(s: Column) -> Column:
    """Eleven digits, not all alike, with both check digits right."""
    return _valid(digits_only(s))


def _valid(d: Column) -> Column:
    digit = [F.coalesce(F.substring(d, k, 1).try_cast("int"), F.lit(0)) for k in range(1, 12)]

    def check(n: int) -> Column:
        total = sum((digit[k] * (n + 1 - k) for k in range(n)), F.lit(0))
        return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)

    alike = d == F.repeat(F.substring(d, 1, 1), F.lit(11))
    return (F.length(d) == 11) & ~alike & (digit[9] == check(9)) & (digit[10] == check(10))


def cpf_valid_of(s: Column) -> Column:
    """B7 for use in a lambda."""
    return let(digits_only(s), _valid)


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_term(normalized: Column, options: Iterable[str]) -> Column:
    """One of the terms stands in the text, not inside a longer word."""
    options = list(options)
    first = f"(?=[{''.join(sorted({t[0] for t in options}))}])" if all(t[:1].isalpha() for t in options) else ""
    return normalized.rlike(f"{first}(?<![A-Z0-9])(?:{grouped([literal(t) for t in options])})(?![A-Z0-9])")


#: Letters that a name may write with other accents.
VARIANTS = {base: base + "".join(c for c in map(chr, range(0xE0, 0x100)) if unicodedata.normalize("NFKD", c)[0] == base) for base in "aceinouy"}
#: All other characters that are such a letter without its marks, in either case: a name may hold them.
BASES = {c: plain.lower() for c, plain in ONE.items() if plain.lower() in VARIANTS and c.lower() not in VARIANTS[plain.lower()]}


def flexible_words(name: Column) -> Column:
    """The inside of B9's pattern."""
    name = F.when(name.rlike("[^\\x00-\\xff]|ª|º"), F.translate(name, "".join(BASES), "".join(BASES.values()))).otherwise(name)
    out = F.regexp_replace(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), r"([^\p{L}\p{M}\p{N} ])", r"\\$1")
    for letters in VARIANTS.values():
        out = F.regexp_replace(out, f"(?iu)[{letters}]", f"[{letters}]")
    return F.replace(out, F.lit(" "), F.lit(r"\s+"))


#: Letters that a match in any case takes for plain ones.
ODD = {"i": "\u0131\u0130", "s": "\u017f", "k": "\u212a"}


def flexible(word: str) -> str:
    """``flexible_words`` of a single word of letters that is known beforehand."""
    return "".join(f"[{VARIANTS[c.lower()]}]" if c.lower() in VARIANTS else c for c in word)


def begins(words: Iterable[str], capital: bool = False) -> str:
    """A class of all signs that a word may begin with where ``flexible`` is matched in any case; ``capital``: of those that are capitals of its
    letters, with accents."""
    every = {x for c in {w[0].lower() for w in words if w} for x in VARIANTS.get(c, c)}
    capitals = {u for u in map(str.upper, every) if len(u) == 1}
    return f"[{''.join(sorted(capitals if capital else every | capitals | {x for c in every for x in ODD.get(c, '')}))}]"


def accent_flexible_pattern(name: Column) -> Column:
    """A regex for the name with any accents, any case and any white space between words."""
    words = flexible_words(name)
    # the first letter is looked for before the costlier bound
    first = F.regexp_extract(words, r"^(\[[^\]]*\]|\\?.)", 1)
    return F.concat(F.lit("(?iU)(?="), first, F.lit(r")(?<!\w)"), words, F.lit(r"(?!\w)"))


def one_of(words: Iterable[str]) -> str:
    """A pattern for exactly one of many words: one expression, where a list would be one for each."""
    return f"^(?:{grouped([literal(w) for w in words])})$"


def _real(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.upper(t).rlike(one_of(terms.CONNECTORS)))


def first_word(name: Column) -> Column:
    """The first word that isn't a connector, or an empty string."""
    return F.coalesce(F.get(_real(tokenize(name)), F.lit(0)), F.lit(""))


def first_name(name: Column) -> Column:
    """The first word that isn't a connector, unless it is blocked."""
    word = first_word(name)
    return F.when(semantically_blocked(word), "").otherwise(word)


def name_variants(name: Column) -> Column:
    """The name and its fronts of two words or more, with and without connectors, longest first."""
    words = tokenize(name)
    fronts = F.when(F.size(words) >= 2, F.transform(F.sequence(F.size(words), F.lit(2), F.lit(-1)), lambda n: F.slice(words, 1, n))).otherwise(F.array().cast("array<array<string>>"))
    fronts = F.filter(fronts, lambda f: F.size(_real(f)) >= 2)
    named = F.concat(
        F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")),
        F.flatten(F.transform(fronts, lambda f: F.array(F.array_join(f, " "), F.array_join(_real(f), " ")))),
    )
    kept = F.filter(F.array_distinct(named), lambda v: ~semantically_blocked(v))
    order = F.array_sort(F.transform(kept, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.transform(order, lambda s: s["v"])


def public_placeholder(s: Column) -> Column:
    """B12."""
    return F.replace(s, F.lit(terms.PARTY_PLACEHOLDER_INNER), F.lit(terms.PARTY_PLACEHOLDER))


def format_score(d: Column) -> Column:
    """Two decimals of the exact binary value."""
    return F.format_number(d, 2)


def context_window(text: Column, start: Column, end: Column, reach: int) -> Column:
    """The text from ``reach`` before the span to ``reach`` after it; an edge counts as a word's bound."""
    low = F.greatest(start - reach, F.lit(0))
    return F.substring(text, low + 1, end + reach - low)


def normalize_newlines(s: Column) -> Column:
    """B15."""
    return F.replace(F.coalesce(s, F.lit("")), F.lit("\r\n"), F.lit("\n"))


# --- C: predicates and name extraction


BLOCKED = one_of(sorted({*terms.BLOCKED_IN_NAMES, *terms.NOT_A_NAME, *terms.COMPANY_TERMS}))


def semantically_blocked(s: Column) -> Column:
    """Only connectors; all words blocked; or of three and more, three quarters blocked."""

    def told(real: Column) -> Column:
        n, bad = F.size(real), F.size(F.filter(real, lambda t: t.rlike(BLOCKED)))
        return (bad == n) | ((n >= 3) & (4 * bad >= 3 * n))

    def of(words: Column) -> Column:
        return (F.size(words) > 0) & let(F.filter(words, lambda t: (t != "") & ~t.rlike(one_of(terms.CONNECTORS))), told)

    return let(F.transform(tokenize(s), normal), of)


def looks_like_person(s: Column) -> Column:
    """C2."""
    return (F.coalesce(s, F.lit("")) != "") & ~s.rlike("[<>]") & (F.size(tokenize(s)) >= 2) & ~contains_term(normalize_filter(s), terms.COMPANY_TERMS) & ~semantically_blocked(s)


def party_name_ok(s: Column) -> Column:
    """C3."""
    return looks_like_person(s) & ~contains_term(normalize_filter(s), terms.NOT_A_PARTY)


def generic_name_ok(s: Column) -> Column:
    """C4."""
    return looks_like_person(s) & ~contains_term(normalize_filter(s), terms.NOT_A_NAME)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _names(found: list[Column], clean, good) -> Column:
    cleaned = F.transform(F.concat(*found), clean)
    return F.array_sort(F.array_distinct(F.filter(cleaned, good)))


# Patterns.
AND_OTHERS = r"(?iU)\s+e\s+outros?\b.*$"
LAST_MARK = r"(?U)\s*[-,:;]\s*$"
LEADING_HONORIFIC = r"(?iU)^\s*(?:dr\.?|dra\.?|sr\.?|sra\.?|des\.?|desembargador(?:a)?|ministro(?:a)?)\s+"
ROLES = "|".join(terms.TARGET_ROLES)
PARTY_LABEL = rf"(?imUd)^\s*({ROLES})\s*:\s*(.+?)\s*$"
PARTY_IN_BRACKETS = rf"(?imUd)^\s*(.+?)\s*\(\s*({ROLES})\s*\)\s*$"
NAME_BLOCK = r"[A-ZÀ-Ý][A-Za-zÀ-ÖØ-öø-ÿ]+(?:\s+(?:DE|DA|DO|DAS|DOS|E|de|da|do|das|dos|e))?(?:\s+[A-ZÀ-Ý][A-Za-zÀ-ÖØ-öø-ÿ]+){1,7}"
CONTEXT_PATTERNS = [
    rf"(?imUd)^\s*({NAME_BLOCK})\s*,\s*(?:brasileir[oa]|solteir[oa]|casad[oa]|desempregad[oa]|portador[oa])\b",
    rf"(?imUd)\b(?:AUTOR(?:A)?|REQUERENTE|REQUERID[OA]S?|RECORRENTE|RECORRID[OA]S?|R[ÉE]U(?:S)?|PERIT[AO]|ADVOGAD[OA]|POLO\s+PASSIVO|FILIA[ÇC][ÃA]O|ASSINADO\s+ELETRONICAMENTE\s+POR)\s*[:\-]?\s*({NAME_BLOCK})",
    rf"(?imUd)^\s*({NAME_BLOCK})\s*\(\s*(?:R[ÉE]U(?:S)?|REQUERID[OA]S?)\s*\)\s*$",
    rf"(?imUd)\(\s*[IVXLC]+\s*\)\s*({NAME_BLOCK})",
]
METADATA_ROLE = (
    r"(?iU)\b(?:AUTOR(?:A)?|REQUERENTE|REQUERIDO(?:A)?|RECORRENTE|RECORRIDO(?:A)?|EXEQUENTE|EXECUTADO(?:A)?|EXEQU[ÍI]DO(?:A)?|EXEQUENDO|EMBARGANTE|EMBARGADO(?:A)?)\s*:\s*([^;\n|]+)"
)
ADDRESS_WORDS = r"(?iU)\b(?:endere[cç]o|rua|ra|avenida|av\.?|travessa|trav\.?|alameda|rodovia|estrada|vicinal|bairro|lote|quadra|qd\.?|cep|fazenda|s[ií]tio|ch[aá]cara)\b"
CPF_WORDS = r"(?iU)\b(?:cpf|cin|carteira\s+de\s+identidade\s+nacional)\b"
OAB_WORDS = r"(?iU)\b(?:advogad[oa]|procurador(?:ia)?|representante(?:s)?|polo\s+ativo|polo\s+passivo|oab|assinado\s+eletronicamente|subscr(?:eve|ito)|inscri[çc][aã]o)\b"
ROLE_WORDS = r"(?iU)\b(?:autor(?:a)?|requerente|requerid[oa]|recorrente|recorrid[oa]|réu|reu|executad[oa]|exequente|representante|advogad[oa]|perit[ao])\b"
COMPANY_UPPER = r"(?U)(?<!\w)[A-ZÀ-Ý][A-ZÀ-Ý0-9.&/\-]*(?:\s+(?:DE|DA|DO|DAS|DOS|E|[A-ZÀ-Ý][A-ZÀ-Ý0-9.&/\-]*)){1,14}(?!\w)"
COMPANY_MIXED = r"(?U)(?<!\w)[A-ZÀ-Ý][A-Za-zÀ-ÖØ-öø-ÿ0-9.&/\-]*(?:\s+(?:de|da|do|das|dos|e|[A-ZÀ-Ý][A-Za-zÀ-ÖØ-öø-ÿ0-9.&/\-]*)){1,14}(?!\w)"
HONORIFIC = r"(?:sr\.?|sra\.?|senhor(?:a)?|dr\.?|dra\.?|des\.?|desembargador(?:a)?|ministro(?:a)?)"
# End of the fixed values.
#: This library's own: for each of CONTEXT_PATTERNS a cheap regex that every text with a match also matches.
CONTEXT_GATES = [r"(?iU),\s*(?:brasileir|solteir|casad|desempregad|portador)", r"(?iU)\b(?:autor|requer|recorr|r[ée]u|perit|advogad|polo|filia|assinado)", r"(?iU)\(\s*(?:r[ée]u|requerid)", r"(?iU)\(\s*[ivxlc]+\s*\)"]


#: The same for PARTY_LABEL and PARTY_IN_BRACKETS.
PARTY_GATES = [rf"(?iU)\b(?:{ROLES})\s*:", rf"(?iU)\(\s*(?:{ROLES})\s*\)"]


def _gated(text: Column, pattern: str, group: int, gate: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike(gate), _all(text, pattern, group)).otherwise(F.array().cast("array<string>"))


def party_names(text: Column) -> Column:
    """``ROLE: name`` and ``name (ROLE)`` lines."""
    return _names([_gated(text, p, k, gate) for p, k, gate in zip((PARTY_LABEL, PARTY_IN_BRACKETS), (2, 1), PARTY_GATES, strict=True)], clean_name, party_name_ok)


def contextual_names(text: Column) -> Column:
    """Names by civil status, role, role in brackets and Roman item."""
    found = [_gated(text, p, 1, gate) for p, gate in zip(CONTEXT_PATTERNS, CONTEXT_GATES, strict=True)]
    return _names(found, clean_name, generic_name_ok)


def metadata_names(meta: Column) -> Column:
    """From a map of strings."""
    found = []
    for field in terms.METADATA_FIELDS:
        value = F.coalesce(F.try_element_at(meta, F.lit(field)), F.lit(""))
        found += [_all(value, METADATA_ROLE, 1), F.split(value, r"[;\n|]")]
    return _names(found, clean_metadata_name, looks_like_person)


def in_address_context(text: Column, start: Column, end: Column) -> Column:
    """C9."""
    return context_window(text, start, end, terms.ADDRESS_WINDOW).rlike(ADDRESS_WORDS)


def in_cpf_context(text: Column, start: Column, end: Column) -> Column:
    """C10."""
    return context_window(text, start, end, terms.CPF_WINDOW).rlike(CPF_WORDS)


def in_oab_context(text: Column, start: Column, end: Column) -> Column:
    """C11."""
    return context_window(text, start, end, terms.OAB_WINDOW).rlike(OAB_WORDS)


def in_party_role_context(text: Column, start: Column, end: Column) -> Column:
    """C12."""
    return context_window(text, start, end, terms.ROLE_WINDOW).rlike(ROLE_WORDS)


def beside_bracket(text: Column, start: Column, end: Column) -> Column:
    """``<`` right before or ``>`` right after: part of a placeholder."""
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    return (before == "<") | (F.substring(text, end + 1, F.lit(1)) == ">")
