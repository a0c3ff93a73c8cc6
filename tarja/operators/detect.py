"""Rules and detection: texts in, spans out."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from itertools import groupby
from operator import and_
from typing import NamedTuple

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as tx
from ..functions.patterns import around_digit, grouped, lead, quick
from .dictionary import term_marks
from .spans import MARKS, above_threshold, chunks, clean_marks, cut, dedupe_array, dedupe_same_entity, located, marked, running, tables, traced

FLAGS = "(?iUsmd)"


class Rule(NamedTuple):
    entity: str
    name: str
    pattern: str
    score: float
    #: A cheap regex that every text with a match also matches.
    gate: str = ""
    #: What runs in the pattern's place, if it isn't the pattern itself: the same matches in less time.
    run: str = ""
    #: Whether the pattern is a list of terms or a form.
    source: str = "regex"
    #: The terms themselves, if they are many: they are looked up by tokens, and the pattern, which says the same, isn't run.
    terms: tuple[str, ...] = ()
    #: What every match begins with, as beginnings of words, each with the look-ahead that tells it, if any; and a form that the text's numbers
    #: hold where there is a match. Both are asked of what one pass over the text for all rules has found, in place of ``gate``.
    words: tuple[str, ...] = ()
    numbers: str = ""


#: Of so many terms on a list is looked up.
MANY = 1_000


def _deny(entity: str, words: Iterable[str], score: float) -> list[Rule]:
    """One alternation in list order, not inside a word."""
    words = list(words)
    form = r"(?:^|(?<=\W))(?:{})(?:(?=\W)|$)"
    if len(words) >= MANY:
        return [Rule(entity, entity.lower(), form.format(tx.any_of(words)), score, source="list", terms=tuple(words))]
    return [Rule(entity, entity.lower(), form.format(tx.any_of(words)), score, run=form.format(grouped([tx.literal(w) for w in words])), source="list")] if words else []


def _listed(entity: str, words: Iterable[str], score: float) -> list[Rule]:
    """One alternation, longest first: where terms nest, the longest is the span that would remain."""
    words = sorted(set(words), key=lambda w: (-len(w), w))
    return [Rule(entity, entity.lower(), rf"\b(?:{tx.any_of(words)})\b", score, run=rf"\b(?:{grouped([tx.literal(w) for w in words])})\b", source="list")] if words else []


def title_gate(titles: list[str]) -> str:
    """The distinct first words of the titles, up to what a regex may vary; none if a title has no such word."""
    firsts = set()
    for t in titles:
        word = re.match(r"\w*", t)[0]
        if t[len(word) : len(word) + 1] in ("?", "*", "{"):
            word = word[:-1]
        if not word or "|" in re.sub(r"\([^()]*\)", "", t):
            return ""
        firsts.add(word)
    return rf"(?iU)\b(?:{'|'.join(sorted(firsts))})"


def title_rules(titles: list[str]) -> list[Rule]:
    """D3: titles are regexes as they stand, tried in their order; their first words gate."""
    form = r"\b({})(?:\([A-Z]\))?\b"
    return [Rule("LEGAL_TITLE", "legal_title", form.format("|".join(titles)), 1.0, title_gate(titles), form.format(grouped(titles)), "list")] if titles else []


_DIGIT, _STREETS = r"(?U)\d", r"(?iU)\b(?:ru?a|av|trav|alameda|pra|rodovia|estrada|vicinal)"


def _word(word: str) -> str:
    """A gate: the word in any case; a few letters have a third case beside."""
    other = {"i": "[i\u0131\u0130]", "s": "[s\u017f]", "k": "[k\u212a]"}
    return "(?i)" + "".join(other.get(c, c) for c in word)


# Entities, rules, patterns and scores that results must agree on. The gates are this library's own.
RULES = [
    Rule("CPF", "cpf_formatado", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", 1.0, _DIGIT),
    Rule("CPF", "cpf_com_separadores", r"\b\d{3}[.\s]\d{3}[.\s]\d{3}[-\s]\d{2}\b", 0.99, _DIGIT),
    Rule("CPF", "cpf_com_rotulo", r"\bCPF\s*(?:n[ºo°.]?\s*)?:?\s*\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", 1.0, _word("cpf")),
    Rule("CPF", "cin_com_rotulo", r"\bCIN\s*(?:n[ºo°.]?\s*)?:?\s*\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", 1.0, _word("cin")),
    Rule("CPF", "carteira_identidade_nacional_com_numero", r"\bCarteira\s+de\s+Identidade\s+Nacional\b[\s:\-nºo°\.]{0,20}\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", 0.99, _word("carteira")),
    Rule("CPF", "cpf_apenas_numeros", r"(?<!\d)\d{11}(?!\d)", 0.995, _DIGIT),
    Rule("OAB_NUMBER", "oab_uf_numero", r"\bOAB\s*(?:n[º°.]?\s*)?(?:/|-)?\s*(?:AC|AL|AP|AM|BA|CE|DF|ES|GO|MA|MT|MS|MG|PA|PB|PR|PE|PI|RJ|RN|RS|RO|RR|SC|SP|SE|TO)\s*(?:[Nn][º°o.\?]?\s*)?[-.]?\s*\d{1,6}(?:\.\d{3})?\b", 0.9, _word("oab")),
    Rule("OAB_NUMBER", "oab_numero_uf", r"\bOAB\s*(?:n[º°.]?\s*)?\d{1,6}(?:\.\d{3})?\s*\/\s*(?:AC|AL|AP|AM|BA|CE|DF|ES|GO|MA|MT|MS|MG|PA|PB|PR|PE|PI|RJ|RN|RS|RO|RR|SC|SP|SE|TO)\b", 0.88, _word("oab")),
    Rule("OAB_NUMBER", "oab_uf_numero_compacto", r"\bOAB\s*(?:/|-)?\s*(?:AC|AL|AP|AM|BA|CE|DF|ES|GO|MA|MT|MS|MG|PA|PB|PR|PE|PI|RJ|RN|RS|RO|RR|SC|SP|SE|TO)\s*[-.]?\s*\d{4,6}(?:\.\d{3})?\b", 0.8, _word("oab")),
    Rule("OAB_NUMBER", "oab_uf_numero_sem_prefixo", r"(?<!/)\b(?:AC|AL|AP|AM|BA|CE|DF|ES|GO|MA|MT|MS|MG|PA|PB|PR|PE|PI|RJ|RN|RS|RO|RR|SC|SP|SE|TO)\s*[-.]?\s*\d{4,6}(?:\.\d{3})?\b", 0.7, _DIGIT),
    Rule("PHONE_NUMBER_BR", "telefone_com_ddd", r"(?<!\d)(?:\(?\d{2}\)?\s*)(?:9\d{4}|\d{4})[-\s]\d{4}(?!\d)", 0.93, _DIGIT),
    Rule("PHONE_NUMBER_BR", "telefone_sem_ddd", r"(?<!\d)(?:9\d{4}|\d{4})-\d{4}(?!\d)", 0.92, _DIGIT),
    Rule("CEP_NUMBER", "cep_com_rotulo", r"\bCEP\s*[:\-]?\s*\d{5}-?\d{3}\b", 0.99, _word("cep")),
    Rule("CEP_NUMBER", "cep_hifen", r"\b\d{5}-\d{3}\b", 0.93, _DIGIT),
    Rule("CEP_NUMBER", "cep_pontuado", r"\b\d{2}\.\d{3}-\d{3}\b", 0.93, _DIGIT),
    Rule("ENDERECO_LOGRADOURO", "logradouro_com_numero_e_complemento", r"\b(?:rua|ra|avenida|av\.?|travessa|trav\.?|alameda|pra[cç]a|rodovia|estrada)\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]+(?:\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]+){0,8}\s*,\s*(?:n[ºo°.]?\s*)?\d+[A-Za-z0-9/\-]*\s*,\s*[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]{2,}(?:\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]{2,}){0,5}", 0.97, _STREETS),
    Rule("ENDERECO_LOGRADOURO", "logradouro_prefixado", r"\b(?:rua|ra|avenida|av\.?|travessa|trav\.?|alameda|pra[cç]a|rodovia|estrada|vicinal)\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]+(?:\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]+){0,8}(?:\s*,?\s*(?:n[ºo°.]?\s*)?\d+[A-Za-z0-9/\-]*)?(?:\s*,\s*[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]{2,}(?:\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]{2,}){0,5})?", 0.9, _STREETS),
    Rule("ENDERECO_LOGRADOURO", "beco_viela_ramal_com_numero", r"\b(?:beco|viela|ramal|ladeira|passagem)\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´\-]+(?:\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´\-]+){0,6}\s*,\s*(?:casa\s*)?\d+[A-Za-z0-9/\-]*(?:\s*,?\s*(?:bairro\s*:?\s*)?[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´\-]+(?:\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´\-]+){0,4})?", 0.98, _DIGIT),
    Rule("ENDERECO_LOGRADOURO", "vicinal_composta", r"\bVicinal\s+\d{1,3}\s+com\s+Vicinal\s+\d{1,3}\b", 0.95, _word("vicinal")),
    Rule("ENDERECO_LOGRADOURO", "quadra_lote", r"\b(?:quadra|qd\.?)\s*[A-Za-z0-9\-]+(?:\s*,?\s*(?:lote|lt\.?)\s*[A-Za-z0-9\-]+)?\b", 0.88, r"(?iU)\bq(?:ua)?d"),
    Rule("ENDERECO_LOGRADOURO", "setor_condominio_residencial", r"\b(?:setor|condom[ií]nio|residencial)\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]+(?:\s+[A-Za-zÀ-ÖØ-öø-ÿ0-9'`´.\-]+){0,5}\b", 0.82, r"(?iU)\b(?:setor|condom|residencial)"),
    Rule("CNH", "cnh_formatado", r"\bCNH\s*(?:nº|n\.)?\s*\d{11}\b", 0.99, _word("cnh")),
    Rule("SIAPE", "siape_formatado", r"\bSIAPE\s*(?:nº|n\.)?\s*\d{7}\b", 0.98, _word("siape")),
    Rule("SIAPE", "siape_apenas_numeros", r"\b(?<![\w])\d{7}(?![\w])\b", 0.85, _DIGIT),
    Rule("RG_NUMBER", "rg_com_rotulo", r"\bRG\s*(?:n[ºo°.]?\s*)?[:\-]?\s*(?=[A-Z0-9.\-X]{3,20}\b)(?=[A-Z0-9.\-X]*\d)[A-Z0-9.\-X]{3,20}(?:\s*-\s*\dª\s*VIA)?(?:\s*[-,]?\s*(?:SSP|SESP|PC|IFP|DGPC|SJS|SJTC|SSDS|POL[ÍI]CIA\s+CIVIL)\s*\/\s*[A-Z]{2})?\b", 0.99, _word("rg")),
    Rule("RG_NUMBER", "registro_geral_com_numero", r"\bRegistro\s+Geral\s*(?:n[ºo°.]?\s*)?[:\-]?\s*(?=[A-Z0-9.\-X]{3,20}\b)(?=[A-Z0-9.\-X]*\d)[A-Z0-9.\-X]{3,20}(?:\s*[-,]?\s*(?:SSP|SESP|PC|IFP|DGPC|SJS|SJTC|SSDS|POL[ÍI]CIA\s+CIVIL)\s*\/\s*[A-Z]{2})?\b", 0.98, _word("registro")),
    Rule("RG_NUMBER", "cedula_ou_carteira_identidade_com_numero", r"\b(?:C[ÉE]DULA\s+DE\s+IDENTIDADE|CARTEIRA\s+DE\s+IDENTIDADE(?!\s+NACIONAL))\s*(?:n[ºo°.]?\s*)?[:\-]?\s*(?=[A-Z0-9.\-X]{3,20}\b)(?=[A-Z0-9.\-X]*\d)[A-Z0-9.\-X]{3,20}(?:\s*[-,]?\s*(?:SSP|SESP|PC|IFP|DGPC|SJS|SJTC|SSDS|POL[ÍI]CIA\s+CIVIL)\s*\/\s*[A-Z]{2})?\b", 0.95, _word("identidade")),
    Rule("MATRICULA_SIAPE", "matricula_siape", r"\b(matr[íi]cula|siape)\b", 0.95, r"(?iU)(?:matr|siape)"),
    Rule("ID_DOCUMENTO", "numero_beneficio_nb_formatado", r"\bNB\s*\d{1,3}(\.?\d{3}){2}-[\dX]\b", 0.98, _word("nb")),
    Rule("ID_DOCUMENTO", "id_numerico_longo_pje", r"\b\d{10,25}\b", 0.97, _DIGIT),
    Rule("ID_DOCUMENTO", "id_prefixo_numerico", r"\bID\s*\d{8,12}\b", 0.97, _word("id")),
    Rule("ID_DOCUMENTO", "numero_processo_cnj", r"\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b", 0.95, _DIGIT),
    Rule("ID_DOCUMENTO", "numero_rnm", r"\bRNM\s*(?:nº|n\.)?\s*[A-Z0-9]{7,15}\b", 0.98, _word("rnm")),
    Rule("ID_DOCUMENTO", "numero_crm", r"\bCRM\s*[A-Z]{2}\s*-\s*\d{1,6}\b", 0.98, _word("crm")),
]
# End of the fixed values.

RULES += _deny("SAFE_LOCATION", terms.SAFE_LOCATIONS, 0.99) + _deny("LEGAL_HEADER", terms.LEGAL_HEADERS, 0.99)
RULES += _listed("ESTADO_CIVIL", terms.CIVIL_STATUS, 0.99) + _listed("ORGANIZACAO_CONHECIDA", terms.KNOWN_BODIES, 0.99)


def _first_words(words: Iterable[str]) -> tuple[str, ...]:
    return tuple(sorted({re.match(r"\w+", w)[0] + r"(?!\w)" for w in words}))


#: Runs of digits and of what stands between them in a number. A form of digits, points, dashes, slashes and spaces that begins with a digit
#: stands in one of them as it stands in the text.
NUMBERS = r"(?U)\d[\d.\-/\s]*"
_ELEVEN = r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}"
_STREET = tuple(w + r"(?=\.?\s)" for w in ("rua", "ra", "avenida", "av", "travessa", "trav", "alameda", "praca", "praça", "rodovia", "estrada"))
#: For the rules of the table: ``words`` and ``numbers``.
_HOLDS: dict[str, tuple[tuple[str, ...], str]] = {
    "cpf_formatado": ((), r"\d{3}\.\d{3}\.\d{3}-\d{2}"),
    "cpf_com_separadores": ((), r"\d{3}[.\s]\d{3}[.\s]\d{3}[-\s]\d{2}"),
    "cpf_com_rotulo": (("cpf",), _ELEVEN),
    "cin_com_rotulo": (("cin",), _ELEVEN),
    "carteira_identidade_nacional_com_numero": ((r"carteira(?=\s)",), _ELEVEN),
    "cpf_apenas_numeros": ((), r"(?<!\d)\d{11}(?!\d)"),
    "oab_uf_numero": (("oab",), r"\d"),
    "oab_numero_uf": (("oab",), r"\d"),
    "oab_uf_numero_compacto": (("oab",), r"\d{4}"),
    "oab_uf_numero_sem_prefixo": (tuple(uf + r"(?=\s*[-.]?\s*\d{4})" for uf in "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()), r"\d{4}"),
    "telefone_com_ddd": ((), r"\d{4}[-\s]\d{4}(?!\d)"),
    "telefone_sem_ddd": ((), r"(?<!\d)(?:9\d{4}|\d{4})-\d{4}(?!\d)"),
    "cep_com_rotulo": (("cep",), r"\d{5}-?\d{3}"),
    "cep_hifen": ((), r"(?<!\d)\d{5}-\d{3}(?!\d)"),
    "cep_pontuado": ((), r"(?<!\d)\d{2}\.\d{3}-\d{3}(?!\d)"),
    "logradouro_com_numero_e_complemento": (_STREET, r"\d"),
    "logradouro_prefixado": ((*_STREET, r"vicinal(?=\s)"), ""),
    "beco_viela_ramal_com_numero": (tuple(w + r"(?=\s)" for w in ("beco", "viela", "ramal", "ladeira", "passagem")), r"\d"),
    "vicinal_composta": ((r"vicinal(?=\s)",), r"\d"),
    "quadra_lote": (("quadra", "qd"), ""),
    "setor_condominio_residencial": ((r"setor(?=\s)", r"condominio(?=\s)", r"condomínio(?=\s)", r"residencial(?=\s)"), ""),
    "cnh_formatado": (("cnh",), r"\d{11}"),
    "siape_formatado": (("siape",), r"\d{7}"),
    "siape_apenas_numeros": ((), r"(?<!\d)\d{7}(?!\d)"),
    "rg_com_rotulo": (("rg",), r"\d"),
    "registro_geral_com_numero": ((r"registro(?=\s)",), r"\d"),
    "cedula_ou_carteira_identidade_com_numero": (("identidade",), r"\d"),
    "matricula_siape": ((r"matricula(?!\w)", r"matrícula(?!\w)", r"siape(?!\w)"), ""),
    "numero_beneficio_nb_formatado": ((r"nb(?=\s*\d)",), r"\d"),
    "id_numerico_longo_pje": ((), r"(?<!\d)\d{10,25}(?!\d)"),
    "id_prefixo_numerico": ((r"id(?=\s*\d)",), r"\d{8}"),
    "numero_processo_cnj": ((), r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"),
    "numero_rnm": (("rnm",), ""),
    "numero_crm": (("crm",), r"\d"),
    "safe_location": (_first_words(terms.SAFE_LOCATIONS), ""),
    "legal_header": (_first_words(terms.LEGAL_HEADERS), ""),
    "estado_civil": (_first_words(terms.CIVIL_STATUS), ""),
    "organizacao_conhecida": (_first_words(terms.KNOWN_BODIES), ""),
    "phone_digits": ((), r"\d{10}"),
    "numeric_date": ((), r"(?<!\d)\d{1,2}/\d{1,2}/\d{4}"),
}
#: This library's own patterns.
RULES += [
    Rule("EMAIL_ADDRESS", "email", r"\b[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}\b", 1.0, "@"),
    Rule("PHONE_NUMBER", "phone_digits", r"(?<![\d.\-/])(?:\+\d{1,3}\s?)?\d{10,11}(?![\d.\-/])", 0.40, _DIGIT),
    Rule("DATE_TIME", "numeric_date", r"(?<![\d.\-/])\d{1,2}/\d{1,2}/\d{4}(?![\d\-/])", 0.60, "/"),
]
RULES = [r._replace(words=_HOLDS[r.name][0], numbers=_HOLDS[r.name][1]) if r.name in _HOLDS else r for r in RULES]


def rules_for(entities: Iterable[str] | None = None, titles: list[str] | None = None, common: list[str] | None = None, more: Iterable[Rule] = ()) -> list[Rule]:
    """The rule table with the user's titles, common terms and own rules, for some entities or all."""
    table = [*RULES, *title_rules(titles or []), *_deny("TERMO_COMUM", common or [], 1.0), *more]
    wanted = None if entities is None else set(entities)
    return [r for r in table if wanted is None or r.entity in wanted]


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.entity, r.name, r.pattern, r.score) for r in rules], "entity string, rule string, regex string, score double")


def _words_of(words: Iterable[str]) -> str:
    """The whole words that begin with one of ``words``, which are tried by their first letter."""
    either = lambda c: c + c.upper() + tx.ODD.get(c, "")
    groups = {c: "|".join(g) for c, g in groupby(sorted(words, key=lambda w: (w[0].lower(), w)), key=lambda w: w[0].lower())}
    return rf"(?=[{''.join(map(either, groups))}])\b(?:{'|'.join(f'(?=[{either(c)}])(?iU:{g})' for c, g in groups.items())})(?U)\w*"


def _run(pattern: str) -> str:
    """A rule's pattern as it is matched. Look-aheads for one letter name its cases themselves, which costs less than a match in any case."""
    first = lead(pattern)
    pattern = re.sub(r"[(][?]=\[([a-z])([A-Z])\][)]", lambda m: f"(?-iU:(?=[{m[1]}{m[2]}{tx.ODD.get(m[1], '')}]))" if m[1].upper() == m[2] else m[0], pattern)
    return first + FLAGS + (f"(?:{pattern})" if first else quick(pattern))


def _begun(words: tuple[str, ...]) -> str:
    """Whether one of the words found, which stand between bars, begins with one of ``words``."""
    return rf"(?iU)(?<![^|])(?:{'|'.join(re.sub(r'[(][?][=!].*$', '', w) for w in words)})" if words else ""


RAW = "array<struct<entity:string,rule:string,score:double,start:int,end:int,found:string,context:boolean>>"


def _all_of(text: Column, pattern: str) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "|")


#: How much of a text is kept on either side of a digit for rules whose matches hold one, if no more than so many signs of white space stand in a row there.
REACH, BLANK = 200, 12
#: What stands for a stretch that is left out: no sign of a word, a number or a space.
GAP = "\u0003"


def at_digits(r: Rule) -> bool:
    """Whether each match of a rule lies, with its neighbours and its context, within REACH of a digit of its own."""
    wide = None if r.terms or not r.numbers else around_digit(r.run or r.pattern, BLANK)
    window = {"OAB_NUMBER": terms.OAB_WINDOW, "CPF": terms.CPF_WINDOW, "CIN": terms.CPF_WINDOW}.get(r.entity, 0)
    return wide is not None and wide + window <= REACH


def near_digits(text: Column) -> Column:
    """struct<text, cuts>: a text without the middles of its long stretches that hold no digit, and, as one step or none, what was left out. Where
    it holds more white space than BLANK in a row, whole."""
    none = F.array().cast("array<struct<start:int,end:int,put:string>>")

    def without(p: Column) -> Column:
        """``p``: in turn what stands between blocks that begin with a digit, and the blocks."""
        left = lambda i: F.when(i == 0, 0).otherwise(REACH)
        right = lambda i: F.when(i == F.size(p) - 1, 0).otherwise(REACH)
        long = lambda x, i: (i % 2 == 0) & (F.length(x) > left(i) + right(i))
        tail = lambda x, i: F.when(right(i) > 0, F.substring(x, F.lit(-REACH), F.lit(REACH))).otherwise("")
        kept = F.transform(p, lambda x, i: F.when(long(x, i), F.concat(F.substring(x, F.lit(1), left(i)), F.lit(GAP), tail(x, i))).otherwise(x))
        gap = lambda end, i: F.when(long(F.get(p, i), i), F.struct((end - F.length(F.get(p, i)) + left(i)).alias("start"), (end - right(i)).alias("end"), F.lit(GAP).alias("put")))
        cuts = F.filter(F.transform(running(F.transform(p, F.length)), gap), lambda s: s.isNotNull())
        return F.struct(F.array_join(kept, "").alias("text"), cuts.alias("cuts"))

    whole = F.struct(text.alias("text"), none.alias("cuts"))
    cut_out = tx.let(F.split(marked(text, r"(?sU)\d.{0,99}"), MARKS), without)
    return tx.let(cut_out, lambda o: F.when(F.rlike(o["text"], F.lit(rf"(?U)\s{{{BLANK + 1}}}")), whole).otherwise(o))


def span_array(text: Column, rules: list[Rule]) -> Column:
    """All rules' spans of a text, a column of its own, as one array<struct<entity, rule, score, start, end, found, context>>.

    Rules whose matches hold a digit and are bounded see only what stands near digits, which is cut out in one pass; their spans are traced back. One pass
    finds the words and one the numbers that any rule asks for; a rule whose own aren't among them costs no pass. Another rule whose gate finds
    nothing costs its gate only; of a rule without a match nothing but one pass. Patterns and names are
    literals, whatever they hold. ``context``, for CPF, CIN and OAB_NUMBER, says whether a word of theirs is near (C10, C11)."""

    looked_up = [r for r in rules if r.terms]
    near, far = [r for r in rules if at_digits(r)], [r for r in rules if not at_digits(r)]

    def tried(o: Column, r: Rule) -> Column:
        found = F.get(o["looked_up"], F.lit(looked_up.index(r))) if r.terms else marked(o["text"], _run(r.run or r.pattern))
        asked = [F.rlike(o[c], F.lit(p)) for c, p in (("words", _begun(r.words)), ("numbers", f"(?U){r.numbers}" if r.numbers else "")) if p] or [F.rlike(o["text"], F.lit(r.gate))] * bool(r.gate)
        return F.struct(F.lit(r.entity).alias("entity"), F.lit(r.name).alias("rule"), F.lit(float(r.score)).alias("score"), (F.when(reduce(and_, asked), found) if asked else found).alias("marked"))

    def rows(r: Column) -> Column:
        return F.transform(located(r["marked"]), lambda s: F.struct(r["entity"].alias("entity"), r["rule"].alias("rule"), r["score"].alias("score"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))

    def told(parts: Column, s: Column) -> Column:
        near = lambda reach: cut(parts, s["start"] - reach, s["end"] + reach)
        cpf, oab = F.rlike(near(terms.CPF_WINDOW), F.lit(tx.CPF_WORDS)), F.rlike(near(terms.OAB_WINDOW), F.lit(tx.OAB_WORDS))
        return s.withField("context", F.when(s["entity"] == "OAB_NUMBER", oab).when(s["entity"].isin("CPF", "CIN"), cpf))

    def with_words(every: Column, text: Column) -> Column:
        doubtful = F.exists(every, lambda s: s["entity"].isin("CPF", "CIN", "OAB_NUMBER"))
        plain = F.transform(every, lambda s: s.withField("context", F.lit(None).cast("boolean")))
        return F.when(doubtful, tx.let(chunks(text), lambda parts: F.transform(every, lambda s: told(parts, s)))).otherwise(plain)

    def spans_of(text: Column, numbers: Column, lists: Column, some: list[Rule]) -> Column:
        """What ``some`` rules find in a text, whose numbers and terms that are looked up are known."""
        words = sorted({w for r in some for w in r.words})
        own = F.struct(
            text.alias("text"),
            (_all_of(text, _words_of(words)) if words else F.lit("")).alias("words"),
            numbers.alias("numbers"),
            lists.alias("looked_up"),
        )
        hits = tx.let(own, lambda o: F.filter(F.array(*(tried(o, r) for r in some)), lambda r: r["marked"] != o["text"]))
        return tx.let(F.flatten(F.transform(hits, rows)), lambda every: with_words(every, text))

    def back(s: Column, table: Column) -> Column:
        return tx.let(traced(s["start"], s["end"], table), lambda p: s.withField("start", p["start"]).withField("end", p["end"]))

    def both(o: Column) -> Column:
        held = spans_of(o["near"]["text"], o["numbers"], o["looked_up"], near) if near else None
        if held is not None:
            step = F.array(F.struct(F.lit("").alias("source"), o["near"]["cuts"].alias("spans")))
            placed = lambda every: F.when((F.size(every) > 0) & (F.size(o["near"]["cuts"]) > 0), tx.let(tables(step), lambda t: F.transform(every, lambda s: back(s, t)))).otherwise(every)
            held = F.when(o["numbers"] != "", tx.let(held, placed)).otherwise(F.array().cast(RAW))
        rest = spans_of(o["text"], o["numbers"], o["looked_up"], far) if far else None
        return held if rest is None else rest if held is None else F.concat(held.cast(RAW), rest.cast(RAW))

    if not rules:
        return F.array().cast(RAW)
    lists = F.array(*(term_marks(list(r.terms))(text) for r in looked_up)).cast("array<string>")
    if not any(r.numbers for r in rules):
        return spans_of(text, F.lit(""), lists, rules)
    own = F.struct(text.alias("text"), lists.alias("looked_up"))
    cut_out = tx.let(own, lambda o: F.struct(o["text"].alias("text"), o["looked_up"].alias("looked_up"), near_digits(o["text"]).alias("near")))
    return tx.let(tx.let(cut_out, lambda o: o.withField("numbers", _all_of(o["near"]["text"], NUMBERS))), both)


def detect(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", raw: bool = False, by: str = "doc_id", keep: Iterable[str] = ()) -> DataFrame:
    """D: rows (by, *keep, entity, rule, score, start, end, found, context) of ``docs``. Unless ``raw``,
    spans below the threshold go (E9) and each entity's nested spans are reduced (E2)."""
    own = docs.select(by, *keep, clean_marks(F.col(text)).alias("__t"))
    spans = own.select(by, *keep, F.explode(span_array(F.col("__t"), RULES if rules is None else rules)).alias("s")).select(by, *keep, "s.*")
    return spans if raw else reduced(spans, by)


def detect_by_set(docs: DataFrame, sets: dict[str, list[Rule]], column: str = "rule_set", text: str = "text", by: str = "doc_id", keep: Iterable[str] = (), raw: bool = False) -> DataFrame:
    """D20 and D21 for groups of documents (courts, clients): ``column`` says which of the ``sets`` of rules is a document's. Each distinct
    rule is run once, over all documents, and spans stay that the rules of their document's set have found; a document of another set, or of none, has
    none. Rules of several sets may share a name. The same spans as a run for each set on its own documents."""
    every = list(dict.fromkeys(r for rules in sets.values() for r in rules))
    place = {r: str(k) for k, r in enumerate(every)}
    rows = [(name, place[r], r.name) for name, rules in sets.items() for r in dict.fromkeys(rules)]
    own = docs.sparkSession.createDataFrame(rows, "__set string, rule string, __name string")
    found = detect(docs, [r._replace(name=place[r]) for r in every], text, True, by, [*{column: 0, **dict.fromkeys(keep)}])
    met = found.join(own, (found[column] == own["__set"]) & (found["rule"] == own["rule"])).drop(own["rule"]).withColumn("rule", F.col("__name"))
    met = met.select(*found.columns)
    return met if raw else reduced(met, by)


def rule_problems(spark, rules: Iterable[Rule]) -> DataFrame:
    """(entity, rule, problem): rules that can't be run, to be told before a run: patterns that Java's regexes don't take or
    that match an empty text, names that stand twice in an entity, and scores out of 0 to 1."""
    compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    rows, seen = [], set()
    for r in rules:
        for pattern in (r.pattern, r.gate):
            try:
                if compile_(FLAGS + pattern).matcher("").find() and pattern == r.pattern:
                    rows.append((r.entity, r.name, "the pattern matches an empty text"))
            except IllegalArgumentException as e:
                rows.append((r.entity, r.name, str(e).split("\n")[0]))
        if (r.entity, r.name) in seen:
            rows.append((r.entity, r.name, "the name stands twice"))
        seen.add((r.entity, r.name))
        if not 0 <= r.score <= 1:
            rows.append((r.entity, r.name, f"the score is {r.score}"))
    return spark.createDataFrame(rows, "entity string, rule string, problem string")


def reduced(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """E9 and E2 on raw spans."""
    return dedupe_same_entity(above_threshold(rows, terms.MIN_SCORE), by)


def reduced_array(spans: Column) -> Column:
    """E9 and E2 inside a row."""
    return dedupe_array(F.filter(spans, lambda s: s["score"] >= terms.MIN_SCORE))


def with_context_array(spans: Column) -> Column:
    """E4 and E5 inside a row: each span with ``kept``."""
    kept = lambda s: F.when(s["entity"] == "OAB_NUMBER", F.rlike(s["found"], F.lit(r"(?iU)\bOAB\b")) | s["context"]).when(s["entity"].isin("CPF", "CIN"), tx.cpf_valid_of(s["found"]) | s["context"]).otherwise(True)
    return F.transform(spans, lambda s: s.withField("kept", kept(s)))


def with_context(spans: DataFrame) -> DataFrame:
    """``kept``: E4 (a CPF is valid or in context) and E5 (a bar number says so or is in context), for spans of ``detect``."""
    cpf = tx.cpf_valid(F.col("found")) | F.col("context")
    oab = F.col("found").rlike(r"(?iU)\bOAB\b") | F.col("context")
    kept = F.when(F.col("entity") == "OAB_NUMBER", oab).when(F.col("entity").isin("CPF", "CIN"), cpf).otherwise(True)
    return spans.withColumn("kept", kept)
