"""Masking of names: names by role and context, by metadata, by list."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as tx
from ..sources.shared import run_folder, written
from .spans import LOCATED, NO_SPANS, STEPS, apart, chunks, clean_marks, cut, find_matches, find_spans, merge_array, outside_all, splice_array, step

#: Words of a name list that go into the plan, as one set that each row looks its words up in. A longer list is joined.
LISTED = 50_000
#: Of a list of up to so many words it is asked first whether a text holds any of them.
TRIED = 200


def mask_names(text: Column, names: Column, placeholder: str) -> Column:
    """Each name replaced wherever it stands, longest first, with any accents, case and spacing."""
    order = F.array_sort(F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))))
    return F.when(F.size(names) == 0, text).otherwise(F.aggregate(order, text, lambda acc, s: F.regexp_replace(acc, tx.accent_flexible_pattern(s["n"]), F.lit(placeholder))))


def mask_names_in_steps(text: Column, names: Column, placeholder: str, source: str) -> Column:
    """N1 as struct<text, steps>: the same text, and a step for each name that stands in it."""
    order = F.array_sort(F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))))
    start = F.struct(text.alias("text"), F.array().cast(STEPS).alias("steps"))

    def one(acc: Column, s: Column) -> Column:
        def of(x: Column) -> Column:
            done = F.struct(splice_array(acc["text"], x).alias("text"), F.concat(acc["steps"], step(source, x)).alias("steps"))
            return F.when(F.size(x) > 0, done).otherwise(acc)

        return tx.let(put_all(find_spans(acc["text"], tx.accent_flexible_pattern(s["n"])), placeholder), of)

    return F.when(F.size(names) == 0, start).otherwise(F.aggregate(order, start, one))


#: A letter and the mark behind it, by the one sign that stands for both.
_PAIRS = {unicodedata.normalize("NFD", c): c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) == 2 and unicodedata.normalize("NFD", c)[0].isascii()}
_MARKED = f"[A-Za-z][{tx.char_class({p[1] for p in _PAIRS})}]"


def composed_spans(text: Column) -> Column:
    """array<struct<start, end, put>>: where a letter and a mark stand for one letter of names (NFC of Latin letters with one mark)."""
    none = F.array().cast("array<struct<start:int,end:int,put:string>>")
    # the pairs begin with a letter and end with a mark, so a pair can only stand at an even place
    at = lambda s: F.instr(F.lit("".join(_PAIRS)), s["found"])
    found = F.filter(find_matches(text, _MARKED), lambda s: at(s) > 0)
    put = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(F.lit("".join(_PAIRS.values())), F.shiftright(at(s), 1) + 1, F.lit(1)).alias("put")))
    return F.when(F.rlike(text, F.lit(_MARKED)), put).otherwise(none)


_TERMS = rf"(?iU)(?:{'|'.join(tx.flexible(t).replace('SS', '(?:SS|ß)').replace(' ', '[^A-Za-z]+') for t in terms.COMPANY_TERMS)})(?![A-Za-z0-9])"
#: One of these matches in every text with a company's name: a term of COMPANY_TERMS with any accents that begins with a capital, or that stands right behind
#: a sign, or a letter without plain form, of such a name. Two S may be written as one letter.
_SOME_FIRM = [rf"(?={tx.begins(terms.COMPANY_TERMS, capital=True)})(?<![A-Za-z0-9]){_TERMS}", rf"[.&/\-ØøÆæÐðÞþ]{_TERMS}"]


def company_spans(text: Column) -> Column:
    """Runs of capitalised words that hold a company term, merged. They are looked for only where some term stands."""

    def of(t: Column, pattern: str) -> Column:
        named = F.filter(find_matches(t, pattern.replace("(?U)", "(?U)(?=[A-ZÀ-Ý])", 1)), lambda s: tx.contains_term(tx.normalize_filter(s["found"]), terms.COMPANY_TERMS))
        return F.transform(named, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    both = lambda t: merge_array(F.concat(of(t, tx.COMPANY_UPPER), of(t, tx.COMPANY_MIXED)))
    return tx.let(text, lambda t: F.when(F.rlike(t, F.lit(_SOME_FIRM[0])) | F.rlike(t, F.lit(_SOME_FIRM[1])), both(t)).when(t.isNotNull(), F.array().cast(NO_SPANS)))


def with_open_spans(df: DataFrame, text: str, spans: str) -> DataFrame:
    """``df`` with its column ``spans``, array<struct<start, end>>, reduced to those that N2 and N4 may mask: not inside a
    company's name, not near an address word, not beside < or >. Companies are looked for only if there are spans.

    One column after another, as Spark resolves nested functions level by level."""
    none = F.array().cast(NO_SPANS)
    some = F.size(spans) > 0

    def near(own: Column) -> Column:
        def good(parts: Column, x: Column) -> Column:
            a, z = x["start"], x["end"]
            address = F.rlike(cut(parts, a - terms.ADDRESS_WINDOW, z + terms.ADDRESS_WINDOW), F.lit(tx.ADDRESS_WORDS))
            return ~address & (cut(parts, a - 1, a) != "<") & (cut(parts, z, z + 1) != ">")

        return tx.let(chunks(own["text"]), lambda parts: F.filter(own["spans"], lambda x: good(parts, x)))

    df = df.withColumn("__firms", F.when(some, company_spans(F.col(text))).otherwise(none))
    df = df.withColumn(spans, F.when(some, tx.let(F.struct(F.col(spans).alias("spans"), F.col("__firms").alias("firms")), lambda o: outside_all(o["spans"], o["firms"]))).otherwise(none))
    return df.withColumn(spans, F.when(some, tx.let(F.struct(F.col(text).alias("text"), F.col(spans).alias("spans")), near)).otherwise(none)).drop("__firms")


def spliced(text: str, spans: str, placeholder: str) -> Column:
    return tx.let(F.struct(F.col(text).alias("text"), F.col(spans).alias("spans")), lambda o: splice_array(o["text"], put_all(o["spans"], placeholder)))


def put_all(spans: Column, placeholder: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(placeholder).alias("put")))


def name_index(names: DataFrame) -> DataFrame:
    """The distinct normalized words (``token``) of a list (``value``) that N4 masks."""
    blocked = [t for t in {*terms.NOT_A_NAME, *terms.COMPANY_TERMS} if " " not in t]
    word = tx.normal(F.col("w"))
    own = names.select(F.explode(tx.tokenize(F.col("value"))).alias("w")).select(word.alias("token"))
    return own.where((F.length("token") >= 3) & ~F.col("token").isin([*terms.CONNECTORS, *sorted(blocked)])).distinct()


def listed_words(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(k1, k2, listed): for each text that has any, by two hashes of it, its words that are in the index.

    Distinct words are looked up, not their occurrences; Spark's own size check decides whether the
    index is broadcast. Texts go by their content, so ids play no part."""
    every = F.array_distinct(F.transform(F.array_distinct(tx.tokenize(F.col("text"))), tx.normal))
    words = docs.select(*_content(), F.explode(every).alias("token"))
    return words.join(index, "token", "left_semi").groupBy("k1", "k2").agg(F.collect_set("token").alias("listed"))


def _content() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2")]


def small_list(index: DataFrame, most: int = LISTED) -> list[str] | None:
    """The words of an index that is small enough for the plan."""
    words = [r["token"] for r in index.select("token").limit(most + 1).collect()]
    return words if len(words) <= most else None


def listed_in_row(docs: DataFrame, words: list[str]) -> DataFrame:
    """``docs`` with ``__listed``: the words of its text that are in the list, or null."""
    every = F.array_distinct(F.transform(F.array_distinct(tx.tokenize(F.col("text"))), tx.normal))
    if not words:
        return docs.withColumn("__listed", F.lit(None).cast("array<string>"))
    known = [w for w in words if re.fullmatch(tx.LETTERS, w)]
    if 0 < len(known) <= TRIED:  # a text that holds none of them, in any spelling, isn't cut into words
        letter = tx.LETTERS.removesuffix("+")
        some = rf"(?={tx.begins(known)})(?iu)(?<!{letter})(?:{'|'.join(map(tx.flexible, known))})(?!{letter})"
        every = F.when(F.rlike("text", F.lit(some)), every).otherwise(F.array().cast("array<string>"))
    found = docs.withColumn("__words", every).withColumn("__listed", F.expr(f"filter(__words, w -> w IN ({', '.join(map(tx.sql_string, words))}))"))
    return found.withColumn("__listed", F.when(F.size("__listed") > 0, F.col("__listed"))).drop("__words")


def listed_by_join(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The same for a long list. What texts have found is written, so that a text with very many copies can be split."""
    one, two = _content()
    listed = written(listed_words(docs, index), run_folder(docs.sparkSession), "listed")
    listed = listed.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("listed").alias("__listed"))
    return docs.join(listed, (one == F.col("__k1")) & (two == F.col("__k2")), "left").drop("__k1", "__k2")


def with_listed_spans(docs: DataFrame, index: DataFrame | list[str], out: str) -> DataFrame:
    """``docs`` with N4's spans, array<struct<start, end>>, as the column ``out``. A list of up to LISTED words, or one given as such, is looked
    up inside the row, and no text moves; a longer one is joined with the distinct words of texts."""
    words = index if isinstance(index, list) else small_list(index)
    met = listed_by_join(docs, index) if words is None else listed_in_row(docs, words)
    # only the document's listed words are looked for, as whole words with any accents
    letter = tx.LETTERS.removesuffix("+")
    word = F.concat(F.lit(f"(?iu)(?<!{letter})(?:"), F.array_join(F.transform("__listed", tx.flexible_words), "|"), F.lit(f")(?!{letter})"))
    hits = F.when(F.col("__listed").isNotNull(), find_spans(F.col("text"), word)).otherwise(F.array().cast(NO_SPANS))
    return with_open_spans(met.withColumn(out, hits).drop("__listed"), "text", out)


def mask_common_names(docs: DataFrame, index: DataFrame | list[str], placeholder: str = terms.NAME_PLACEHOLDER, steps: str = "") -> DataFrame:
    """``docs`` with each listed word replaced, unless it stands in a company's name, in an address,
    or beside < or >. ``steps``: a column of steps that takes this one too."""
    found = with_listed_spans(docs, index, "__hits")
    cols = {"text": F.when(F.size("__hits") > 0, spliced("text", "__hits", placeholder)).otherwise(F.col("text"))}
    if steps:
        cols[steps] = F.concat(steps, step("list", put_all(F.col("__hits"), placeholder)))
    return found.withColumns(cols).select(*docs.columns)


def clean_metadata_names(names: Column) -> Column:
    """The names of N2: those that look like persons, cleaned, distinct."""
    good = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: tx.looks_like_person(n))
    return F.array_sort(F.array_distinct(F.transform(good, tx.clean_metadata_name)))


#: Letters with accents that a name's letters match, and signs that a case-insensitive match takes for plain ones.
_ACCENTED = "".join(v for letters in tx.VARIANTS.values() for v in letters[1:])
_BARE = "".join(base * (len(letters) - 1) for base, letters in tx.VARIANTS.items())
_ODD, _EVEN = "\u017f\u0131\u0130\u212a", "siik"


def _bare(word: Column) -> Column:
    """A word as the patterns of B9 compare it."""
    return F.translate(F.lower(F.translate(word, _ODD, _EVEN)), _ACCENTED, _BARE)


def _runs(text: Column, variants: Column) -> Column:
    """array<struct<start, end, found>>: where one of the ``variants`` (arrays of bare words) stands as whole words with nothing but white space between them.

    Only words that stand in some variant are cut out of the text, in one pass; another word between two of them shows in what lies between. Of
    these, only words that some variant begins with are looked at. Occurrences of one variant don't overlap, the first counts."""

    def of(o: Column) -> Column:
        w, bare = o["words"], o["bare"]

        def fits(i: Column, v: Column) -> Column:
            inner = F.sequence(F.lit(0), F.size(v) - 1)
            spaced = lambda k: (k == 0) | F.rlike(cut(o["parts"], F.get(w, i + k - 1)["end"], F.get(w, i + k)["start"]), F.lit(r"(?U)^\s+$"))
            return (F.slice(bare, i + 1, F.size(v)) == v) & F.forall(inner, spaced)

        def found(heads: Column, v: Column) -> Column:
            own = F.filter(heads, lambda i: (F.get(v, F.lit(0)) == F.get(bare, i)) & fits(i, v))
            own = apart(F.transform(own, lambda i: F.struct(i.alias("start"), (i + F.size(v)).alias("end"))))
            return F.transform(own, lambda x: F.struct(F.get(w, x["start"])["start"].alias("start"), F.get(w, x["end"] - 1)["end"].alias("end")))

        firsts = F.array_distinct(F.transform(variants, lambda v: F.get(v, F.lit(0))))
        heads = tx.let(firsts, lambda f: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(f, F.get(bare, i))))
        spans = F.array_distinct(F.flatten(tx.let(heads, lambda h: F.transform(variants, lambda v: found(h, v)))))
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), cut(o["parts"], x["start"], x["end"]).alias("found")))

    wanted = F.replace(tx.flexible_words(F.array_join(F.array_distinct(F.flatten(variants)), " ")), F.lit(r"\s+"), F.lit("|"))
    words = tx.let(F.struct(text.alias("text"), F.concat(F.lit(r"(?iU)\b(?:"), wanted, F.lit(r")(?!\w)")).alias("wanted")), lambda o: find_matches(o["text"], o["wanted"]))
    cut_once = lambda w: F.struct(w.alias("words"), F.transform(w, lambda x: _bare(x["found"])).alias("bare"), chunks(text).alias("parts"))
    return tx.let(words, lambda w: F.when(F.size(w) > 0, tx.let(cut_once(w), of)).otherwise(F.array().cast(LOCATED)))


def with_metadata_name_spans(df: DataFrame, text: str, names: str, out: str) -> DataFrame:
    """N2's spans, array<struct<start, end>>, merged, as the column ``out``, for cleaned ``names``: each name and its variants, and an honorific with
    a first name that only one of the names has; spans in companies, addresses and placeholders go. The text is cut into words once, whatever the number of
    names; names none of whose words begin a word of the text cost one pass."""
    none = F.array().cast("array<string>")
    some = (F.size(names) > 0) & (F.col(text) != "")
    df = df.withColumn("__firsts", F.transform(names, tx.first_name))
    first_words = F.array_join(F.transform(F.filter(F.transform(names, tx.first_word), lambda w: w != ""), tx.flexible_words), "|")
    df = df.withColumn("__any", some & (first_words != "") & F.rlike(F.col(text), F.concat(F.lit(r"(?iU)(?<!\w)(?:"), first_words, F.lit(r")(?!\w)"))))
    variants = F.array_distinct(F.flatten(F.transform(names, tx.name_variants)))
    df = df.withColumn("__variants", F.when(F.col("__any"), F.transform(variants, lambda v: F.transform(F.split(v, " "), _bare))).otherwise(F.array().cast("array<array<string>>")))
    runs = tx.let(F.struct(F.col(text).alias("text"), F.col("__variants").alias("variants")), lambda o: _runs(o["text"], o["variants"]))
    df = df.withColumn(out, F.when(F.size("__variants") > 0, runs).otherwise(F.array().cast(LOCATED)))

    def lonely(firsts: Column) -> Column:
        token = F.transform(firsts, tx.normal)
        return tx.let(token, lambda t: F.filter(firsts, lambda f, i: (f != "") & (F.size(F.filter(t, lambda x: x == F.get(t, i))) == 1)))

    df = df.withColumn("__firsts", F.when(F.col("__any"), tx.let(F.col("__firsts"), lonely)).otherwise(none))
    titled = F.concat(F.lit(rf"(?iU)\b{tx.HONORIFIC}\s+(?:"), F.array_join(F.transform("__firsts", tx.flexible_words), "|"), F.lit(r")\b"))
    short = tx.let(F.struct(F.col(text).alias("text"), titled.alias("pattern")), lambda o: find_matches(o["text"], o["pattern"]))
    df = df.withColumn(out, F.concat(out, F.when(F.size("__firsts") > 0, short).otherwise(F.array().cast(LOCATED))))
    named = F.filter(out, lambda s: ~tx.semantically_blocked(s["found"]))
    df = df.withColumn(out, F.array_distinct(F.transform(named, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    df = with_open_spans(df, text, out)
    return df.withColumn(out, merge_array(F.col(out))).drop("__firsts", "__any", "__variants")


def mask_metadata_names(docs: DataFrame, placeholder: str = terms.NAME_PLACEHOLDER, steps: str = "") -> DataFrame:
    """``docs`` (text, names, ...) with the names masked, and the metrics. All inside the row. ``steps``: the name of a new
    column for what was done."""
    own = docs.withColumn("__t", clean_marks(F.coalesce(F.col("text"), F.lit("")))).withColumn("__names", clean_metadata_names(F.col("names")))
    own = with_metadata_name_spans(own, "__t", "__names", "__spans")
    some = F.col("__t") != ""
    return own.withColumns(
        {
            "text": F.when(F.size("__spans") > 0, spliced("__t", "__spans", placeholder)).otherwise(F.col("text")),
            "metadado_nome_identificado": (F.size("__names") > 0) & some,
            "metadado_nomes_pf_total": F.when(some, F.size("__names")).otherwise(0),
            "metadado_ocorrencias_forcadas": F.size("__spans"),
            **({steps: step("metadata", put_all(F.col("__spans"), placeholder))} if steps else {}),
        }
    ).drop("__t", "__names", "__spans")
