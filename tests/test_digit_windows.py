"""Rules whose matches hold a digit see only what stands near digits, and find the same."""

import random

from pyspark.sql import functions as F

from tarja.functions.patterns import around_digit
from tarja.operators import detect as dt

PARTS = [
    "CPF: 123.456.789-09", "OAB/PA nº 12345", "oab   12.345 / TO", "MT12345", "(91) 91234-5678", "CEP 01234-567", "1234567", "12345678901", "NB 123.456.789-5",
    "Carteira de Identidade Nacional nº 123.456.789-09", "carteira" + " " * 11 + "de identidade nacional: 12345678909", "cpf" + " " * 40 + "12345678909", "OAB\n\n" + "\t" * 30 + "PA 12345",
    "RG abc-" + "x" * 300 + "9", "rg: X-12 SSP/PA", "1234567-12.2021.8.14.0301", "١٢٣٤٥٦٧", "ID 12345678", "CRM PA - 12", "RNM ABCDEFG", "cnh 12345678901", "9", "\u0003", "advogada", "inscrição",
]
WORDS = "se al pa to ma cpf oab juntada aos autos é palavra, longa; 𝒳 ́ \u0003".split()


def texts():
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    made = [r.choice(["", " "]).join(r.choice([r.choice(PARTS), prose(r.choice([1, 3, 40, 90, 200])), "z" * r.choice([98, 99, 199, 200, 201, 399, 400, 401])]) for _ in range(r.randint(1, 7))) for _ in range(400)]
    return [*made, *("z" * a + " 1234567 " + "z" * b for a in (0, 199, 200, 201) for b in (0, 99, 299, 300, 301, 500)), "", "z" * 1000, None]


def test_f11_rules_near_digits_find_what_they_find_in_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(4)
    rules = [*dt.RULES, dt.Rule("PROTOCOLO", "linha", r"\bautos\s+\d+\b", 0.9, numbers=r"\d")]
    found = lambda: sorted(map(repr, dt.detect(docs, rules, raw=True).collect()))
    near = found()
    assert sum(dt.at_digits(x) for x in rules) > 20
    monkeypatch.setattr(dt, "at_digits", lambda r: False)
    assert near == found()
    assert len(near) > 500


def test_f11_a_long_text_is_cut_down_to_its_digits(spark):
    docs = spark.createDataFrame([("z" * 5000 + " 123 " + "z" * 5000,), ("z" * 5000,), ("1" + " " * 600 + "z" * 600,)], "t string")
    own = [r["n"]["text"] for r in docs.select(dt.near_digits(F.col("t")).alias("n")).collect()]
    assert len(own[0]) < 600 and "123" in own[0]
    assert own[1] == dt.GAP
    assert len(own[2]) == 1201  # more white space in a row than rules are bounded for


def test_f11_only_bounded_rules_that_hold_a_digit_are_cut_down():
    assert around_digit(r"\bCPF\s*\d{3}\b", 12) == 19
    for pattern in (r"\d+", r"a{2}", r"\d?a", r"[\da]", r"RG(?=[A-Z]*\d)\d", r"(?:\s|\.)*\d", r"(?<!\G)\d", r"\d|a"):
        assert around_digit(pattern, 12) is None
    by = {r.name: dt.at_digits(r) for r in dt.RULES}
    assert by["cpf_com_rotulo"] and by["numero_processo_cnj"] and not by["rg_com_rotulo"] and not by["logradouro_prefixado"] and not by["numero_rnm"]


def test_f7_rules_find_what_their_patterns_say(spark):
    """Look-aheads and bounds before a pattern's flags take no match away."""
    from tarja.operators import spans as sp

    odd = ["ſetor Um", "KASADO", "ıd12345678 İD 12345678", "écasado casadó casadó", "‿casado casado‍x", "av. Sé 1, av́ x y", "é Se,SE_se-SE", "PRAÇA X 1, 2, Centro", "pje ſergipe río"]
    docs = spark.createDataFrame(list(enumerate([t for t in texts() if t][:150] + odd)), "doc_id long, text string").repartition(4)
    got = sorted(map(repr, dt.detect(docs, dt.RULES, raw=True).select("doc_id", "rule", "start", "end", "found").collect()))
    def of(r):
        return F.transform(sp.find_matches(F.col("t"), dt.FLAGS + r.pattern), lambda s: F.struct(F.lit(r.name).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))

    own = F.array(*map(of, dt.RULES))
    plain = docs.select("doc_id", sp.clean_marks(F.col("text")).alias("t")).select("doc_id", F.explode(F.flatten(own)).alias("s")).select("doc_id", "s.*")
    assert got == sorted(map(repr, plain.collect()))


def test_f5_the_admission_is_written_once(spark, tmp_path):
    from tarja.plans.anonymize import anonymize_pdf_corpus

    docs = spark.sql("SELECT 1L AS doc_id, 10L AS size_bytes, 2 AS page_count, map('author', 'Ana Souza Lima') AS metadata")
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "Ana Souza Lima a")], "doc_id long, page_no int, text string")
    admitted, done = anonymize_pdf_corpus(docs, pages)
    assert "Aggregate" not in admitted._jdf.queryExecution().toString()
    assert [(r["status"], r["names"]) for r in admitted.collect()] == [("ok", ["Ana Souza Lima"])]
    assert [r["text"] for r in done.documents.collect()] == ["<NOME> ab"]
    done.release()
    from tarja.sources.shared import exists

    assert not exists(spark, done.folder) and not exists(spark, done.admission)


def test_f5_pages_of_a_text(spark, tmp_path):
    from tarja.queries import _pages

    own = ["", None, "x" * 1000, "\U0001d4b3" * 1001 + "\n", "y" * 2500]
    spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["page_no"], r["text"]) for r in _pages(spark, str(tmp_path)).collect())
    want = [(i, k + 1, t and t[k * 1000 : k * 1000 + 1000]) for i, t in enumerate(own) for k in range(max(1, -(-len(t or "") // 1000)))]
    assert got == want
    assert "substring(" not in _pages(spark, str(tmp_path))._jdf.queryExecution().toString()
