"""What the third round's findings were about."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tarja.functions import terms
from tarja.operators import detect as dt
from tarja.operators import names as nm
from tarja.queries import QUERIES, SQL
from tarja.sources import documents as src

from .compare import rows, spark_rows


def table(spark, folder, texts):
    """A folder with ``documents`` of these texts."""
    own = [(i, t, ["en", "es", "fr", "de", "und"][i % 5], "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def of_sql(name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    res = con.execute(SQL[name])
    names = [c[0] for c in res.description]
    return rows(names, res.fetchall()), sorted(names)


NUMBERS = [
    "1234567890a12345678901",
    'key "ab1234567890c12345678901d1234567890_1234567890f"',
    "x1234567890 1234567890\n1234567890+33 1234567890x+33 1234567890",
    "1234567890é1234567890é1234567890é1234567890",
    "_+331234567890_+31234567890-1234567890,1234567890/1234567890",
    "1234567890",
    "",
]


def test_f1_phone_numbers_beside_letters(spark, tmp_path):
    folder = table(spark, tmp_path, NUMBERS)
    assert spark_rows(QUERIES["d18_phone"](spark, folder)) == of_sql("d18_phone", folder)


def test_f1_the_rule_still_finds_both(spark):
    docs = spark.createDataFrame([(1, "1234567890a12345678901")], "doc_id long, text string")
    found = dt.detect(docs, dt.rules_for(["PHONE_NUMBER"])).orderBy("start").collect()
    assert [r["found"] for r in found] == ["1234567890", "12345678901"]


ODD = [
    "cpf: 123.456.789-01; CIN 12345678901, \u0131d 12345678, \u0130D12345678 e \u017fiape 1234567, RG: X-12 e rg 1234",
    "MT12345 mt. 12345 (PA)1234 /SC1234 xSC1234 oab/pa n\u00ba 1.234 CEP-01234567 cep\u00a012345-678",
    "Av. Sete, 12, Centro; PRA\u00c7A da S\u00e9 10\nru\u00e1 x; ra 5; qd.7 lt 3; Setor Norte; CONDOM\u00cdNIO Sul, 9",
    "\u0661\u0662\u0663.\u0661\u0662\u0663.\u0661\u0662\u0663-\u0661\u0662 1234567 (91) 91234-5678 9123-4567 NB 1.234.567-X RNM ABC1234567 CRM pa - 12",
    "S\u00c3O PAULO, Senhor(a) e\u0301 casado, Pje - Processo Judicial Eletr\u00f4nico; 1/2/2020 SE, \u212aASADO",
    "", "sem nada", None,
]


def test_f3_one_pass_for_words_and_numbers_loses_no_match(spark):
    """Rules that are asked of the shared passes find what they find when they are run on every text."""
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    plain = [r._replace(words=(), numbers="", gate="") for r in dt.RULES]
    found = lambda rules: sorted(map(tuple, dt.detect(docs, rules, raw=True).select("doc_id", "rule", "start", "end", "found").collect()))
    assert found(dt.RULES) == found(plain)
    assert {r.name for r in dt.RULES if not (r.words or r.numbers)} == {"email"}


def test_f3_spans_are_found_once(spark, tmp_path):
    plan = QUERIES["e1_drop_contained"](spark, table(spark, tmp_path, NUMBERS))._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan


def test_f2_no_company_is_lost_by_asking_for_its_terms(spark):
    texts = ["A.me Bela", "F\u00f8me Um", "Casa Inss", "CASA IN\u00df", "Boa Associa\u00e7\u00e3o", "A\u00dfOCIACAO Boa", "loja me", "Uni\u00e3o Sul", "\u00c9 S/A X", "Banco ME-EPP", "MINISTERIO  PUBLICO", "Me Diga"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = F.col("text").rlike(nm._SOME_FIRM[0]) | F.col("text").rlike(nm._SOME_FIRM[1])
    named = lambda p: F.exists(nm.find_matches(F.col("text"), p), lambda s: nm.tx.contains_term(nm.tx.normalize_filter(s["found"]), terms.COMPANY_TERMS))
    told = docs.select("text", some.alias("some"), (named(nm.tx.COMPANY_UPPER) | named(nm.tx.COMPANY_MIXED)).alias("firm"), F.size(nm.company_spans(F.col("text"))).alias("n")).collect()
    assert [r["text"] for r in told if r["firm"] != (r["n"] > 0) or (r["firm"] and not r["some"])] == []
    assert sum(r["firm"] for r in told) > 5


def test_f15_snapshots_are_written_in_small_batches(spark, tmp_path, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"value": [f"{b.num_rows} {b.nbytes}"]})

    monkeypatch.setattr(src, "_arrays", sizes)
    run = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), F.lit(40_000)).alias("input"), F.lit("y").alias("output"), F.expr("cast(array() as array<struct<entity:string,text:string>>)").alias("entities"))
    src.write_snapshot(run, str(tmp_path / "s"))
    seen = [tuple(map(int, r["value"].split())) for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert sum(n for n, _ in seen) == 3000
    assert max(n for n, _ in seen) <= 500 and max(size for _, size in seen) < 30 * 1024 * 1024
