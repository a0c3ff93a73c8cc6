"""The whole flow on texts whose exact results are fixed, batch and stream."""

import json
from collections import Counter

from tarja.functions import terms
from tarja.operators import names as nm
from tarja.plans.anonymize import anonymize
from tarja.streaming.requests import anonymize_stream, read_answers, read_requests

from .golden_cases import CASES, NOT_COMPARED, TITLES

#: Among other names, those of the cases.
NAMES = [*terms.SAMPLE_NAMES, "SOUZA", "RODRIGUES", "SANTOS", "FERNANDES", "MACIEL"]


def index(spark):
    return nm.name_index(spark.createDataFrame([(n,) for n in NAMES], "value string"))


def wanted(case):
    return Counter(e for e in case["entities"] if e[0] not in NOT_COMPARED)


def test_golden_cases(spark):
    docs = spark.createDataFrame([(i, c["input"], c.get("names", [])) for i, c in enumerate(CASES)], "doc_id long, text string, names array<string>")
    done = anonymize(docs, index(spark), titles=TITLES)
    texts = {r["doc_id"]: r["text"] for r in done.documents.collect()}
    entities = {i: Counter() for i in texts}
    for r in done.entities.collect():
        if r["entidade"] not in NOT_COMPARED:
            entities[r["doc_id"]][r["entidade"], r["texto_detectado"]] += 1
    for i, c in enumerate(CASES):
        assert texts[i] == c["output"], c["id"]
        assert entities[i] == wanted(c), c["id"]


def test_golden_cases_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"doc_id": i, "texto": c["input"], "nomes_metadados": c.get("names", [])}, ensure_ascii=False) for i, c in enumerate(CASES)]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines), encoding="utf-8")
    anonymize_stream(read_requests(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), index(spark), TITLES, availableNow=True).awaitTermination()
    answers = read_answers(spark, str(tmp_path / "out")).collect()
    assert len(answers) == len(CASES)
    for r in answers:
        case = CASES[r["doc_id"]]
        assert r["texto_anonimizado"] == case["output"]
        assert Counter((e["entidade"], e["texto_detectado"]) for e in r["entidades"] if e["entidade"] not in NOT_COMPARED) == wanted(case)
