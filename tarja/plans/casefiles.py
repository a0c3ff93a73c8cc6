"""Views derived from ``documents`` by SQL that Spark and DuckDB both read.

``documents`` holds no Brazilian identifiers, so each row gets a heading with some, chosen by
doc_id, before its text. Two thirds of the CPF numbers are valid. ``nome`` is the front of one of the
text's lines, as a name may be cut from it."""

from __future__ import annotations

from pyspark.sql import DataFrame

_D = "cast(substring({0}, {1}, 1) as int)"


def _weighted(source: str, n: int) -> str:
    return "(" + " + ".join(f"{n + 1 - k} * {_D.format(source, k + 1)}" for k in range(n)) + ")"


def _check(source: str, n: int) -> str:
    r = f"({_weighted(source, n)} % 11)"
    return f"cast(case when {r} < 2 then 0 else 11 - {r} end as string)"


_HEADINGS = [
    "'Documento juntado: CPF nº ' || cpf || ', conferido com o CIN ' || raw11 || '.'",
    "'Trouxe cédula de identidade nº ' || substring(n9, 1, 7) || ' SSP/PA e RG: ' || substring(n9, 2, 6) || '.'",
    "'Petição de advogada, OAB/PA nº ' || substring(n9, 1, 5) || ', com cópia à OAB ' || substring(n9, 2, 5) || '/TO.'",
    "'Procurador da República, inscrição MT' || substring(n9, 1, 5) || ', juntada aos autos.'",
    "'Código interno MT' || substring(n9, 1, 5) || ' do almoxarifado e CPF ' || cpf || '.'",
    "'Mora na Avenida das Palmeiras, ' || substring(n9, 1, 3) || ', Bloco Norte, CEP ' || substring(n9, 1, 5) || '-' || substring(n9, 6, 3) || '.'",
    "'Terreno na Vicinal ' || substring(n9, 1, 2) || ' com Vicinal ' || substring(n9, 3, 2) || '; quadra ' || substring(n9, 1, 1) || ', lote ' || substring(n9, 2, 2) || '.'",
    "'Autos ' || substring(n9, 1, 7) || '-' || substring(n9, 8, 2) || '.2021.8.14.0301 e NB ' || substring(n9, 1, 3) || '.' || substring(n9, 4, 3) || '.' || substring(n9, 7, 3) || '-5.'",
    "'Depôs o perito Caio Bastos Nogueira, casado, servidor da FUNASA.'",
    "'Presentes na reunião de terça:' || chr(10) || 'HELENA VIANA TORRES (REQUERENTE)' || chr(10) || 'a tesoureira da COOPERATIVA DOS PESCADORES, sem voto'",
    "'Recibo assinado por JOÁQUIM  TELES MOREIRA, em duas vias.' || chr(10) || 'REQUERENTE: Joaquim Teles Moreira'",
    "'AUTORA: Beatriz Pires Falcão e outros' || chr(10) || 'matrícula SIAPE ' || substring(n9, 1, 7) || ' ativa'",
    "'Dra. TEREZA, relatora, atendeu no telefone (91) 9' || substring(n9, 1, 4) || '-' || substring(n9, 5, 4) || ' em 03/05/2022.'",
    "'Orçamento pedido à OFICINA DANIEL E IRMÃOS LTDA pelo endereço caixa' || n9 || '@exemplo.org até 21/09/2022.'",
    "'Escala de plantão: segunda, Dr. Eduardo; quinta, EDUARDO DA COSTA LEAL, SIAPE ' || substring(n9, 1, 7) || '; sexta, Eduardo da Costa, CNH ' || raw11",
]
#: A name that the headings hold, for masking by metadata.
METADATA_NAME = "Eduardo da Costa Leal"


def _case(values: list[str]) -> str:
    return "case doc_id % " + str(len(values)) + " " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"


_LINES = "(length(texto) - length(replace(texto, chr(10), '')) + 1)"
_FRONT = " || ' ' || ".join(f"split_part(linha, ' ', {k})" for k in range(1, 6))

CASE_FILES = f"""
SELECT doc_id, body, lang, source, n9, cpf, texto, {_FRONT} AS nome
FROM (SELECT *, split_part(texto, chr(10), cast(doc_id % {_LINES} + 1 as int)) AS linha
  FROM (SELECT doc_id, text AS body, lang, source, n9, cpf, {_case(_HEADINGS)} || chr(10) || text AS texto
    FROM (SELECT *, substring(raw11, 1, 3) || '.' || substring(raw11, 4, 3) || '.' || substring(raw11, 7, 3) || '-' || substring(raw11, 10, 2) AS cpf
      FROM (SELECT *, substring(t10, 1, 10) || cast((cast({_check("t10", 10)} as int) + case when doc_id % 3 = 0 then 1 else 0 end) % 10 as string) AS raw11
        FROM (SELECT *, n9 || {_check("n9", 9)} AS t10
          FROM (SELECT *, lpad(cast((doc_id * 7919 + 123456789) % 1000000000 as string), 9, '0') AS n9 FROM {{documents}}) a) b) c) d) e) f
"""


def case_files(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.sql(CASE_FILES, documents=docs)
