"""Whole texts with their exact results."""

# Inputs, metadata names, outputs and entities that results must agree on.
CASES = [
    {
        "id": "cpf_cin_rotulo",
        "input": "CPF: 926.511.422-72; CIN 12345678909",
        "output": "<CPF/CIN>; <CPF/CIN>",
        "entities": [("CPF", "CPF: 926.511.422-72"), ("TERMO_COMUM", "CPF"), ("CPF", "CIN 12345678909"), ("ID_DOCUMENTO", "12345678909"), ("PHONE_NUMBER", "12345678909")],
    },
    {
        "id": "rg_contexto_forte",
        "input": "portador da cédula de identidade nº 255353 SESP/RR",
        "output": "portador da <NUMERO RG>",
        "entities": [("RG_NUMBER", "cédula de identidade nº 255353 SESP/RR"), ("SAFE_LOCATION", "RR")],
    },
    {
        "id": "oab_com_prefixos",
        "input": "OAB/GO Nº 49.904; OAB 49904/GO; OAB GO 49904",
        "output": "<OAB>; <OAB>; <OAB>",
        "entities": [
            ("TERMO_COMUM", "OAB"),
            ("OAB_NUMBER", "OAB/GO Nº 49.904"),
            ("SAFE_LOCATION", "GO"),
            ("TERMO_COMUM", "OAB"),
            ("OAB_NUMBER", "OAB 49904/GO"),
            ("SAFE_LOCATION", "GO"),
            ("LOCATION", "GO"),
            ("TERMO_COMUM", "OAB"),
            ("OAB_NUMBER", "OAB GO 49904"),
            ("SAFE_LOCATION", "GO"),
            ("LOCATION", "GO"),
        ],
    },
    {
        "id": "oab_uf_numero_com_contexto",
        "input": "REPRESENTANTES POLO ATIVO: FULANO - GO20508 e BELTRANO - GO38362",
        "output": "REPRESENTANTES POLO ATIVO: FULANO - <OAB> e BELTRANO - <OAB>",
        "entities": [("TERMO_COMUM", "POLO"), ("TERMO_COMUM", "POLO ATIVO"), ("OAB_NUMBER", "GO20508"), ("OAB_NUMBER", "GO38362")],
    },
    {
        "id": "oab_uf_numero_sem_contexto",
        "input": "Texto aleatório com GO20508 sem contexto nenhum",
        "output": "Texto aleatório com GO20508 sem contexto nenhum",
        "entities": [],
    },
    {
        "id": "endereco_ra_cep",
        "input": "residente no endereço Ra Estrela Celeste, 1397, Professora Araceli, CEP: 69306-685",
        "output": "residente no endereço <ENDERECO>, <CEP>",
        "entities": [
            ("ENDERECO_LOGRADOURO", "Ra Estrela Celeste, 1397, Professora Araceli"),
            ("LOCATION", "Ra Estrela Celeste"),
            ("TERMO_COMUM", "Professora"),
            ("TERMO_COMUM", "CEP"),
            ("CEP_NUMBER", "CEP: 69306-685"),
        ],
    },
    {
        "id": "vicinal_composta",
        "input": "ENDEREÇO: Vicinal 02 com Vicinal 16, Nº s/n, Bairro: Vila Reislândia/ Paredão",
        "output": "ENDEREÇO: <ENDERECO>, Nº s/n, Bairro: Vila Reislândia/ Paredão",
        "entities": [
            ("ENDERECO_LOGRADOURO", "Vicinal 02 com Vicinal 16"),
            ("LOCATION", "Vicinal"),
            ("TERMO_COMUM", "Bairro"),
            ("LOCATION", "Bairro"),
            ("TERMO_COMUM", "Vila"),
            ("LOCATION", "Vila"),
            ("LOCATION", "Paredão"),
        ],
    },
    {
        "id": "nit_nb_numero_longo",
        "input": "NIT 12732444032 NB 7107032446 e processo 1004207-64.2023.4.01.4200",
        "output": "NIT 12732444032 NB 7107032446 e processo 1004207-64.2023.4.01.4200",
        "entities": [
            ("ID_DOCUMENTO", "12732444032"),
            ("TERMO_COMUM", "NB"),
            ("ID_DOCUMENTO", "7107032446"),
            ("PHONE_NUMBER", "7107032446"),
            ("TERMO_COMUM", "processo"),
            ("ID_DOCUMENTO", "1004207-64.2023.4.01.4200"),
            ("SIAPE", "1004207"),
            ("DATE_TIME", "4.01.4200"),
        ],
    },
    {
        "id": "nome_contextual",
        "input": "O autor Ejohnson Rodrigues Souza, brasileiro, solteiro, está recorrendo à Justiça.",
        "output": "O autor <NOME>, brasileiro, solteiro, está recorrendo à Justiça.",
        "entities": [
            ("TERMO_COMUM", "autor"),
            ("LEGAL_TITLE", "autor"),
            ("TERMO_COMUM", "NOME"),
            ("ESTADO_CIVIL", "solteiro"),
            ("TERMO_COMUM", "Justiça"),
            ("ORGANIZACAO_CONHECIDA", "Justiça"),
            ("LOCATION", "Justiça"),
        ],
    },
    {
        "id": "reu_pf_parenteses",
        "input": "ANTONIO MARCOS MACIEL FERNANDES (REU)\nINSTITUTO BRASILEIRO DO MEIO AMBIENTE E DOS RECURSOS NATURAIS RENOVAVEIS (AUTOR)",
        "output": "<NOME> (REU)\nINSTITUTO BRASILEIRO DO MEIO AMBIENTE E DOS RECURSOS NATURAIS RENOVAVEIS (AUTOR)",
        "entities": [("TERMO_COMUM", "NOME"), ("TERMO_COMUM", "REU"), ("TERMO_COMUM", "INSTITUTO"), ("LEGAL_TITLE", "AUTOR"), ("TERMO_COMUM", "AUTOR")],
    },
    {
        "id": "nome_pf_variacao_acento",
        "input": "REQUERIDO: ANTONIO MARCOS MACIEL FERNANDES. O réu ANTÔNIO MARCOS MACIEL FERNANDES apresentou contestação.",
        "output": "REQUERIDO: <NOME>. O réu <NOME> apresentou contestação.",
        "entities": [
            ("LEGAL_TITLE", "REQUERIDO"),
            ("TERMO_COMUM", "REQUERIDO"),
            ("TERMO_COMUM", "NOME"),
            ("TERMO_COMUM", "réu"),
            ("LEGAL_TITLE", "réu"),
            ("TERMO_COMUM", "NOME"),
            ("TERMO_COMUM", "contestação"),
        ],
    },
    {
        "id": "pj_deve_permanecer",
        "input": "POLO ATIVO: INSTITUTO BRASILEIRO DO MEIO AMBIENTE E DOS RECURSOS NATURAIS RENOVAVEIS",
        "output": "POLO ATIVO: INSTITUTO BRASILEIRO DO MEIO AMBIENTE E DOS RECURSOS NATURAIS RENOVAVEIS",
        "entities": [("TERMO_COMUM", "POLO"), ("TERMO_COMUM", "POLO ATIVO"), ("TERMO_COMUM", "INSTITUTO")],
    },
    {
        "id": "nome_unico_lista_comum",
        "input": "Sr. SEBASTIÃO compareceu à audiência.",
        "output": "Sr. <NOME> compareceu à audiência.",
        "entities": [("TERMO_COMUM", "Sr"), ("LEGAL_HEADER", "Sr."), ("TERMO_COMUM", "NOME"), ("TERMO_COMUM", "audiência")],
    },
    {
        "id": "pj_com_nome_comum",
        "input": "SEBASTIAO FILHOS LTDA ajuizou ação.",
        "output": "SEBASTIAO FILHOS LTDA ajuizou ação.",
        "entities": [("TERMO_COMUM", "ação")],
    },
    {
        "id": "metadado_nome_pf_flexivel",
        "names": ["Antônio de Souza Santos"],
        "input": "No relatório consta ANTÔNIO DE SOUZA SANTOS. Em outro trecho: Antônio de Souza protocolou petição. Por fim, Sr. Antônio compareceu.",
        "output": "No relatório consta <NOME>. Em outro trecho: <NOME> protocolou petição. Por fim, <NOME> compareceu.",
        "entities": [("TERMO_COMUM", "relatório"), ("TERMO_COMUM", "NOME"), ("TERMO_COMUM", "NOME"), ("TERMO_COMUM", "petição"), ("TERMO_COMUM", "NOME")],
    },
]
#: The first titles of the list that the results were made with.
TITLES = ["SENHOR", "JUIZ", "DOUTOR", "PROMOTOR", "ADVOGADO", "PERITO", "REQUERENTE", "REQUERIDO", "AUTOR", "RÉU", "EXCELENTÍSSIMO", "RELATOR", "DESEMBARGADOR", "MINISTRO", "PROCURADOR", "DEFENSOR"]
# End of the fixed values.

#: Not compared: a term list that isn't at hand, a statistical model's places, and another package's phones and dates.
NOT_COMPARED = {"TERMO_COMUM", "LOCATION", "PHONE_NUMBER", "DATE_TIME"}
