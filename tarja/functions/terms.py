"""Word lists, placeholders and limits.

Longer lists (names, legal titles, common terms) are the user's: see ``sources.documents.read_terms``.
The short name and title lists here are samples for queries and tests."""

from __future__ import annotations

# What results must agree on, in the order in which it counts where order matters.
PARTY_PLACEHOLDER_INNER = "__NOME_PARTE_AUTORA__"
PARTY_PLACEHOLDER = "<NOME_PARTE_AUTORA>"
NAME_PLACEHOLDER = "<NOME>"
MAX_PDF_MB = 40
MAX_PDF_PAGES = 500
MIN_SCORE = 0.4
ADDRESS_WINDOW, CPF_WINDOW, OAB_WINDOW, ROLE_WINDOW = 40, 32, 96, 64
CONNECTORS = [
    "DE", "DA", "DO", "DAS", "DOS", "E",
]
TARGET_ROLES = [
    "AUTOR", "AUTORA", "PARTE AUTORA", "RECORRENTE", "REQUERENTE", "RECORRIDO", "RECORRIDA",
]
NOT_A_PARTY = [
    "ADVOGADO", "ADVOGADA", "OAB", "JUIZ", "JUIZA", "RELATOR", "PROCURADOR", "PROCURADORIA", "DESEMBARGADOR", "MINISTRO", "DEFENSOR", "PATRONO",
    "PATRONA", "TERCEIRO INTERESSADO",
]
COMPANY_TERMS = [
    "LTDA", "S/A", "EIRELI", "ME", "MEI", "EPP", "SPE", "CNPJ", "ONG", "OSCIP", "COOPERATIVA", "COMPANHIA", "INSTITUTO", "ASSOCIACAO", "SOCIEDADE",
    "EMPRESA", "FUNDACAO", "AUTARQUIA", "UNIAO", "MUNICIPIO", "ESTADO", "MINISTERIO", "SECRETARIA", "PREFEITURA", "TRIBUNAL", "DEFENSORIA",
    "PROCURADORIA", "MINISTERIO PUBLICO", "IBAMA", "ICMBIO", "INSS", "TRF", "PJE",
]
NOT_A_NAME = [
    "PODER", "JUDICIARIO", "JUSTICA", "FEDERAL", "SECAO", "VARA", "PROCESSO", "BENEFICIO", "ASSISTENCIAL", "PRESTACAO", "CONTINUADA", "SENTENCA",
    "CONTESTACAO", "TURMA", "RECURSAL", "TRIBUNAL", "REGIAO", "DOCUMENTO", "ASSINADO", "ELETRONICAMENTE", "ADVOCACIA", "PROCURADORIA", "INSS",
    "MINISTERIO", "PUBLICO", "DEFENSORIA", "UNIAO", "DANO", "MORAL", "COLETIVO", "INTERINO", "RESIDUAL", "ENRIQUECIMENTO", "ILICITO", "OBRIGACAO",
    "REPARACAO", "INDENIZACAO",
]
BLOCKED_IN_NAMES = [
    "ASSUNTO", "ASSUNTOS", "CLASSE", "NUMERO", "ORGAO", "JULGADOR", "DISTRIBUICAO", "PROCESSO", "DOCUMENTO", "PARTES", "POLO", "ATIVO", "PASSIVO",
    "INTERNO", "BENEFICIO", "BENEFICIOS", "ASSISTENCIAL", "PRESTACAO", "CONTINUADA", "APOSENTADORIA", "RECURSO", "SENTENCA", "CONTESTACAO", "REPLICA",
    "PETICAO", "REQUERIMENTO", "REQUERIDA", "REQUERENTE", "RECORRENTE", "RECORRIDO", "DEFICIENCIA", "INCAPACIDADE", "MISERABILIDADE",
    "CARACTERIZACAO", "PODER", "JUDICIARIO", "JUSTICA", "FEDERAL", "SECAO", "SUBSECAO", "VARA", "TURMA", "RECURSAL", "TRIBUNAL", "REGIAO",
    "AUTARQUIA", "INSTITUTO", "NACIONAL", "SEGURO", "SOCIAL", "INSS", "PJE", "PROCURADORIA", "ADVOCACIA", "TIPO", "LAUDO", "PERICIAL", "ESTUDO",
    "SOCIOECONOMICO", "QUESITOS",
]
SAFE_LOCATIONS = [
    "Acre", "AC", "Alagoas", "AL", "Amapá", "AP", "Amazonas", "AM", "Bahia", "BA", "Ceará", "CE", "Distrito Federal", "DF", "Espírito Santo", "ES",
    "Goiás", "GO", "Maranhão", "MA", "Mato Grosso", "MT", "Mato Grosso do Sul", "MS", "Minas Gerais", "MG", "Pará", "PA", "Paraíba", "PB", "Paraná",
    "PR", "Pernambuco", "PE", "Piauí", "PI", "Rio de Janeiro", "RJ", "Rio Grande do Norte", "RN", "Rio Grande do Sul", "RS", "Rondônia", "RO",
    "Roraima", "RR", "Santa Catarina", "SC", "São Paulo", "SP", "Sergipe", "SE", "Tocantins", "TO", "Aracaju", "Belém", "Belo Horizonte", "Boa Vista",
    "Brasília", "Campo Grande", "Cuiabá", "Curitiba", "Florianópolis", "Fortaleza", "Goiânia", "João Pessoa", "Macapá", "Maceió", "Manaus", "Natal",
    "Palmas", "Porto Alegre", "Porto Velho", "Recife", "Rio Branco", "Salvador", "São Luís", "Teresina", "Vitória",
]
LEGAL_HEADERS = [
    "EXMO. SR. DR. JUIZ FEDERAL", "EXMO SR DR JUIZ FEDERAL", "EXCELENTÍSSIMO SENHOR DOUTOR JUIZ FEDERAL", "JUIZ FEDERAL",
    "EXMO. SR. DR. JUIZ DE DIREITO", "EXMO SR DR JUIZ DE DIREITO", "EXCELENTÍSSIMO SENHOR DOUTOR JUIZ DE DIREITO", "JUIZ DE DIREITO",
    "JUIZADO ESPECIAL FEDERAL", "VARA DA SEÇÃO JUDICIÁRIA", "SEÇÃO JUDICIÁRIA", "EXMO.", "EXMO", "SR.", "DR.", "Dra.", "DRA.",
    "EXCELENTÍSSIMO(A) SENHOR(A) DOUTOR(A) JUIZ(A) FEDERAL", "EXCELENTÍSSIMO", "Senhor", "Doutor", "Senhora", "Doutora", "EXCELENTÍSSIMA",
    "EXCELENTÍSSIMO(A)", "Senhor(a)", "Doutor(a)", "Juiz", "Juíza", "Juiz(a)", "Juiz(íza)", "Assunto", "Assuntos",
]
CIVIL_STATUS = [
    "casado", "casada", "solteiro", "solteira", "viúvo", "viúva", "divorciado", "divorciada", "separado", "separada", "unido", "unida", "companheiro",
    "companheira", "amasiado", "amasiada", "união estável", "em união estável",
]
# Some stand twice, or in two spellings; rules take each once.
KNOWN_BODIES = [
    "FUNASA", "INSS", "IBAMA", "CNPQ", "IBGE", "FIOCRUZ", "SERPRO", "DATAPREV", "VALOR", "Justiça", "Justica", "Segredo", "PJe", "Assunto",
    "Tribunal Regional Federal", "Assuntos", "Vara Federal", "Vara", "Justiça Federal", "Federal", "Juizado", "Especial", "Federal",
    "Vara Federal de Juizado Especial Cível", "Turma", "Turma Recursal", "PJE", "SJGO", "SJDF", "SJMA", "SJAC", "SJAL", "SJAP", "SJAM", "SJBA",
    "SJCE", "SJDF", "SJES", "SJGO", "SJMA", "SJMG", "SJMS", "SJMT", "SJPA", "SJPB", "SJPE", "SJPI", "SJPR", "SJPE", "SJRN", "SJRO", "SJRR", "SJRS",
    "SJSC", "SJSE", "SJSP", "SJTO", "Justiça Federal da 1ª Região", "PJe - Processo Judicial Eletrônico",
]
METADATA_FIELDS = [
    "subject", "title", "author", "keywords",
]
# End of the fixed values.

#: Samples; the full lists are files of the user's.
SAMPLE_NAMES = [
    "ANA", "ANTONIO", "BEATRIZ", "CARLOS", "DANIEL", "EDUARDO", "FERNANDA", "GUSTAVO", "HELENA", "JOAQUIM", "MARIA", "MARCOS", "PAULO", "SEBASTIAO",
    "TEREZA",
]
SAMPLE_TITLES = [
    "SENHOR", "JUIZ(A)", "RELATOR(A)", "PROCURADOR DA REPÚBLICA", "PROCURADOR",
]
