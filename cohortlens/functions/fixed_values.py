"""Word lists, lookup tables, formats and thresholds that results depend on."""

# Texts that mean "no value" in normalised text.
EMPTY_WORDS = ("NULL", "NONE", "NAN", "-", "")

# Texts decoded to NULL when a raw text table is read.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Umbrella programme names that prefix a programme name.
UMBRELLA_PREFIXES = ("COMUNICACAO SOCIAL", "CIENCIAS SOCIAIS")

# Outcome groups.
GRADUATED, DROPPED, ACTIVE, OTHER = "FORMATURA", "EVASAO", "ATIVO", "OUTROS"

# Words in an exit reason that mean the student left without a diploma.
DROPOUT_WORDS = (
    "ABANDONO", "NAO CUMPRIU CONDICAO", "JUBILAMENTO", "REPR 3 VEZES", "DESLIGAMENTO",
    "NOVO VESTIBULAR", "TRANSFERENCIA", "MUDANCA DE", "DUPLA HABILITACAO", "VESTIBULAR P/",
)

# Enrolment status to outcome group.
STATUS_OUTCOMES = {
    "CONCLUIDO": "FORMATURA",
    "FORMADO": "FORMATURA",
    "CANCELADO": "EVASAO",
    "ATIVO": "ATIVO",
    "ATIVO - FORMANDO": "ATIVO",
    "TRANCADO": "ATIVO",
}

# Degrees that are not undergraduate.
POSTGRADUATE_DEGREES = ("Mestrado", "Doutorado")

# Knowledge area of the programmes published as "OUTRA".
AREA_OVERRIDES = {
    "ARQUITETURA E URBANISMO": "CIENCIAS SOCIAIS APLICADAS",
    "CIENCIAS NATURAIS": "CIENCIAS HUMANAS",
    "CIENCIAS SOCIAIS": "CIENCIAS HUMANAS",
    "EDUCACAO DO CAMPO - MATEMATICA": "CIENCIAS HUMANAS",
    "EDUCACAO FISICA": "CIENCIAS DA SAUDE",
    "ENGENHARIA": "ENGENHARIAS",
    "ENGENHARIA AUTOMOTIVA": "ENGENHARIAS",
    "LETRAS - LINGUA INGLESA E RESPECTIVA LITERATURA": "LINGUISTICA, LETRAS E ARTES",
    "MUSEOLOGIA": "CIENCIAS SOCIAIS APLICADAS",
    "MUSICA": "LINGUISTICA, LETRAS E ARTES",
    "TEATRO": "LINGUISTICA, LETRAS E ARTES",
}

# Campus names, in the order in which the words are looked for.
CAMPUS_NAMES = (
    ("GAMA", "FACULDADE DE CIENCIAS E TECNOLOGIAS EM ENGENHARIA (FCTE)"),
    ("CEILANDIA", "FACULDADE DE CIENCIAS E TECNOLOGIAS EM SAUDE (FCTS)"),
    ("PLANALTINA", "FACULDADE DE PLANALTINA (FUP)"),
)
GRANT_CAMPUS_NAMES = (
    ("GAMA", "FGA - GAMA"),
    ("CEILANDIA", "FCE - CEILANDIA"),
    ("PLANALTINA", "FUP - PLANALTINA"),
)
MAIN_CAMPUS = "DARCY RIBEIRO"
MANY_CAMPUSES = "MULTICAMPUS"
CAMPUS_REGIONS = {
    "DARCY RIBEIRO": "Plano Piloto",
    "FACULDADE DE CIENCIAS E TECNOLOGIAS EM ENGENHARIA (FCTE)": "Gama",
    "FACULDADE DE CIENCIAS E TECNOLOGIAS EM SAUDE (FCTS)": "Ceilândia",
    "FACULDADE DE PLANALTINA (FUP)": "Planaltina",
}
OTHER_REGION = "Distrito Federal"

# Labels of mixed programmes and the defaults of missing attributes.
MIXED_DEGREE, MIXED_CATEGORY = "MISTO (BACHARELADO + LICENCIATURA)", "MISTO"
DEFAULT_DEGREE, DEFAULT_SHIFT, DEFAULT_AREA = "BACHAREL", "DIURNO", "OUTRA"

# Programmes shared by several degrees, left out of per-programme panels.
TRUNK_PROGRAMMES = ("ENGENHARIA", "EDUCACAO FISICA - CICLO BASICO")

# Generic prefixes removed from the programme part of a grant unit.
GENERIC_PREFIXES = (
    "BACHARELADO EM ", "LICENCIATURA EM ", "GRADUACAO EM ", "GRADUACAO DE ", "CURSO DE ", "CURSO ",
)

# Labels of the quartile classes, from the highest quartile to the lowest.
RISK_CLASSES = ("RETENÇÃO CRÍTICA", "RETENÇÃO ALTA", "RETENÇÃO MÉDIA", "RETENÇÃO BAIXA")

# Thresholds.
MIN_GROUP = 5
MATURITY_YEARS = 8
MIN_PEER_SIZE = 50
MIN_PEERS = 10
VALID_PERMANENCE = (1, 30)
TOLERANCE_MONTHS = 4
FRESHNESS_DAYS = 35
SERIES_START = "1962-04-21 00:00:00"
RISK_WEIGHTS = (0.3, 0.7)
RISK_CLIP = (0.05, 0.95)

# Arrival classes of late data.
NO_PERIOD, LATE, ON_TIME = "SEM_PERIODO", "ATRASADA", "NO_PRAZO"

# Hybrid search.
STRONG_SIMILARITY, NEAR_SIMILARITY, TITLE_SIMILARITY = 0.55, 0.45, 0.8
VECTOR_CANDIDATES, RRF_K, MIN_COVERAGE = 30, 60, 0.5
CHUNK_LIMIT, CHUNK_OVERLAP, MIN_LETTER_SHARE = 500, 80, 0.4
EMBEDDING_SIZE = 384

# Verbal bands of the dropout rate and of the delay, highest threshold first.
DROPOUT_BANDS = ((60, "evasão muito alta"), (45, "evasão alta"), (30, "evasão moderada"))
DROPOUT_LOWEST, DROPOUT_MISSING = "evasão baixa", "evasão sem dado"
DELAY_BANDS = ((2, "formatura com muito atraso"), (0.5, "formatura com algum atraso"))
DELAY_LOWEST, DELAY_MISSING = "formatura no prazo", "tempo de formatura sem dado"

# Line of the grant value in the published table, after tags are removed.
GRANT_VALUE_PATTERN = (
    r"Inicia[çc][ãa]o Cient[íi]fica\s*(?:\(PIBIC\)\s*)?IC\s*-?\s*([\d.]+,\d{2})"
)

# Quota texts of open seats, and the rules of the social profile. A rule holds if the text has a word of each of its
# groups; the first that holds gives the label.
OPEN_SEATS = ("", "NAO", "UNIVERSAL")
PROFILE_RULES = (
    ((("PPI", "NEGRO", "INDIGENA"),), "PPI / ETNICO-RACIAL"),
    ((("ESCOLA PUB",),), "ESCOLA PUBLICA"),
)
QUOTA_RULES = (
    ((("PPI", "NEGRO", "INDIGENA"), ("ESCOLA PUB",)), "ESCOLA PUBLICA - PPI"),
    ((("ESCOLA PUB",),), "ESCOLA PUBLICA - NAO PPI"),
    ((("NEGRO", "INDIGENA"),), "COTAS RACIAIS (NEGRO/INDIGENA)"),
    ((("PCD",),), "COTAS PCD"),
)
INCOME_RULES = (
    ((("BAIXA RENDA",),), "BAIXA RENDA (<= 1.5 SM)"),
    ((("ALTA RENDA",),), "INDEPENDENTE DE RENDA"),
)
OTHER_PROFILE, OTHER_QUOTA, OTHER_INCOME = "OUTRAS COTAS", "OUTRAS ACOES AFIRMATIVAS", "NAO ESPECIFICADO"
# The label of open seats beside each default.
OPEN_LABELS = {
    "OUTRAS COTAS": "AMPLA CONCORRENCIA", "OUTRAS ACOES AFIRMATIVAS": "AMPLA CONCORRENCIA", "NAO ESPECIFICADO": "NAO APLICAVEL",
}

# What follows the programme in a grant unit, in the order in which it is cut off.
UNIT_TAILS = (r"-?\s*ALUNO:\s*\S+", r"-\s*FORMANDO\s*$")
