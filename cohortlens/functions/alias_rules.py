"""Alias rules: programme names of the enrolment and grant sources, and the curriculum each belongs to."""

from __future__ import annotations

# Fixed values: (name in the source, name of the curriculum, category), in their published order.
ALIAS_RULES = (
    ("PORTUGUES DO BRASIL COMO SEGUNDA LINGUA", "LETRAS - PORTUGUES DO BRASIL COMO SEGUNDA LINGUA", "Letras e Línguas"),
    ("LINGUAGENS", "EDUCACAO DO CAMPO - LINGUAGENS, ARTES E LITERATURA", "Educação do Campo (FUP)"),
    ("LINGUAGENS, ARTES E LITERATURA", "EDUCACAO DO CAMPO - LINGUAGENS, ARTES E LITERATURA", "Educação do Campo (FUP)"),
    ("CIENCIAS DA NATUREZA E MATEMATICA", "EDUCACAO DO CAMPO - CIENCIAS DA NATUREZA E MATEMATICA", "Educação do Campo (FUP)"),
    ("CIENCIAS DA NATUREZA", "EDUCACAO DO CAMPO - CIENCIAS DA NATUREZA", "Educação do Campo (FUP)"),
    ("PROGRAMACAO VISUAL", "DESIGN - PROGRAMACAO VISUAL", "Design / Desenho Industrial"),
    ("PROJETO DO PRODUTO", "DESIGN - PROJETO DO PRODUTO", "Design / Desenho Industrial"),
    ("PROJETO DE PRODUTO", "DESIGN - PROJETO DO PRODUTO", "Design / Desenho Industrial"),
    ("LINGUA DE SINAIS BRASILEIRA - PORTUGUES COMO SEGUNDA LINGUA", "LINGUA DE SINAIS BRASILEIRA -PORTUGUES COMO SEGUNDA LINGUA", "Correção de Typo no Portal"),
    ("PEDAGOGIA - 1A LICENCIATURA", "PEDAGOGIA", "Licenciatura"),
    ("COMPOSICAO", "MUSICA", "Música e Instrumentos"),
    ("MATEMATICA - SEGUNDA LICENCIATURA", "MATEMATICA", "Licenciatura"),
    ("CIENCIAS NATURAIS - SEGUNDA LICENCIATURA", "CIENCIAS NATURAIS", "Licenciatura"),
    ("ADMINISTRACAO DE EMPRESAS", "ADMINISTRACAO", "Habilitação Legada"),
    ("ENFERMAGEM E OBSTETRICIA", "ENFERMAGEM", "Habilitação Legada"),
    ("VIOLAO", "MUSICA", "Música e Instrumentos"),
    ("SAXOFONE", "MUSICA", "Música e Instrumentos"),
    ("VIOLINO", "MUSICA", "Música e Instrumentos"),
    ("CANTO", "MUSICA", "Música e Instrumentos"),
    ("PIANO", "MUSICA", "Música e Instrumentos"),
    ("REGENCIA", "MUSICA", "Música e Instrumentos"),
    ("CONTRABAIXO", "MUSICA", "Música e Instrumentos"),
    ("TROMBONE", "MUSICA", "Música e Instrumentos"),
    ("TROMPETE", "MUSICA", "Música e Instrumentos"),
    ("VIOLA", "MUSICA", "Música e Instrumentos"),
    ("VIOLONCELO", "MUSICA", "Música e Instrumentos"),
    ("OBOE", "MUSICA", "Música e Instrumentos"),
    ("FAGOTE", "MUSICA", "Música e Instrumentos"),
    ("FLAUTA", "MUSICA", "Música e Instrumentos"),
    ("CLARINETA", "MUSICA", "Música e Instrumentos"),
    ("TROMPA", "MUSICA", "Música e Instrumentos"),
    ("LINGUA PORTUGUESA E RESPECTIVA LITERATURA", "LETRAS - LINGUA PORTUGUESA E RESPECTIVA LITERATURA", "Letras e Línguas"),
    ("CONTROLE E AUTOMACAO", "ENGENHARIA MECATRONICA - CONTROLE E AUTOMACAO", "Engenharias"),
    ("LINGUA INGLESA E RESPECTIVA LITERATURA", "LETRAS - LINGUA INGLESA E RESPECTIVA LITERATURA", "Letras e Línguas"),
    ("LINGUA ESPANHOLA E LITERATURA ESPANHOLA E HISPANO-AMERICANA", "LETRAS - LINGUA ESPANHOLA E LITERATURA ESPANHOLA E HISPANO-AMERICANA", "Letras e Línguas"),
    ("ESPANHOL", "LETRAS - LINGUA ESPANHOLA E LITERATURA ESPANHOLA E HISPANO-AMERICANA", "Letras e Línguas"),
    ("LINGUA FRANCESA E RESPECTIVA LITERATURA", "LETRAS - LINGUA FRANCESA E RESPECTIVA LITERATURA", "Letras e Línguas"),
    ("FRANCES", "LETRAS - LINGUA FRANCESA E RESPECTIVA LITERATURA", "Letras e Línguas"),
    ("INGLES", "LETRAS - LINGUA INGLESA E RESPECTIVA LITERATURA", "Letras e Línguas"),
    ("LINGUA E LITERATURA JAPONESA", "LETRAS - LINGUA E LITERATURA JAPONESA", "Letras e Línguas"),
    ("ADMINISTRACAO PUBLICA", "ADMINISTRACAO", "Administração"),
    ("FARMACIA CLINICA E INDUSTRIAL", "FARMACIA", "Saúde"),
    ("INTERPRETACAO TEATRAL", "ARTES CENICAS", "Artes"),
    ("LICENCIATURA EM ARTES VISUAIS", "ARTES VISUAIS", "Licenciatura"),
    ("LICENCIATURA EM CIENCIAS BIOLOGICAS", "CIENCIAS BIOLOGICAS", "Licenciatura"),
    ("LICENCIATURA EM COMPUTACAO", "COMPUTACAO", "Licenciatura"),
    ("LICENCIATURA EM FISICA", "FISICA", "Licenciatura"),
    ("LICENCIATURA EM MATEMATICA", "MATEMATICA", "Licenciatura"),
    ("LICENCIATURA EM QUIMICA", "QUIMICA", "Licenciatura"),
    ("LICENCIATURA EM TEATRO", "ARTES CENICAS", "Licenciatura"),
    ("LICENCIATURA EM MUSICA", "MUSICA", "Licenciatura"),
    ("HABILITACAO TRADUCAO - INGLES", "LETRAS - TRADUCAO - INGLES", "Letras e Línguas"),
    ("HABILITACAO TRADUCAO - FRANCES", "LETRAS - TRADUCAO - FRANCES", "Letras e Línguas"),
    ("HABILITACAO TRADUCAO - ESPANHOL", "LETRAS - TRADUCAO - ESPANHOL", "Letras e Línguas"),
    ("LETRAS-TRADUCAO ESPANHOL", "LETRAS - TRADUCAO - ESPANHOL", "Letras e Línguas"),
    ("TRADUCAO - FRANCES", "LETRAS - TRADUCAO - FRANCES", "Letras e Línguas"),
    ("LETRAS TRADUCAO - FRANCES", "LETRAS - TRADUCAO - FRANCES", "Letras e Línguas"),
    ("TRADUCAO-INGLES", "LETRAS - TRADUCAO - INGLES", "Letras e Línguas"),
    ("LINGUA DE SINAIS BRASILEIRA/PORTUGUES COMO SEGUNDA LINGUA", "LINGUA DE SINAIS BRASILEIRA -PORTUGUES COMO SEGUNDA LINGUA", "Correção de Typo no Portal"),
    ("EDUCACAO DO CAMPO - LINGUAGENS", "EDUCACAO DO CAMPO - LINGUAGENS, ARTES E LITERATURA", "Educação do Campo (FUP)"),
    ("MUSICA: LICENCIATURA", "MUSICA", "Música e Instrumentos"),
    ("BIOLOGIA", "CIENCIAS BIOLOGICAS", "Habilitação Legada"),
    ("PSICOLOGIA-PSICOLOGO", "PSICOLOGIA", "Habilitação Legada"),
    ("ENGENHARIA DE CONTROLE E AUTOMACAO", "ENGENHARIA MECATRONICA - CONTROLE E AUTOMACAO", "Engenharias"),
    ("DAP / COMUNICACAO SOCIAL - AUDIOVISUAL", "AUDIOVISUAL", "Comunicação"),
    ("CIENCIAS BIOLOGICAS / DEPARTAMENTO DE ZOOLOGIA", "CIENCIAS BIOLOGICAS", "Habilitação Legada"),
    ("JOR / JORNALISMO", "JORNALISMO", "Comunicação"),
    ("GRADUACAO EM CIENCIA POLITICA", "CIENCIA POLITICA", "Ciências Sociais"),
    ("GRADUACAO EM ARQUITETURA E URBANISMO", "ARQUITETURA E URBANISMO", "Habilitação Legada"),
    ("ARQUITETURA E URBANISMO / FACULDADE DE ARQUITETURA E URBANISMO", "ARQUITETURA E URBANISMO", "Habilitação Legada"),
    ("GRADUACAO DE MEDICINA", "MEDICINA", "Habilitação Legada"),
    ("INSTITUTO DE CIENCIAS BIOLOGICAS / BIOTECNOLOGIA", "CIENCIAS BIOLOGICAS", "Habilitação Legada"),
)


def alias_rows() -> list[tuple[str, str, str, int]]:
    """(source name, curriculum name, category, place) rows for `ordering.literal_table`."""
    return [(*rule, place) for place, rule in enumerate(ALIAS_RULES)]
