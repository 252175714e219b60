"""Schemas, code sets and thresholds. Every threshold is a parameter of the operators; these are the defaults."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the raw text, and those that consolidation adds.
RAW_COLUMNS = (
    "CÓDIGO ÓRGÃO SUPERIOR", "NOME ÓRGÃO SUPERIOR", "CÓDIGO ÓRGÃO", "NOME ÓRGÃO",
    "CÓDIGO UNIDADE GESTORA", "NOME UNIDADE GESTORA", "ANO EXTRATO", "MÊS EXTRATO",
    "CPF PORTADOR", "NOME PORTADOR", "CNPJ OU CPF FAVORECIDO", "NOME FAVORECIDO",
    "TRANSAÇÃO", "DATA TRANSAÇÃO", "VALOR TRANSAÇÃO",
)
PROVENANCE_COLUMNS = ("COMPETENCIA_ARQUIVO", "ARQUIVO_ORIGEM")
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

# Operation codes.
NATIONAL = "COMPRA A/V - R$ - APRES"
INTERNATIONAL = "COMPRA A/V - INT$ - APRES"
INSTALMENT = "CPP LOJISTA TRF P/FATURA - REAL"
PURCHASES = (NATIONAL, INTERNATIONAL, INSTALMENT)
WITHDRAWALS = (
    "SAQUE CASH/ATM BB",
    "SAQUE - INT$ - APRES",
    "SAQUE MANUAL - CARTOES BB NA AGENCIA",
    "SAQUE - R$ - APRES",
)
ADJUSTMENTS = (
    "COMP A/V-SOL DISP C/CLI-R$ ANT VENC",
    "COMP A/V-SOL DISP C/CLI-R$ APOS VENC",
    "SAQUE BB B24HORAS-SOL C/CLIENTE",
    "VOUCHER - R$ - REVRS REAPR",
)
RULES_VERSION = "1.2.0"
PREPARATION_VERSION = "1.1.0"
# First and last year of which all months were published.
COMPLETE_YEARS = (2013, 2025)

# Dated limits (from, to, purchases base, works base, share, share for grants).
LIMITS = (
    ("2002-04-23", "2018-07-18", "80000.00", "150000.00", "0.01", "0.10"),
    ("2018-07-19", "2023-11-30", "176000.00", "330000.00", "0.01", "0.10"),
    ("2023-12-01", "2023-12-31", "57208.33", "114416.65", "0.05", "0.50"),
    ("2024-01-01", "2024-12-31", "59906.02", "119812.02", "0.05", "0.50"),
    ("2025-01-01", "2025-12-31", "62725.59", "125451.15", "0.05", "0.50"),
    ("2026-01-01", "2026-12-31", "65492.11", "130984.20", "0.05", "0.50"),
)

# Rules, their families and the families' names. The last two families are context and never counted.
TRAILS = ("T01", "T02", "T03", "T04", "T05", "T06", "T07")
SUPPLIER_TRAILS = TRAILS[:6]
CONTEXTS = ("T08", "T09")
FAMILIES = {
    "F1": ("T01", "T02"), "F2": ("T03", "T04", "T05"), "F3": ("T06",), "F4": ("T07",), "F5": ("T08",), "F6": ("T09",),
}
FAMILY_NAMES = {
    "F1": "Conformidade operacional observável",
    "F2": "Repetição e recorrência de aquisições",
    "F3": "Estrutura e concentração de fornecedor",
    "F4": "Comportamento de saque",
    "F5": "Contexto estatístico forense",
    "F6": "Contexto normativo-financeiro",
}
# Kind and unit of each rule's evidence.
EVIDENCE = {
    "T01": ("FATO_DETERMINISTICO", "TRANSACAO"),
    "T02": ("FATO_DETERMINISTICO", "TRANSACAO"),
    "T03": ("PADRAO_COMPORTAMENTAL", "GRUPO_TRANSACOES"),
    "T04": ("PADRAO_COMPORTAMENTAL", "UG_FORNECEDOR_DATA_VALOR"),
    "T05": ("PADRAO_COMPORTAMENTAL", "UG_FORNECEDOR_ANO_EPISODIO"),
    "T06": ("PADRAO_ESTRUTURAL", "UG_ANO"),
    "T07": ("PADRAO_COMPORTAMENTAL", "UG_PORTADOR_ANO"),
    "T08": ("SINAL_ESTATISTICO", "UG_ANO"),
    "T09": ("CONTEXTO_NORMATIVO", "TRANSACAO_CENARIO_NORMATIVO"),
}
# Columns that may hold an evidence's id, in the order of trial.
EVIDENCE_IDS = ("ID_SINAL", "ID_EPISODIO", "ID_GRUPO", "ID_CONTEXTO")
# What a transaction is to the signal that it's linked to.
ROLES = {
    "T01": "transacao_sinalizada",
    "T02": "transacao_sinalizada",
    "T03": "transacao_do_grupo",
    "T04": "transacao_do_grupo",
    "T05": "transacao_do_episodio",
    "T06": "transacao_fornecedor_top1",
    "T07": "saque_em_episodio_recorrente",
    "T08": "transacao_drilldown",
    "T09": "transacao_comparada_a_referencia",
}
# Weekdays, Monday first.
WEEKDAYS = ("segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado", "domingo")
# Each rule's basis, limitation and text for citizens in the master table.
SIGNAL_TEXTS = {
    "T01": (
        "Despesa em final de semana: verificar justificativa documental.",
        "A base pública não contém a justificativa.",
        "Esta compra foi registrada em um final de semana. O registro isoladamente não permite concluir que a despesa seja irregular.",
    ),
    "T02": (
        "Classificação operacional de compra parcelada.",
        "A classificação exige conferência da fatura e documentos.",
        "O Portal classificou esta operação como relacionada a compra parcelada. A classificação exige conferência documental.",
    ),
    "T03": (
        "Duplicação anormal como mecanismo de drill-down.",
        "Transações distintas podem ter a mesma data, fornecedor e valor.",
        "Foram encontradas duas ou mais transações com o mesmo portador, fornecedor, data e valor. A repetição pode decorrer de operações legítimas.",
    ),
    "T04": (
        "Análise conjunta de agentes supridos da mesma UG.",
        "O Portal não informa o objeto adquirido.",
        "Portadores diferentes da mesma unidade realizaram transações de mesmo valor, no mesmo dia e fornecedor. O padrão não permite afirmar divisão da mesma despesa.",
    ),
    "T05": (
        "Recorrência de aquisições na mesma UG e fornecedor como proxy comportamental.",
        "A base não informa o objeto adquirido; o sinal não confirma fracionamento.",
        "A mesma unidade realizou várias compras de valores semelhantes junto ao mesmo fornecedor em curto intervalo e por mais de um portador.",
    ),
    "T06": (
        "Indicador de concentração em fornecedor associado a boas práticas de diversificação.",
        "Concentração não equivale a direcionamento.",
        "Uma parcela elevada das compras identificáveis desta unidade foi realizada com o mesmo fornecedor.",
    ),
    "T07": (
        "Recorrência anual de dias com múltiplos saques; modalidade de saque exige contexto e autorização próprios.",
        "A base não contém o ato de concessão nem a justificativa do saque.",
        "O portador repetiu episódios de múltiplos saques em vários dias do exercício e ficou entre os maiores valores relativos do período.",
    ),
    "T08": (
        "Lei de Newcomb-Benford — extremo relativo do MAD D12 entre UGs comparáveis no mesmo exercício.",
        "Benford não prova fraude; a população e o processo gerador devem ser considerados.",
        "Esta UG ficou entre os maiores afastamentos relativos de Benford em um exercício com número suficiente de unidades comparáveis.",
    ),
    "T09": (
        "Portaria MF 95/2002 ou Portaria Normativa MF 1.344/2023, conforme vigência, em cenários paralelos de categoria.",
        "A categoria/objeto da despesa e o ato de concessão não estão disponíveis; a classificação é não conclusiva.",
        "O valor foi comparado com referências financeiras vigentes em dois cenários possíveis. A situação de cada cenário é mostrada separadamente "
        "como abaixo, próxima, no limite ou acima. Isso não confirma irregularidade.",
    ),
}
# Codes of the 27 federative units.
UFS = (
    "AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA",
    "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO",
)
# Validation statuses, the first being the default.
STATUSES = (
    "NAO_VALIDADO", "EM_ANALISE", "CONFIRMADO", "JUSTIFICADO", "FALSO_POSITIVO", "ERRO_DADO", "INCONCLUSIVO",
)
# Fixed value: a line of the unit register, with unit, state and body.
UNIT_LINE = r'^"(\d{1,6})",.*?,"([A-Z]{2})","(\d{1,5})",'
