"""Identity collisions and their recount, over events whose masked ids stand for several people."""

from __future__ import annotations

from ..operators import identity
from .adapters import NAMED_SQL, named_events
from .governance_queries import _body
from .rule_queries import EV, T05_EPISODES_SQL, T07_SQL

CARDS = {"BASELINE": "PORTADOR_ID_BASELINE", "CANDIDATA": "PORTADOR_ID"}
T05 = {"days": 3, "max_cv": 0.6}
T07 = {"quantile": 0.9}


def _fact(card: str, where: str = "") -> str:
    return f"stg AS (SELECT * EXCLUDE (PORTADOR_ID, PORTADOR_ID_BASELINE), {card} AS PORTADOR_ID FROM nm WHERE {card} IS NOT NULL{where})"


def _episodes(card: str, where: str = "") -> str:
    body = _body(T05_EPISODES_SQL.rpartition("\nSELECT")[0], EV)
    return f"(WITH {_fact(card, where)}, {body} SELECT count(*) FROM ranked)"


_REPEATED = "FROM nm WHERE EH_COMPRA_EFETIVA AND VALOR_CENTAVOS > 0 AND {0} IS NOT NULL GROUP BY UG_ID, {1}FAVORECIDO_ID, DATA_DT, {2}VALOR_CENTAVOS HAVING count(*) >= 2"


def _compared() -> str:
    parts = []
    for label, card in CARDS.items():
        counts = {
            "T03": f"(SELECT count(*) FROM (SELECT 1 {_REPEATED.format(card, f'{card}, ', 'TRANSACAO, ')}))",
            "T04": f"(SELECT count(*) FROM (SELECT 1 {_REPEATED.format(card, '', '')} AND count(DISTINCT {card}) >= 2))",
            "T05": _episodes(card),
            "T07_DIAS": f"(WITH {_fact(card)}, {_body(T07_SQL, EV)} SELECT count(*) FROM daily)",
            "T07": f"(WITH {_fact(card)}, {_body(T07_SQL, EV)} SELECT count(*) FROM rec WHERE PRIORITARIO)",
        }
        parts += [f"SELECT '{label}' AS IDENTIDADE, '{trail}' AS TRILHA, {n} AS N" for trail, n in counts.items()]
    return f"WITH {NAMED_SQL} {' UNION ALL '.join(parts)}"


_COLLISIONS = (
    "SELECT UG_ID, PORTADOR_ID_BASELINE, count(DISTINCT NOME_PORTADOR_NORMALIZADO) AS N_NOMES, count(*) AS N_LINHAS FROM nm WHERE PORTADOR_ID_BASELINE IS NOT NULL "
    "GROUP BY ALL HAVING count(DISTINCT NOME_PORTADOR_NORMALIZADO) > 1"
)
_TOUCHED = (
    f"SELECT DISTINCT UG_ID, FAVORECIDO_ID, ANO_TRANSACAO FROM nm JOIN ({_COLLISIONS}) USING (UG_ID, PORTADOR_ID_BASELINE) WHERE EH_COMPRA_NACIONAL AND VALOR_CENTAVOS > 0 AND DATA_DT IS NOT NULL"
)

QUERIES = {
    "AGG-20": (
        lambda s, d: identity.identity_universe(named_events(s, d)),
        f"""WITH {NAMED_SQL}, k AS (SELECT * FROM nm WHERE PORTADOR_ID_BASELINE IS NOT NULL),
a AS (SELECT count(DISTINCT NOME_PORTADOR_NORMALIZADO) AS n, count(DISTINCT UG_ID) AS u FROM k GROUP BY PORTADOR_ID_BASELINE),
b AS (SELECT count(DISTINCT NOME_PORTADOR_NORMALIZADO) AS n FROM k GROUP BY UG_ID, PORTADOR_ID_BASELINE)
SELECT (SELECT count(*) FROM a) AS PORTADORES_BASELINE_GLOBAL, (SELECT count(*) FROM a WHERE n > 1) AS CPF_COM_MULTIPLOS_NOMES, (SELECT count(*) FROM a WHERE u > 1) AS CPF_EM_MULTIPLAS_UGS,
  (SELECT count(*) FROM b) AS PORTADORES_BASELINE_UG, (SELECT count(*) FROM b WHERE n > 1) AS PARES_UG_CPF_COM_MULTIPLOS_NOMES, (SELECT count(DISTINCT PORTADOR_ID) FROM k) AS PORTADORES_CANDIDATOS""",
    ),
    "AGG-20-collisions": (lambda s, d: identity.collision_pairs(named_events(s, d)), f"WITH {NAMED_SQL} {_COLLISIONS}"),
    "AGG-21": (lambda s, d: identity.compare_identities(named_events(s, d), CARDS, T05, T07), _compared()),
    "AGG-21-recount": (
        lambda s, d: identity.recount(named_events(s, d), **T05),
        f"""WITH {NAMED_SQL}, tc AS MATERIALIZED ({_TOUCHED}),
r AS (SELECT (SELECT count(*) FROM tc) AS GRUPOS_FORNECEDOR_ANO_AFETADOS,
  {_episodes("PORTADOR_ID_BASELINE", " AND (UG_ID, FAVORECIDO_ID, ANO_TRANSACAO) IN (SELECT (UG_ID, FAVORECIDO_ID, ANO_TRANSACAO) FROM tc)")} AS EPISODIOS_AFETADOS_BASELINE,
  {_episodes("PORTADOR_ID", " AND (UG_ID, FAVORECIDO_ID, ANO_TRANSACAO) IN (SELECT (UG_ID, FAVORECIDO_ID, ANO_TRANSACAO) FROM tc)")} AS EPISODIOS_AFETADOS_CANDIDATO,
  {_episodes("PORTADOR_ID_BASELINE")} AS BASELINE_TOTAL)
SELECT *, BASELINE_TOTAL + EPISODIOS_AFETADOS_CANDIDATO - EPISODIOS_AFETADOS_BASELINE AS CANDIDATO_TOTAL_PROJETADO FROM r""",
    ),
}
