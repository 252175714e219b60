"""Identity figures on a few rows."""

from datetime import date, timedelta

from ledgerlight.operators import identity

FACT = (
    "UG_ID string, PORTADOR_ID_BASELINE string, NOME_PORTADOR_NORMALIZADO string, PORTADOR_ID string, FAVORECIDO_ID string, ANO_TRANSACAO int, DATA_DT date, "
    "VALOR_CENTAVOS bigint, EH_COMPRA_NACIONAL boolean, FAVORECIDO_IDENTIFICADO boolean"
)


def row(unit, masked, name, supplier="f", day=0, cents=1000):
    card = None if masked is None else "|".join(filter(None, (unit, masked, name)))
    return (unit, masked, name, card, supplier, 2020, date(2020, 3, 1) + timedelta(days=day), cents, True, True)


def test_null_names_are_no_further_name(spark):
    rows = [row("u", "m", "a"), row("u", "m", None), row("v", "m", "b"), row("u", "k", "a"), row("u", "k", "c"), row("u", None, "z"), row(None, "k", "a")]
    df = spark.createDataFrame(rows, FACT)
    got = identity.identity_universe(df).first().asDict()
    assert got == {
        "PORTADORES_BASELINE_GLOBAL": 2, "CPF_COM_MULTIPLOS_NOMES": 2, "CPF_EM_MULTIPLAS_UGS": 1, "PORTADORES_BASELINE_UG": 4,
        "PARES_UG_CPF_COM_MULTIPLOS_NOMES": 1, "PORTADORES_CANDIDATOS": 6,
    }
    assert [tuple(r) for r in identity.collision_pairs(df).collect()] == [("u", "k", 2, 2)]


def test_only_touched_supplier_years_are_counted_again(spark):
    shared = [row("u", "m", "ab"[n % 2], "f", n) for n in range(6)]  # one masked id, two people
    alone = [row("u", f"k{n % 2}", "c", "g", n) for n in range(6)]  # two masked ids, no collision
    df = spark.createDataFrame(shared + alone, FACT)
    assert [tuple(r) for r in identity.touched_supplier_years(df).collect()] == [("u", "f", 2020)]
    got = identity.recount(df).first()
    assert (got.GRUPOS_FORNECEDOR_ANO_AFETADOS, got.EPISODIOS_AFETADOS_BASELINE, got.EPISODIOS_AFETADOS_CANDIDATO) == (1, 0, 1)
    assert (got.BASELINE_TOTAL, got.CANDIDATO_TOTAL_PROJETADO) == (1, 2)
    assert identity.recount(df, frozen=1693).first().CANDIDATO_TOTAL_PROJETADO == 1694
