"""The typed fact: one wide projection over the raw text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import exprs as x


def build_staging(raw: DataFrame) -> DataFrame:
    """The raw columns, unchanged, and 20 derived ones."""
    x.require_columns(raw, model.RAW_COLUMNS)
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("TRANSAÇÃO", "NOME PORTADOR", "NOME FAVORECIDO")]
    # texts that several columns or one column several times need are worked out in projections of their own
    cleaned = raw.select(
        "*",
        x.missing_to_null(F.col("CÓDIGO UNIDADE GESTORA")).alias("_UG"),
        x.folded_plain(F.col("NOME PORTADOR")).alias("_NOME"),
        x.folded_plain(F.col("NOME FAVORECIDO")).alias("_LOJA"),
        F.trim(F.col("ANO EXTRATO")).try_cast("int").alias("_ANO"),
        F.trim(F.col("MÊS EXTRATO")).try_cast("int").alias("_MES"),
        x.amount_text(F.col("VALOR TRANSAÇÃO")).alias("_VALOR"),
    )
    read = cleaned.select(
        *raw.columns,
        x.padded_code(F.col("_UG")).alias("UG_ID"),
        x.folded_rest(F.col("_NOME")).alias("NOME_PORTADOR_NORMALIZADO"),
        x.digits(F.col("CPF PORTADOR")).alias("_CPF"),
        x.folded_rest(F.col("_LOJA")).alias("_FAVORECIDO"),
        F.trim(F.coalesce(F.col("TRANSAÇÃO"), F.lit(""))).alias("_CODIGO"),
        x.brazilian_date(F.col("DATA TRANSAÇÃO")).alias("DATA_DT"),
        x.a_year(F.col("_ANO")).alias("ANO_EXTRATO_REF"),
        x.a_month(F.col("_MES")).alias("MES_EXTRATO_REF"),
        x.amount(F.col("_VALOR")).alias("VALOR_CENTAVOS"),
    )
    unit, name, card, code = (F.col(c) for c in ("UG_ID", "NOME_PORTADOR_NORMALIZADO", "_CPF", "_CODIGO"))
    secret_supplier = F.col("_FAVORECIDO").contains("SIGILO") | F.col("_FAVORECIDO").contains("SEM INFORM")
    first = read.select(
        *raw.columns,
        "UG_ID",
        "NOME_PORTADOR_NORMALIZADO",
        F.when(~name.contains("SIGILO"), card).alias("PORTADOR_ID_BASELINE"),
        F.when(unit.isNotNull() & card.isNotNull(), F.concat_ws("|", unit, card, name)).alias("PORTADOR_ID"),
        F.when(~secret_supplier, x.digits(F.col("CNPJ OU CPF FAVORECIDO"))).alias("FAVORECIDO_ID"),
        "DATA_DT",
        "ANO_EXTRATO_REF",
        "MES_EXTRATO_REF",
        F.concat(F.col("ANO_EXTRATO_REF").cast("string"), F.lpad(F.col("MES_EXTRATO_REF").cast("string"), 2, "0")).alias("COMPETENCIA_EXTRATO_REF"),
        "VALOR_CENTAVOS",
        code.isin(*model.PURCHASES).alias("EH_COMPRA_EFETIVA"),
        (code == model.NATIONAL).alias("EH_COMPRA_NACIONAL"),
        code.isin(*model.WITHDRAWALS).alias("EH_SAQUE_EFETIVO"),
        code.isin(*model.ADJUSTMENTS).alias("EH_AJUSTE_CONTESTACAO"),
        (low[0].contains("sigilo") | low[1].contains("sigilo") | low[2].contains("sigilo")).alias("EH_SIGILOSO"),
    )
    effective = F.col("EH_COMPRA_EFETIVA") | F.col("EH_SAQUE_EFETIVO")
    positive = F.coalesce(F.col("VALOR_CENTAVOS") > 0, F.lit(False))
    return first.withColumns(
        {
            "FAVORECIDO_IDENTIFICADO": F.col("FAVORECIDO_ID").isNotNull(),
            "ANO_TRANSACAO": F.year("DATA_DT"),
            "VALOR_NUM": F.col("VALOR_CENTAVOS").cast("double") / 100,
            "EH_OPERACAO_EFETIVA": effective,
            "EH_OPERACAO_POSITIVA_NAO_AJUSTE": effective & positive & ~F.col("EH_AJUSTE_CONTESTACAO"),
        }
    )


def with_transaction_ids(df: DataFrame, place: str = "LINHA") -> DataFrame:
    """ID_TRANSACAO: source month, or file where there is none, and the row's place in its file (as of ``sources.places``).

    An ID_TRANSACAO that is there stays.
    """
    if "ID_TRANSACAO" in df.columns:
        return df
    source = F.col("COMPETENCIA_ARQUIVO" if "COMPETENCIA_ARQUIVO" in df.columns else "ARQUIVO_ORIGEM")
    return df.withColumn("ID_TRANSACAO", F.concat(source, F.lit(":"), F.lpad(F.col(place).cast("string"), 8, "0")))


def with_calendar(df: DataFrame) -> DataFrame:
    """Month and weekday of the transaction (0 is Sunday)."""
    return df.withColumns({"MES_TRANSACAO": F.month("DATA_DT"), "DIA_SEMANA": F.dayofweek("DATA_DT") - 1})


def with_extract_year(df: DataFrame) -> DataFrame:
    """The statement's year, or else that of the source month."""
    fallback = F.substring("COMPETENCIA_ARQUIVO", 1, 4).try_cast("int")
    return df.withColumn("ANO_EXTRATO_GEO", F.coalesce("ANO_EXTRATO_REF", fallback))
