"""From raw text to a published bundle in one call."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .. import model
from ..operators import patterns, primary, rules, staging
from ..operators.rules import CARD
from ..sources import bundle, places, probe, raw, scratch

#: Columns of the fact that flags and matrices read, besides the cardholder.
READ = (
    "UG_ID", "FAVORECIDO_ID", "DATA_DT", "ANO_TRANSACAO", "VALOR_CENTAVOS", "TRANSAÇÃO",
    "FAVORECIDO_IDENTIFICADO", "EH_COMPRA_EFETIVA", "EH_COMPRA_NACIONAL", "EH_SAQUE_EFETIVO", "EH_AJUSTE_CONTESTACAO",
)

def build_bundle(
    spark: SparkSession,
    path: str,
    folder: str,
    limits: DataFrame | None = None,
    settings: Mapping[str, dict] | None = None,
    years: tuple[int, int] = model.COMPLETE_YEARS,
    card: str = CARD,
) -> dict:
    """Stage the text, run the nine rules, and publish the fact, both matrices and the 66 diagnostic tables of complete years. Returns the manifest.

    The fact, the distinct flags and the matrices are tables of the bundle, each written before the next step reads it, so none is worked out twice. Rules and matrices read the fact's columns that they need, dealt once by unit and supplier.
    """
    with bundle.BundleWriter(spark, folder, {"input_path": path, "complete_years": list(years)}) as out:
        layout = probe.layout_of(probe.first_bytes(spark, path))
        if missing := raw.check_header(list(layout.columns))["missing"]:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        placed = staging.with_transaction_ids(places.with_places(probe.read_text(spark, path, layout)))
        staged = out.write("staging", staging.build_staging(placed), "fact")
        fact = scratch.dealt(staged.select(*dict.fromkeys((*READ, card))), "dealt_staging", rules.DEALT, out.tables[-1]["bytes"])
        flags = out.write("flags", primary.primary_flags(fact, rules.limits_table(spark) if limits is None else limits, card, settings, dealt=True), "flags")
        supplier = out.write("matrix_supplier_year", primary.supplier_matrix(fact, flags, card), "matrix")
        unit = out.write("matrix_ug_year", primary.unit_matrix(fact, flags, card), "matrix")
        complete = (primary.complete_years(m, years) for m in (supplier, unit))
        out.write_all(patterns.diagnostic_tables(*complete))
    return bundle.manifest_of(spark, folder)
