"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from unicodedata import normalize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COMPLETE_YEARS, RULES_VERSION


def _decompositions() -> dict[str, str]:
    """Characters beyond ASCII whose compatibility decomposition holds ASCII characters, with those. None lies beyond the second plane."""
    parts = ((chr(c), "".join(p for p in normalize("NFKD", chr(c)) if p < "\x80")) for c in range(0x80, 0x20000))
    return {c: p for c, p in parts if p}


_PARTS = _decompositions()
_MARKED = "".join(c for c, p in _PARTS.items() if len(p) == 1)
_PLAIN = "".join(p for p in _PARTS.values() if len(p) == 1)
_LONG = {c: p for c, p in _PARTS.items() if len(p) > 1}


def _spelled_out(text: Column) -> Column:
    """Characters that stand for several ASCII characters become those; texts without any aren't taken apart."""
    parts = F.split(F.lit("\0".join(_LONG.values())), "\0")

    def own(c: Column) -> Column:
        place = F.instr(F.lit("".join(_LONG)), c)
        return F.when(place > 0, F.element_at(parts, place)).otherwise(c)

    # characters are looked up by translate; a class of them in a pattern is tried member by member for each character
    return F.when(F.translate(text, "".join(_LONG), "") != text, F.array_join(F.transform(F.split(text, ""), own), "")).otherwise(text)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def missing_to_null(c: Column) -> Column:
    """Trimmed text; empty text and ``-1`` are null."""
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("-1"))


def unit_code(c: Column) -> Column:
    """Unit code; digits are padded to six places and never cut."""
    return bound(missing_to_null(c), padded_code)


def padded_code(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,5}$"), F.lpad(text, 6, "0")).otherwise(text)


def digits(c: Column) -> Column:
    """The digits of a text, null if there are none."""
    return F.nullif(F.regexp_replace(missing_to_null(c), "[^0-9]", ""), F.lit(""))


def folded_name(c: Column) -> Column:
    """Upper case, single spaces, compatibility characters decomposed; what is left beyond ASCII is dropped."""
    return folded_rest(folded_plain(c))


def folded_plain(c: Column) -> Column:
    """The first step of ``folded_name``: what most names are by then."""
    text = F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x1c-\x1f\x85\p{Z}]+", " ")))
    return F.translate(text, _MARKED, _PLAIN)


def folded_rest(plain: Column) -> Column:
    """The second step of ``folded_name``."""
    left = F.regexp_replace(_spelled_out(plain), r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(left)


def folded_lower(c: Column) -> Column:
    return F.lower(F.translate(c, _MARKED, _PLAIN))


def cents(c: Column) -> Column:
    """Amount text with decimal comma to integer cents, half to even; null if it can't be read."""
    return bound(amount_text(c), amount)


def amount_text(c: Column) -> Column:
    """The first step of ``cents``: without currency and blanks."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "R\\$|[ \u00a0]", "")


def amount(text: Column) -> Column:
    """The second step of ``cents``."""
    inner = F.regexp_replace(text, r"[()]", "")
    comma = F.replace(F.replace(inner, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.when(text.contains(","), comma).otherwise(inner)
    value = F.bround(plain.try_cast("decimal(38,10)"), 2) * 100
    return (value * F.when(text.rlike(r"^\(.*\)$"), -1).otherwise(1)).cast("bigint")


def brazilian_date(c: Column) -> Column:
    return F.try_to_date(F.nullif(F.trim(c), F.lit("")), "d/M/yyyy")


def year_or_null(c: Column) -> Column:
    return bound(F.trim(c).try_cast("int"), a_year)


def month_or_null(c: Column) -> Column:
    return bound(F.trim(c).try_cast("int"), a_month)


def a_year(value: Column) -> Column:
    return F.when((value >= 2000) & (value <= 2100), value)


def a_month(value: Column) -> Column:
    return F.when((value >= 1) & (value <= 12), value)


def true(c: str) -> Column:
    """A flag column with null as false."""
    return F.coalesce(F.col(c), F.lit(False))


def _payload(code: str, parts: Sequence[str | Column]) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.concat_ws("|", F.lit(code), F.lit(RULES_VERSION), *texts)


def signal_id(code: str, *parts: str | Column) -> Column:
    """``code_`` and the MD5 of code, rules version and parts; null parts count as empty."""
    return F.concat(F.lit(f"{code}_"), F.md5(_payload(code, parts).cast("binary")))


def short_signal_id(code: str, *parts: str | Column, length: int = 24) -> Column:
    return F.concat(F.lit(f"{code}_"), F.substring(F.sha2(_payload(code, parts).cast("binary"), 256), 1, length))


def number_text(c: Column, places: int = 8) -> Column:
    """A double rounded to ``places`` as shortest decimal text with one decimal at least."""
    text = F.regexp_replace(F.round(c, places).cast(f"decimal(28,{places})").cast("string"), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def period_status(
    year: Column, full: str = "EXERCICIO_COMPLETO", part: str = "PERIODO_PARCIAL", years: tuple[int, int] = COMPLETE_YEARS
) -> Column:
    return F.when(year.between(*years), F.lit(full)).otherwise(F.lit(part))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    return df


def optional(df: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)
