"""Web pages as evidence: canonical addresses, hosts that may be used, the newest record per address, official hosts first."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bound

# schemes' usual ports, and suffixes of hosts that are never used.
PORTS = {"https": "443", "http": "80"}
LOCAL = ("localhost", ".localhost", ".local")
#: Scheme, user, host (a name or an address in brackets), port, path, query. Fragments are dropped.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]\s]+)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$"
#: Addresses of four numbers that are private, loopback, link-local, multicast, reserved or unspecified.
_CLOSED_V4 = r"^(0|10|127|22[4-9]|2[34][0-9]|25[0-5])\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
_V4 = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, n)


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(_part(url, 3)), r"\.$", ""), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without the segments ``.`` and ``..``, the latter taking the one before with it."""
    # each segment in turn: "." adds nothing, ".." takes the last away; either as last segment leaves a slash
    last = lambda s, n: n == F.size(s) - 1

    def whole(s: Column) -> Column:
        steps = F.arrays_zip(s.alias("s"), F.sequence(F.lit(0), F.size(s) - 1).alias("n"))
        add = lambda out, e: (
            F.when(e["s"] == ".", F.when(last(s, e["n"]), F.concat(out, F.array(F.lit("")))).otherwise(out))
            .when(
                e["s"] == "..",
                F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.when(last(s, e["n"]), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))),
            )
            .otherwise(F.concat(out, F.array(e["s"])))
        )
        return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), add), "/"))

    return bound(F.split(F.substring(path, 2, 1 << 30), "/", -1), whole)


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no usual port, no user, no dot segments, a path of at least a slash, the query as it is, no fragment. Null if unreadable."""
    scheme, port, query = F.lower(_part(url, 1)), _part(url, 4), _part(url, 6)
    usual = F.lit(False)
    for name, number in PORTS.items():
        usual = usual | ((scheme == name) & (port == number))
    path = F.when(_part(url, 5) == "", "/").otherwise(_part(url, 5))
    made = F.concat(scheme, F.lit("://"), host_of(url), F.when(usual | (port == ""), "").otherwise(F.concat(F.lit(":"), port)), without_dots(path), query)
    return F.when(host_of(url).isNotNull(), made)


def is_official(host: Column, suffixes: Collection[str]) -> Column:
    """Whether a host is one of the official domains or below one."""
    out = F.lit(False)
    for suffix in sorted(suffixes):
        out = out | (host == suffix) | host.endswith("." + suffix)
    return F.coalesce(out, F.lit(False))


def usable_host(url: Column, schemes: Collection[str] = ("https",)) -> Column:
    """The host if a page may be used: its scheme is allowed, it names no user, and its host is public. Else null."""
    host = host_of(url)
    local = F.lit(False)
    for name in LOCAL:
        local = local | (host == name) | (host.endswith(name) if name.startswith(".") else F.lit(False))
    closed = local | host.startswith("[") | (host.rlike(_V4) & host.rlike(_CLOSED_V4))
    return F.when(F.lower(_part(url, 1)).isin(*schemes) & (_part(url, 2) == "") & ~closed, host)


def evidence(
    pages: DataFrame,
    official: Collection[str],
    limit: int,
    group: str,
    url: str = "url",
    rank: str = "rank",
    published: str | None = None,
    cutoff: Column | None = None,
    official_only: bool = False,
    schemes: Collection[str] = ("https",),
) -> DataFrame:
    """(group, POSICAO, URL, HOST, OFICIAL, rank, published) of the pages that may be used as evidence: at most ``limit`` per group.

    Of pages of one canonical address in a group the newest stays, then the one of the best rank. With a ``cutoff``, older pages and those of unknown date are refused.
    Official hosts come first, then the given rank, host and address.
    """
    when = F.lit(None).cast("timestamp") if published is None else F.col(published)
    found = pages.select(
        F.col(group), canonical(F.col(url)).alias("URL"), usable_host(F.col(url), schemes).alias("HOST"), F.col(rank).alias("RANK"), when.alias("PUBLICADO")
    ).filter("URL IS NOT NULL AND HOST IS NOT NULL")
    if cutoff is not None:
        found = found.filter(F.col("PUBLICADO") >= cutoff)  # an unknown date isn't above it
    found = found.withColumn("OFICIAL", is_official(F.col("HOST"), official))
    if official_only:
        found = found.filter("OFICIAL")
    newest = F.max_by(F.struct("HOST", "RANK", "PUBLICADO", "OFICIAL"), F.struct(F.coalesce(F.unix_micros("PUBLICADO"), F.lit(-(2**62))), -F.col("RANK"), "HOST"))
    one = found.groupBy(group, "URL").agg(newest.alias("e")).select(group, "URL", "e.*")
    order = Window.partitionBy(group).orderBy(F.desc("OFICIAL"), "RANK", "HOST", "URL")
    return one.withColumn("POSICAO", F.row_number().over(order)).filter(F.col("POSICAO") <= limit)
