"""Secrets in texts: trigram inverted index first, regular expressions second.

Every rule's regular expression implies a Boolean query over trigrams
(``trigram.clauses``). The inverted index holds, for each trigram that some query
names, its postings as bitmaps of 32,768 rows each, so that a frequent
trigram is many small bitmaps built up before the shuffle, never one long list. Rows are
numbered by file and index in it, so bitmaps are dense whatever the ids are. A clause
intersects the bitmaps of its trigrams (``bitmap_and_agg``), a rule unites its
clauses (``bitmap_or_agg``), and only the candidates are verified by the regular
expression. Rules without a mandatory trigram are run over every text. All of
it is DataFrame functions. The candidates are written before they are joined to the texts, so that Spark
knows their size: texts stay where they are as long as the candidates can be broadcast.

The index may name too many candidates, never too few, so results equal a full scan.

Defined results: a null text is the empty text and has no span. Ids play no part: rows that repeat one, or have
none, are each looked up by their place. Positions count code points; ends are exclusive. Other columns,
whatever their names, are kept and play no part; a column of the output's name is replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered, written
from .trigram import clauses


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose
    ``group`` is shorter than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules whose spans every user can rely on, in order of rank.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Vendors' formats of keys, found in addition.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE_RULES + MORE_RULES


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, bucket, bits): which rows (``_id`` long, ``_text``) hold which of ``grams``, as bitmaps."""
    low = F.lower("_text")
    held = F.filter(
        F.array(*(F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull()
    )
    return (
        rows.filter(F.col("_text").isNotNull())
        .select("_id", low.alias("_low"))
        .select("_id", F.explode(held).alias("gram"))
        .groupBy("gram", F.bitmap_bucket_number("_id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))
    )


def _ids(bitmaps: DataFrame) -> DataFrame:
    """A row for each bit that is set, with its id in ``_id``."""
    byte = F.substring("bits", F.col("_byte") + 1, F.lit(1))
    place = F.col("_byte") * 8 + F.col("_bit")
    return (
        bitmaps.withColumn(
            "_byte",
            F.explode(F.expr("filter(sequence(0, length(bits) - 1), i -> substring(bits, i + 1, 1) <> X'00')")),
        )
        .withColumn("_value", F.conv(F.hex(byte), 16, 10).cast("int"))
        .withColumn("_bit", F.explode(F.expr("filter(sequence(0, 7), j -> getbit(_value, j) = 1)")))
        .withColumn(
            "_id",
            F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(
                F.col("bucket") * 32768 - place
            ),
        )
        .drop("bits", "_byte", "_value", "_bit", "bucket")
    )


def candidates(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_id, _rules): for each of ``rows`` (``_id`` long, ``_text``) that may match, the bits of the rules to verify."""
    spark = rows.sparkSession
    queries = [(n, c, g, len(grams)) for n, r in enumerate(rules) for c, grams in enumerate(clauses(r.pattern)) for g in grams]
    quoted = lambda g: g.replace("\\", "\\\\").replace("'", "\\'")
    values = ", ".join(f"({n}, {c}, '{quoted(g)}', {size})" for n, c, g, size in queries)
    wanted = spark.sql(f"SELECT * FROM VALUES {values} AS wanted(rule, clause, gram, n_grams)")
    matched = (
        postings(rows, sorted({q[2] for q in queries}))
        .join(F.broadcast(wanted), "gram")
        .groupBy("rule", "clause", "n_grams", "bucket")
        .agg(F.count(F.lit(1)).alias("_n"), F.bitmap_and_agg("bits").alias("bits"))
        .filter(F.col("_n") == F.col("n_grams"))
        .groupBy("rule", "bucket")
        .agg(F.bitmap_or_agg("bits").alias("bits"))
    )
    return _ids(matched).groupBy("_id").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("_rules"))


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's matches, leftmost first."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, rule.pattern, -1), lambda s: F.char_length(s))
    tested = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(
        between.alias("gap"),
        F.transform(whole, lambda s: F.char_length(s)).alias("size"),
        F.transform(tested, lambda s: F.char_length(s)).alias("tested"),
    )
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(done, part):
        start = done["at"] + part["gap"]
        end = start + F.coalesce(part["size"], F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")
        )
        spans = F.when(part["tested"] >= rule.least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))
    found = F.aggregate(parts, start, step, lambda done: done["spans"])
    return F.when(F.size(whole) > 0, found).otherwise(nothing)


def with_spans(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text_col: str = "text",
    out_col: str = "secret_spans",
) -> DataFrame:
    """``docs``, a scan of Parquet files, with an array of spans, by start and then by the rules' order."""
    always = sum(1 << n for n, r in enumerate(rules) if not clauses(r.pattern))
    docs = docs.drop(out_col)
    place, marks = free_name(docs, "_secret_place"), free_name(docs, "_secret_rules")
    texts = numbered(docs.select(F.col(text_col).alias("_text")), "_id")
    found = written(candidates(texts, rules), "candidates").select(F.col("_id").alias(place), F.col("_rules").alias(marks))
    joined = numbered(docs, place).join(found, place, "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    to_verify = F.coalesce(F.col(marks), F.lit(0)).bitwiseOR(F.lit(always))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    spans = [
        F.when(F.getbit(to_verify, F.lit(n)) == 1, rule_spans(text, rule, n)).otherwise(nothing)
        for n, rule in enumerate(rules)
    ]
    return joined.withColumn(out_col, F.array_sort(F.concat(*spans))).drop(place, marks)


def spans_string(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each maximal run of overlapping spans replaced by ``mark``.

    Texts without a span, and null texts, are unchanged.
    """
    spans = free_name(docs, "_spans")
    found = with_spans(docs, text_col=text_col, out_col=spans)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done, span):
        gap = F.substring(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        marked = F.when(span["start"] >= done["at"], F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), marked.alias("out"))

    cleaned = F.aggregate(
        spans, start, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.char_length(text)))
    )
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cleaned).otherwise(text)).drop(spans).select(*docs.columns)
