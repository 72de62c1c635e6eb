"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the integer measurements and one
``fail_bits`` long whose bit k says that rule k failed; versioned policies are bit masks over it, and
ablations are bitwise aggregates of it, so neither reads a text again. All of it is built-in
expressions: one scan, no shuffle, no Python.

Defined cases: a null text counts as an empty one and fails ``blank`` only; a null id is kept as it
is; repeated rows get equal ledger rows; a measurement that ties with a rule's bound passes it; a very long
text is measured whole; an empty table gives an empty ledger. Of the input's other
columns none is read by ``ledger`` and all are returned by ``keep``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table

_SPACE = "[ \\t\\n\\r\\x0b\\f]+"
_SYMBOLS = "[#$%&*|~^<>{}=+_@]"

#: Measurements, in the order of the ledger's columns.
MEASURES = ("m_chars", "m_words", "m_solid", "m_symbols", "m_bangs", "m_digits", "m_upper", "m_latin", "m_stutter", "m_distinct", "m_lines", "m_distinct_lines", "m_pipes", "m_broken", "m_filler")


#: Rule k sets bit k.
RULES = ("blank", "symbols", "shouting", "exclaiming", "stutter", "digits", "word_length", "repeated_lines", "monotone", "piped", "broken_bytes", "filler")

#: Policies by version: the rules that reject. A version, once used, is never changed.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": RULES,
    "v2": tuple(r for r in RULES if r not in ("word_length", "digits")),
    "lenient": ("blank", "symbols", "shouting", "stutter"),
}


def _failed(m) -> list[Column]:
    """Whether each of RULES fails; all in whole numbers, so that engines agree."""
    words, chars = m("m_words"), m("m_chars")
    return [
        words == 0,
        m("m_symbols") * 25 > chars,
        (m("m_latin") >= 20) & (m("m_upper") * 2 > m("m_latin")),
        m("m_bangs") * 10 > words * 3,
        m("m_stutter") * 5 > words,
        m("m_digits") * 2 > chars,
        m("m_solid") > words * 20,
        (m("m_lines") - m("m_distinct_lines")) * 2 > m("m_lines"),
        (words >= 50) & (m("m_distinct") * m("m_distinct") < words * 4),
        m("m_pipes") * 4 > words,
        m("m_broken") * 100 > chars,
        m("m_filler") > 0,
    ]


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << RULES.index(n) for n in names)


def _measure(text: Column) -> list[Column]:
    """Two steps: arrays first, as they are used more than once."""
    return [
        text.alias("__lw_text"),
        F.filter(F.split(text, _SPACE), lambda x: x != "").alias("__lw_words"),
        F.filter(F.split(text, "\\n"), lambda x: F.trim(x) != "").alias("__lw_lines"),
    ]


def _measures() -> dict[str, Column]:
    text, words, lines = F.col("__lw_text"), F.col("__lw_words"), F.col("__lw_lines")
    n = lambda c: c.cast("long")
    count = lambda p: n(F.regexp_count(text, F.lit(p)))
    return {
        "m_chars": n(F.length(text)),
        "m_words": n(F.size(words)),
        "m_solid": n(F.length(F.regexp_replace(text, _SPACE, ""))),
        "m_symbols": count(_SYMBOLS),
        "m_bangs": count("[!?]"),
        "m_digits": count("[0-9]"),
        "m_upper": count("[A-Z]"),
        "m_latin": n(F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))),
        "m_stutter": n(F.size(F.filter(words, lambda x, i: (i > 0) & (x == words[F.greatest(i - 1, F.lit(0))])))),
        "m_distinct": n(F.size(F.array_distinct(words))),
        "m_lines": n(F.size(lines)),
        "m_distinct_lines": n(F.size(F.array_distinct(lines))),
        "m_pipes": n(F.size(words) - F.size(F.array_remove(words, F.lit("|")))),
        "m_broken": count("\\x{FFFD}"),
        "m_filler": n(F.contains(F.lower(text), F.lit("lorem ipsum")).cast("int")),
    }


def _bits(m) -> Column:
    parts = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(_failed(m))]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, every measurement and ``fail_bits``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_measure(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    rows = rows.select("doc_id", *(c.alias(k) for k, c in _measures().items()))
    return rows.select("doc_id", *MEASURES, _bits(F.col).alias("fail_bits"))


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...], to: str = "keep") -> DataFrame:
    """A ledger with a boolean column: whether the policy keeps the document."""
    return rows.withColumn(to, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablate(rows: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it rejects (what leaving it out
    would bring back), and that the policy rejects. One aggregation over the ledger's bits."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    all_bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    sums = [F.count_if(all_bits != 0).alias("__lw_rejected")]
    for k, name in enumerate(names):
        bit = F.lit(1 << RULES.index(name)).cast("long")
        sums += [F.count_if(all_bits.bitwiseAND(bit) != 0).alias(f"__lw_f{k}"), F.count_if(all_bits == bit).alias(f"__lw_o{k}")]
    parts = [F.struct(F.lit(n).alias("rule"), F.col(f"__lw_f{k}").alias("failing"), F.col(f"__lw_o{k}").alias("only_this"), F.col("__lw_rejected").alias("rejected")) for k, n in enumerate(names)]
    return rows.agg(*sums).select(F.inline(F.array(*parts)))


def keep(docs: DataFrame, policy: str | tuple[str, ...] = "v1", text_col: str = "text") -> DataFrame:
    """The input rows that the policy keeps, with their columns. A filter; no join back."""
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("__lw_row"), *_measure(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    rows = rows.select("__lw_row", *(c.alias(k) for k, c in _measures().items()))
    # The task's number keeps the condition above the measurements: below, each use would measure anew.
    rows = rows.select("__lw_row", _bits(F.col).alias("__lw_bits"), F.spark_partition_id().alias("__lw_task"))
    return rows.where((F.col("__lw_bits").bitwiseAND(F.lit(mask(policy))) == 0) & (F.col("__lw_task") >= 0)).select("__lw_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger of documents, with the verdicts of three policies and the rule that alone
    rejects a document, if one does."""
    rows = ledger(table(spark, sf_dir, "documents"))
    for version in POLICIES:
        rows = apply_policy(rows, version, f"keep_{version}")
    alone = F.when(F.bit_count("fail_bits") == 1, F.array(*map(F.lit, RULES))[F.bit_count(F.col("fail_bits") - 1)])
    return rows.withColumn("only_rule", alone)


_BITS = " | ".join(
    f"(case when {c} then {1 << k} else 0 end)"
    for k, c in enumerate(
        [
            "m_words = 0", "m_symbols * 25 > m_chars", "m_latin >= 20 and m_upper * 2 > m_latin", "m_bangs * 10 > m_words * 3",
            "m_stutter * 5 > m_words", "m_digits * 2 > m_chars", "m_solid > m_words * 20", "(m_lines - m_distinct_lines) * 2 > m_lines",
            "m_words >= 50 and m_distinct * m_distinct < m_words * 4", "m_pipes * 4 > m_words", "m_broken * 100 > m_chars", "m_filler > 0",
        ]
    )
)
_SQL_SPACE = "[ \\t\\n\\r\\x0b\\f]+"
ORACLE = rf"""
with base as (
  select doc_id, coalesce(text, '') t from documents),
parts as (
  select doc_id, t,
    list_filter(string_split_regex(t, '{_SQL_SPACE}'), lambda x: x <> '') w,
    list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') l
  from base),
measured as (
  select doc_id,
    length(t) m_chars, len(w)::bigint m_words,
    length(regexp_replace(t, '{_SQL_SPACE}', '', 'g')) m_solid,
    length(regexp_replace(t, '[^#$%&*|~^<>{{}}=+_@]+', '', 'g')) m_symbols,
    length(regexp_replace(t, '[^!?]+', '', 'g')) m_bangs,
    length(regexp_replace(t, '[^0-9]+', '', 'g')) m_digits,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) m_upper,
    length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) m_latin,
    len(list_filter(w, lambda x, i: i > 1 and x = w[i - 1]))::bigint m_stutter,
    len(list_distinct(w))::bigint m_distinct,
    len(l)::bigint m_lines, len(list_distinct(l))::bigint m_distinct_lines,
    len(list_filter(w, lambda x: x = '|'))::bigint m_pipes,
    length(t) - length(replace(t, chr(65533), '')) m_broken,
    contains(lower(t), 'lorem ipsum')::bigint m_filler
  from parts),
marked as (select *, ({_BITS})::bigint fail_bits from measured)
select *,
  fail_bits & {mask("v1")} = 0 keep_v1, fail_bits & {mask("v2")} = 0 keep_v2, fail_bits & {mask("lenient")} = 0 keep_lenient,
  case when bit_count(fail_bits) = 1 then [{", ".join(f"'{r}'" for r in RULES)}][bit_count(fail_bits - 1) + 1] end only_rule
from marked
"""
