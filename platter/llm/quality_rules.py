"""Quality rules as a ledger of bits: every rule is worked out once, policies read the bits.

Each document gets its measurements and one long, ``failure_bits``, in which bit i
says that rule i failed. A policy is a named, versioned set of rules; to apply one,
to change one or to ask what a rule costs, only the ledger is read, never the text.

A text has too few distinct words if they are under a tenth of its words, or under 200 from 2,000 words on: what a
text adds in new words gets less the longer it is, and no length brings a sudden pardon.

Defined results: a null or blank text has no words, so every measurement is 0 and
only ``few_words`` fails. Repeated rows and repeated ids each get their own row.
An empty table gives an empty ledger. Very long texts are read whole. Of the input only the id and the text are read,
so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import let, whole_text, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
    "n_marks",
    "n_distinct_words",
)


def _rules(m) -> tuple[tuple[str, Column], ...]:
    """(name, does it fail) in the order of the bits; append only, so that old ledgers stay readable."""
    return (
        ("few_words", m("n_words") < 20),
        ("repeated_words", 100 * m("n_repeat_words") > 30 * m("n_words")),
        ("symbols", 100 * m("n_symbols") > 30 * m("n_words")),
        ("capitals", 100 * m("n_capitals") > 50 * m("word_chars")),
        ("marks", 100 * m("n_marks") > 50 * m("n_words")),
        ("repeated_lines", (m("n_dup_lines") > 3) & (100 * m("n_dup_lines") > 50 * m("n_lines"))),
        ("long_words", m("word_chars") > 30 * m("n_words")),
        ("few_distinct_words", (m("n_words") >= 20) & (100 * m("n_distinct_words") < F.least(10 * m("n_words"), F.lit(20_000)))),
    )


RULES = (
    "few_words",
    "repeated_words",
    "symbols",
    "capitals",
    "marks",
    "repeated_lines",
    "long_words",
    "few_distinct_words",
)

#: Versioned policies: a document is kept if none of the named rules fails.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": RULES,
}


def policy_mask(policy: str) -> int:
    return sum(1 << RULES.index(name) for name in POLICIES[policy])


def _count(text: Column, pattern: str) -> Column:
    """Characters that ``pattern``, one character class, matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _covered(hashes: Column) -> Column:
    """Words that lie in a window found twice or more, given the hash of each window."""

    def of_sorted(z: Column) -> Column:
        again = F.filter(
            z,
            lambda x, i: (F.get(z, i - 1)["h"] == x["h"]) | (F.get(z, i + 1)["h"] == x["h"]),
        )
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        steps = let(
            starts,
            lambda s: F.transform(
                s, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - at, F.lit(WINDOW)))
            ),
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(F.sort_array(numbered), of_sorted)
    )


def repeat_words(words: Column) -> Column:
    """Words in ``WINDOW``-word windows that the text has twice or more, the first included.

    Windows are told apart by a 64-bit hash within one text.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(hashes, _covered))


def measures(text: Column) -> Column:
    """All measurements of a text, as a struct of longs."""

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
            "n_symbols": _count(text, r"[#*$%&|<>]"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": repeat_words(words),
            "n_lines": F.size(lines),
            "n_capitals": _count(text, r"\p{Lu}+"),
            "n_marks": _count(text, r"!+"),
            "n_distinct_words": F.size(F.array_distinct(words)),
        }
        return F.struct(*[values[name].cast("long").alias(name) for name in MEASURES])

    return let(words_of(text), of_words)


def rule_bits(measured: Column) -> Column:
    """The failure bits of measured text."""
    bits = F.lit(0).cast("long")
    for at, (_, fails) in enumerate(_rules(lambda name: measured[name])):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << at)).otherwise(F.lit(0)).cast("long"))
    return bits


def passes(bits: Column, policy: str = "v1") -> Column:
    return bits.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, every measurement, ``failure_bits``.

    A plain projection: no shuffle, one pass over the text.
    """
    measured = docs.select(F.col(id_col).alias("_id"), measures(whole_text(text_col)).alias("_m"))
    return measured.select(
        F.col("_id").alias(id_col),
        *[F.col("_m")[name].alias(name) for name in MEASURES],
        rule_bits(F.col("_m")).alias("failure_bits"),
    )


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy rejects, and what would come back without it.

    The ledger is summed to one row per pattern of bits (at most 2 to the number of
    rules), and the patterns are read bit by bit.
    """
    mask = policy_mask(policy)
    patterns = book.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    names = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << RULES.index(n)).cast("long").alias("bit")) for n in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(names).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_by_it_alone"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns."""
    return docs.where(passes(let(measures(whole_text(text_col)), rule_bits), policy))
