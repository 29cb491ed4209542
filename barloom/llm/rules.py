"""Quality rules as a bitmask ledger, in DataFrame functions only.

measure() evaluates every measurement of a text once, ledger() keeps them with one bit for each rule that
fails, and policies are masks over those bits: applying another version, or asking what a rule costs, reads
the ledger and never the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK

#: Rules in the order of their bits: a document fails where the expression over measurements is true.
RULES = {
    "too_short": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "upper_case": "2 * n_upper > word_chars",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
#: Policy versions: the rules whose failure drops a document.
POLICIES = {1: ("too_short", "repeated_words"), 2: tuple(RULES)}


def _let(value: Column, then) -> Column:
    """then(value), evaluated once however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows of three whose hash occurs twice or more."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

    def twice(pairs: Column) -> Column:
        found = F.transform(pairs, lambda x, k: F.when((x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"]), x["at"]))
        return _let(F.array_sort(F.filter(found, lambda x: x.isNotNull())), covered)

    pairs = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, twice))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words) of every row.

    A null text has no words and no lines, like an empty one; null keys and repeated rows keep their rows;
    an empty table gives none. Window hashes are 64 bits wide and compared within one text only.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(
        F.col(key).alias("key"),
        F.array_remove(F.split(own, WORD_BREAK), "").alias("words"),
        F.filter(F.split(own, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.char_length(F.regexp_replace(own, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(own, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )
    n = F.size("words")
    hashed = cut.select(
        "key", "n_symbols", "n_upper",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, k: F.xxhash64(w, F.get("words", k + 1), F.get("words", k + 2))).alias("hashes"),
    )
    return hashed.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", _repeat_words(F.col("hashes")).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """The measurements and fail_bits: bit k is set if rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, rule in enumerate(rules.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, key, text).withColumn("fail_bits", total)


def mask(names: tuple[str, ...], rules: dict[str, str] = RULES) -> int:
    """The bits of the named rules; a name that the rules lack is an error, a repeated one counts once."""
    order = list(rules)
    return sum(1 << order.index(n) for n in set(names))


def failed(bits: Column, names: tuple[str, ...], rules: dict[str, str] = RULES) -> Column:
    """Whether any of the named rules fails in the fail_bits of a ledger of these rules; null for null bits, false without names."""
    return bits.bitwiseAND(F.lit(mask(names, rules)).cast("long")) != 0


def ablations(entries: DataFrame, names: tuple[str, ...], rules: dict[str, str] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only this rule drops."""
    seen = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))  # 2 ** rules rows at most
    order = list(rules)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << order.index(n)).cast("long").alias("bit")) for n in names]))
    own = F.col("fail_bits").bitwiseAND(F.lit(mask(names, rules)).cast("long"))
    return seen.select("n", own.alias("own"), each.alias("r")).groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(F.col("own").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("own") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
    )
