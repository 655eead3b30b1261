"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a bounded sample, and the rules are tried in
the order of rejections per cost: a text that a cheap rule turns down is not measured for the dear
ones. The order changes what is computed, never which texts are kept, as a text is kept only if no
rule rejects it.

A null text counts as one without words. Everything is built-in expressions; words are runs of other
than the six ASCII white-space characters.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.durable import written_once
from .tables import text_of

# The sample that costs and rejections are estimated on; nothing else is taken from it.
SAMPLE_ROWS = 2_000

# Thresholds, shares in percent. The first two are the base rules; the others are wide of ordinary prose.
MIN_WORDS = 50
MAX_REPEATED = 50
MAX_SYMBOLS = 30
MAX_DUP_LINES = 50
MEAN_WORD_CHARS = (2, 15)
MAX_SHOUTED = 60
MAX_STOPS = 60

_BLANKS = " \t\n\u000b\u000c\r"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever body does with it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text holds twice or more, in one sort of the windows."""

    def counted(hashes: Column, w: Column) -> Column:
        last = F.size(hashes)
        places = F.sequence(F.lit(1), last)

        # The words stand beside the hash, so that windows whose hashes are equal by chance differ.
        def window(i: Column) -> Column:
            return F.struct(F.element_at(hashes, i).alias("h"), F.slice(w, i, 3).alias("w"), i.alias("i"))

        def repeated(s: Column) -> Column:
            def same(k: Column, other: Column) -> Column:
                one, two = F.element_at(s, k), F.element_at(s, other)
                return (one["h"] == two["h"]) & (one["w"] == two["w"])

            twice = F.filter(places, lambda k: ((k > 1) & same(k, F.greatest(k - 1, F.lit(1)))) | ((k < last) & same(k, F.least(k + 1, last))))
            starts = F.transform(twice, lambda k: F.element_at(s, k)["i"])
            covered = F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))
            return F.size(F.array_distinct(covered))

        # Most texts have no window twice, and a hash set shows that without the sort.
        return F.when(F.size(F.array_distinct(hashes)) == last, F.lit(0)).otherwise(
            let(F.sort_array(F.transform(places, window)), repeated)
        )

    def whole(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, lambda h: counted(h, w)))

    return let(words, whole).cast("long")


@dataclass(frozen=True)
class Rule:
    """A rule that rejects a text: `rejects(text, words)` is true or false, never null."""

    name: str
    reads_words: bool
    rejects: Callable[[Column, Column | None], Column]


def _over(part: Column, percent: int, whole: Column) -> Column:
    return 100 * part > percent * whole


def _rules() -> tuple[Rule, ...]:
    least, most = MEAN_WORD_CHARS
    return (
        Rule("short", True, lambda text, w: F.size(w) < MIN_WORDS),
        Rule("repeats", True, lambda text, w: _over(n_repeat_words(w), MAX_REPEATED, F.size(w))),
        Rule("symbols", True, lambda text, w: _over(n_symbols(text), MAX_SYMBOLS, F.size(w))),
        Rule("dup_lines", False, lambda text, w: _over(n_dup_lines(text), MAX_DUP_LINES, F.size(F.split(text, "\n")))),
        Rule("word_length", True, lambda text, w: ~word_chars(w).between(least * F.size(w), most * F.size(w))),
        # Of the letters of all scripts: in one without capitals a single acronym would be all there is.
        Rule("shouted", False, lambda text, w: _over(F.regexp_count(text, F.lit(r"\p{Lu}")), MAX_SHOUTED, F.regexp_count(text, F.lit(r"\p{L}")))),
        Rule("exclaims", True, lambda text, w: _over(F.regexp_count(text, F.lit("[!?]")), MAX_STOPS, F.size(w))),
    )


RULES = _rules()


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most about `rows` texts, drawn over the whole table and written once."""
    total = docs.count()
    drawn = docs.select("text").sample(min(1.0, rows / max(total, 1)), seed=17)
    return written_once(drawn.select(text_of().alias("text")), "rule-sample")


def _alone(rule: Rule) -> Column:
    text = F.col("text")
    return let(words_of(text), lambda w: rule.rejects(text, w)) if rule.reads_words else rule.rejects(text, None)


def in_order(docs: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules by rejections per second on a sample, best first."""
    sample = sampled(docs)
    # The words are part of what a rule costs only if it looks at them, so each rule is timed by itself.
    found = []
    for rule in rules:
        began = time.monotonic()
        n_rejected = sample.select(F.count_if(_alone(rule))).first()[0]
        found.append((n_rejected / max(time.monotonic() - began, 1e-6), rule.name, rule))
    return [rule for _, _, rule in sorted(found, key=lambda f: (-f[0], f[1]))]


def rejected(text: Column, words: Column, rules: Sequence[Rule]) -> Column:
    """Whether some rule rejects the text; later rules are not evaluated for one that is turned down."""
    verdict = F.lit(False)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(text, words), F.lit(True)).otherwise(verdict)
    return verdict


def keep(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    ordered = in_order(docs) if rules is None else rules
    text = text_of()
    return docs.where(~let(words_of(text), lambda w: rejected(text, w, ordered)))


def measured(docs: DataFrame, carry: Sequence[str] = ("doc_id",), rules: Sequence[Rule] | None = None) -> DataFrame:
    """The carried columns, the base counts of every text, and whether it is kept.

    The counts are asked of all texts, so the cascade behind them only judges what the base rules leave.
    """
    ordered = in_order(docs) if rules is None else rules
    text = F.col("_text")

    def row(w: Column) -> Column:
        return F.struct(
            w.alias("_words"),
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).alias("word_chars"),
            n_symbols(text).alias("n_symbols"),
            n_dup_lines(text).alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
        )

    named = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(carry)], text_of().alias("_text"))
    # inline is a step of its own in the plan, so nothing in it is computed twice.
    counted = named.select("*", F.inline(F.transform(F.array(words_of(text)), row)))
    base_failed = (F.col("n_words") < MIN_WORDS) | _over(F.col("n_repeat_words"), MAX_REPEATED, F.col("n_words"))
    judged = [r for r in ordered if r.name not in ("short", "repeats")]
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejected(text, F.col("_words"), judged))
    return counted.withColumn("base_failed", base_failed).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        kept.alias("kept"),
    )
