"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callquality.llm.stats import text_statistics


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= top / bottom <= high``; either limit may be None. ``bottom`` of zero counts as one."""

    name: str
    top: str
    bottom: str | None = None
    low: float | None = None
    high: float | None = None


#: The threshold table: lengths, symbol, stop-word and line ratios.
BASE_RULES = (
    Rule("too_few_words", "n_words", None, 50, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.5),
)
METHOD_RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.3),
    Rule("bangs_per_word", "n_bangs", "n_words", None, 0.3),
    Rule("upper_case_share", "n_upper", "word_chars", None, 0.4),
    Rule("digit_share", "n_digits", "word_chars", None, 0.3),
    Rule("stop_words", "n_stop_words", None, 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def _failed(rule: Rule, stats: Column) -> Column:
    # Multiplied out, so that whole numbers compare exactly.
    top = stats[rule.top]
    bottom = F.greatest(stats[rule.bottom], F.lit(1)) if rule.bottom else F.lit(1)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (top < bottom * F.lit(rule.low))
    if rule.high is not None:
        out = out | (top > bottom * F.lit(rule.high))
    return out


def quality_rules(
    docs: DataFrame, text_col: str = "text", out_col: str = "quality_rules", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = METHOD_RULES
) -> DataFrame:
    """All columns of ``docs`` and the struct ``out_col``: the statistics that the rules use, ``failed`` (names), ``base_failed``, ``kept``.

    One narrow projection, no shuffle. A null text counts as empty, has no words and fails; other columns may be
    anything, and a column already named ``out_col`` is replaced. Repeated rows stay. An empty table stays empty.
    """
    used = dict.fromkeys(c for r in (*base, *rules) for c in (r.top, r.bottom) if c)
    stats = docs.withColumn(out_col, text_statistics(docs[text_col], tuple(used)))
    at = stats[out_col]
    fails = {r.name: _failed(r, at) for r in (*base, *rules)}
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | fails[r.name]
    any_failed = base_failed
    for r in rules:
        any_failed = any_failed | fails[r.name]
    names = F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in fails.items()]))
    fields = [at[f.name].alias(f.name) for f in stats.schema[out_col].dataType.fields]
    return stats.withColumn(out_col, F.struct(*fields, names.alias("failed"), base_failed.alias("base_failed"), (~any_failed).alias("kept")))
