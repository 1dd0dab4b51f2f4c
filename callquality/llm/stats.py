"""Text statistics as Spark column expressions, all evaluated in the JVM."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from callquality.llm.common import WORD, let, words

#: Very common words of the languages in the corpus, lower case.
STOP_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er sie",
    "en": "the be to of and that have with a in is it for was on are as by at from this or an",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec",
}
SYMBOLS = "#*$%&|<>"
#: A repeated window is looked for by its hash, with its place in the low bits: a text has fewer words than that.
PLACE_BITS = 30


def stop_word_list() -> list[str]:
    return sorted({w for line in STOP_WORDS.values() for w in line.split()})


def _is_stop_word(word: Column) -> Column:
    """Whether a word is in the list, case aside, without what follows its last letter, digit or underscore."""
    stops = stop_word_list()
    most = max(len(w.encode()) for w in stops)
    whole = F.substring(word, -1, 1).isin(*f"{string.ascii_letters}{string.digits}_")
    return F.when(whole, (F.octet_length(word) <= most) & F.lower(word).isin(*stops)).otherwise(F.lower(F.regexp_replace(word, r"\W+$", "")).isin(*stops))


def _count_of(text: Column, kind: str) -> Column:
    """Number of characters of a character class."""
    return F.regexp_count(text, F.lit(kind)).cast("long")


def repeated_words(word_array: Column, width: int = 3) -> Column:
    """Words inside ``width``-word windows that occur at least twice in the text, the first occurrence included."""

    def covered(positions: Column) -> Column:
        reach = F.transform(positions, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(positions, k + 1) - p, F.lit(width))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    def neighbours(ordered: Column, same) -> Column:
        return let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))))

    def repeats(hashes: Column) -> Column:
        # Sorted by hash, windows that may be equal are neighbours; of those few, the words decide.
        placed = F.transform(F.slice(hashes, 1, F.size(hashes) - (width - 1)), lambda h, p: h.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(p.cast("long")))
        alike = neighbours(F.sort_array(placed), lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS))
        places = F.transform(alike, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
        worded = F.transform(places, lambda p: F.struct(F.concat_ws(" ", *[F.get(word_array, p + k) for k in range(width)]).alias("g"), p.alias("p")))
        found = F.transform(neighbours(F.sort_array(worded), lambda x, y: x["g"] == y["g"]), lambda x: x["p"])
        return let(F.sort_array(found), covered)

    # Without equal hashes no window repeats. The last windows are short, and harmless here.
    hashes = F.transform(word_array, lambda x, i: F.xxhash64(x, *[F.get(word_array, i + k) for k in range(1, width)]))
    count = let(hashes, lambda h: F.when((F.size(h) >= width) & (F.size(F.array_distinct(h)) < F.size(h)), repeats(h)).otherwise(0))
    return F.coalesce(count, F.lit(0)).cast("long")


def text_statistics(text: Column, names: tuple[str, ...] | None = None) -> Column:
    """Struct of statistics of a whole text, all or those named; null counts as empty.

    n_words, word_chars, n_chars, n_symbols, n_bangs, n_upper, n_digits, n_lines (with a word), n_dup_lines,
    n_repeat_words, n_distinct_words, n_stop_words: long.
    """
    text = F.coalesce(text, F.lit(""))

    def from_words(text: Column, w: Column, lines: Column) -> Column:
        as_long = lambda c: c.cast("long")
        found = {
            "n_words": lambda: as_long(F.size(w)),
            "word_chars": lambda: as_long(F.length(F.array_join(w, ""))),
            "n_chars": lambda: as_long(F.length(text)),
            "n_symbols": lambda: _count_of(text, f"[{re.escape(SYMBOLS)}]"),
            "n_bangs": lambda: as_long(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))),
            "n_upper": lambda: _count_of(text, r"\p{Lu}"),
            "n_digits": lambda: _count_of(text, "[0-9]"),
            "n_lines": lambda: as_long(F.size(lines)),
            "n_dup_lines": lambda: as_long(F.size(lines) - F.size(F.array_distinct(lines))),
            "n_repeat_words": lambda: repeated_words(w),
            "n_distinct_words": lambda: as_long(F.size(F.array_distinct(w))),
            "n_stop_words": lambda: as_long(F.size(F.filter(w, _is_stop_word))),
        }
        return F.struct(*[found[n]().alias(n) for n in names or found])

    worded = lambda t: F.filter(F.split(t, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    return let(text, lambda t: let(words(t), lambda w: let(worded(t), lambda lines: from_words(t, w, lines))))
