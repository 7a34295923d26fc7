"""Quality rules by distribution divergence, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import materialize
from .common import let, words_of

# Character classes, in the order in which they are taken out of a text.
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", "[\\x20\\x09-\\x0D]+"),
    ("letter", "[\\p{L}&&[^A-Z]]+"),
    ("upper", "[A-Z]+"),
    ("stop", "[.,;:!?'\"()-]+"),
    ("symbol", "[#*$%&|<>]+"),
    ("digit", "[0-9]+"),
)
_SPACE, _SYMBOL, _N = 1, 5, len(CLASSES) + 1


@dataclass(frozen=True)
class Rules:
    """Parameters; distances are Jensen-Shannon distances to base 2, from 0 to 1."""

    min_words: int = 50
    max_repeated_percent: int = 50
    common_words: int = 24
    min_chars: int = 200
    min_histogram_words: int = 100
    max_class_distance: float = 0.33
    max_word_distance: float = 0.31


def class_counts(text: Column) -> Column:
    """Characters of each class and, last, of none; each class is cut from what the former left."""
    def without(pattern: str):
        return lambda rests: F.concat(rests, F.array(F.regexp_replace(F.element_at(rests, -1), pattern, "")))

    rests = F.array(text)
    for _, pattern in CLASSES:
        rests = let(rests, without(pattern))
    lengths = F.transform(rests, lambda r: F.length(r).cast("bigint"))
    return let(lengths, lambda n: F.array(*[n[i] - n[i + 1] for i in range(_N - 1)], n[_N - 1]))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the 3-word windows of a text, in order."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.slice(hashes, F.lit(1), F.size(words) - 2))


def covered_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, found by sorting windows with their places."""
    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    places = let(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    return let(places, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda a, b: a + b,
    ))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def language_references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per language: shares of the character classes, the most common words, and their shares.

    All documents are counted, by their words; a null language is a language of
    its own. Words are combined before they are shuffled by (language, word), so a
    language with most rows is spread over its words. One row per language.
    """
    words = docs.select(
        F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.explode(words_of(F.col("text"))).alias("word")
    )
    counts = materialize(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "word_counts")
    classes = counts.select("lang", "n", class_counts(F.col("word")).alias("c")).groupBy("lang").agg(
        F.array(*[F.sum(F.col("c")[i] * F.col("n")) for i in range(_N)]).alias("c"), F.sum("n").alias("n_words")
    )
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    ranked = counts.withColumn("r", F.row_number().over(by_count)).filter(F.col("r") <= rules.common_words)
    tops = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    references = classes.join(tops, "lang").select(
        F.col("lang").alias("_lang"), shares(F.col("c")).alias("_class_share"),
        F.transform("top", lambda x: x["word"]).alias("_common"),
        F.transform("top", lambda x: x["n"] / F.col("n_words")).alias("_common_share"),
    )
    # a written table's size is known, so that texts need not be moved to join it
    return materialize(references, "references")


def _entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of equal length, base 2."""
    terms = F.zip_with(p, q, lambda a, b: _entropy_term((a + b) / 2) - (_entropy_term(a) + _entropy_term(b)) / 2)
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def with_rest(part: Column) -> Column:
    """Shares and, last, what is missing to 1."""
    def rest(p: Column) -> Column:
        return F.greatest(F.lit(1.0) - F.aggregate(p, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))

    return let(part, lambda p: F.concat(p, F.array(rest(p))))


def common_shares(words: Column, common: Column) -> Column:
    """Share of each common word among the words."""
    return F.transform(common, lambda c: (F.size(words) - F.size(F.array_remove(words, c))) / F.size(words))


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def judge_quality(docs: DataFrame, references: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Add the basic counts, the two distances and the verdict to every document.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeated_percent`` of the words in repeated 3-word windows. Otherwise a
    document is rejected if its histogram of character classes (blanks left out)
    or of common words lies further from the reference of its language than
    allowed. Texts under ``min_chars`` word characters or ``min_histogram_words``
    words are not held against the respective reference: their histograms say too
    little (distance null). Null text counts as empty and fails; null language is
    language `und`. Rows are judged one by one, repeated rows alike, an empty
    table gives an empty result. Names in ADDED replace equal ones; columns that
    start with an underscore are reserved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.drop(*ADDED).withColumn("_key", F.coalesce(F.col("lang"), F.lit("und"))).join(
        references, F.col("_key") == F.col("_lang"), "left"
    )
    # each step is a column of its own, so that no step is computed twice
    cut = known.withColumns({"_words": words_of(F.col("text")), "_classes": class_counts(text)})
    counted = cut.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(text).cast("bigint") - F.col("_classes")[_SPACE],
        "n_symbols": F.col("_classes")[_SYMBOL],
        "n_dup_lines": duplicate_lines(text),
        "_windows": window_hashes(F.col("_words")),
        "_visible": F.concat(F.slice("_classes", 1, _SPACE), F.slice("_classes", _SPACE + 2, _N)),
        "_expected": F.concat(F.slice("_class_share", 1, _SPACE), F.slice("_class_share", _SPACE + 2, _N)),
    })
    measured = counted.withColumns({
        "n_repeat_words": F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"), covered_words(F.col("_windows"))
        ).otherwise(F.lit(0).cast("bigint")),
        "class_distance": F.when(
            F.col("word_chars") >= rules.min_chars, F.round(js_distance(shares(F.col("_visible")), F.col("_expected")), 6)
        ),
        "word_distance": F.when(F.col("n_words") >= rules.min_histogram_words, F.round(js_distance(
            with_rest(common_shares(F.col("_words"), F.col("_common"))), with_rest(F.col("_common_share"))
        ), 6)),
    })
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeated_percent * F.col("n_words")
    )
    far = F.coalesce(F.col("class_distance") > rules.max_class_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > rules.max_word_distance, F.lit(False)
    )
    own = [c for c in docs.columns if c not in ADDED]
    done = measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
    # the result stands behind a generator: a filter on it would otherwise be moved
    # down through every step, each of which it would compute again
    return done.select(*own, F.inline(F.array(F.struct(*ADDED))))
