"""Texts and the phrases they hold, met through an index instead of a matcher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize

ITEMS_PER_ROW = 1_024  # items one text is held against at a time
HOT_TEXTS = 200_000  # texts with one word that meet its phrases in one task
AFFIX = 16  # most characters of an affix key
WINDOW = 8  # characters of an inner key; shorter phrases have keys of 3 or fewer
#: ways in which a word of a phrase lies in a word of a text
WHOLE, ENDS, BEGINS, INSIDE = 0, 1, 2, 3


def in_slices(df: DataFrame, key: str, item: str, most: int = ITEMS_PER_ROW) -> DataFrame:
    """(key, items): the items of each key in lists of about ``most`` at most, dealt by hash."""
    wide = materialize(
        df.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / most).alias("_parts")).filter("_parts > 1"), "wide"
    )
    dealt = df.join(wide, F.col(key) == F.col("_k"), "left")
    part = F.pmod(F.xxhash64(item), F.coalesce("_parts", F.lit(1)))
    return dealt.groupBy(key, part.alias("_part")).agg(F.collect_list(item).alias("items")).drop("_part")


def _windows(word: Column, n: int) -> Column:
    """Distinct stretches of n characters."""
    last = F.length(word) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(word, i, F.lit(n))))).otherwise(F.array())


def _tagged(kind: int, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))


def _text_keys(word: Column) -> Column:
    """Every key under which a word of a phrase that lies in this word of a text can stand."""
    sizes = F.sequence(F.lit(1), F.least(F.length(word), F.lit(AFFIX)))
    return F.concat(
        F.array(F.struct(F.lit(WHOLE).alias("kind"), word.alias("key"))),
        _tagged(ENDS, F.transform(sizes, lambda n: F.right(word, n))),
        _tagged(BEGINS, F.transform(sizes, lambda n: F.left(word, n))),
        *[_tagged(INSIDE, _windows(word, n)) for n in (1, 2, 3, WINDOW)],
    )


def _phrase_keys(phrase: Column) -> Column:
    """Keys of a phrase, each of which some word of every text that holds the phrase has.

    Its first word ends a word of the text, its last one begins one, those between are whole; a single word may lie anywhere in one.
    """
    words = F.split(phrase, " ")
    n, only = F.size(words), F.length(phrase)
    longest = F.lit(AFFIX)
    several = F.concat(
        F.array(
            F.struct(F.lit(ENDS).alias("kind"), F.right(words[0], longest).alias("key")),
            F.struct(F.lit(BEGINS).alias("kind"), F.left(F.element_at(words, -1), longest).alias("key")),
        ),
        _tagged(WHOLE, F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0)))),
    )
    single = F.when(only >= WINDOW, _windows(phrase, WINDOW)).when(only >= 3, _windows(phrase, 3)).when(
        only == 2, _windows(phrase, 2)).otherwise(_windows(phrase, 1))
    return F.when(n > 1, several).otherwise(_tagged(INSIDE, single))


def _lies_in(word: Column, phrase: Column, kind: Column) -> Column:
    """Whether the word of a text can take the phrase's word of that kind; the whole phrase is compared later."""
    first, last = F.substring_index(phrase, " ", 1), F.substring_index(phrase, " ", -1)
    return (
        F.when(kind == ENDS, word.endswith(first)).when(kind == BEGINS, word.startswith(last))
        .when(kind == INSIDE, F.contains(word, phrase)).otherwise(F.lit(True))
    )


def phrase_index(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(side, word, phrase, n): every phrase under the words of texts that its rarest key allows.

    ``words`` has each distinct word of the texts with the number of texts it is in, n. A
    phrase with a key that no word has is in no text.
    """
    keys = materialize(phrases.select("side", "phrase", F.inline(F.array_distinct(_phrase_keys(F.col("phrase"))))), "keys")
    asked = keys.select("kind", "key").distinct()
    held = words.select("word", "n", F.inline(_text_keys(F.col("word")))).join(asked, ["kind", "key"], "left_semi")
    held = materialize(held, "held")
    weight = held.groupBy("kind", "key").agg(F.sum("n").alias("weight"))
    weighed = keys.join(weight, ["kind", "key"], "left").groupBy("side", "phrase").agg(
        F.min(F.struct(F.coalesce("weight", F.lit(0)).alias("weight"), "kind", "key")).alias("x")
    )
    chosen = weighed.filter("x.weight > 0").select("side", "phrase", "x.kind", "x.key")
    return chosen.join(held, ["kind", "key"]).filter(_lies_in(F.col("word"), F.col("phrase"), F.col("kind"))).select(
        "side", "word", "phrase", "n"
    )


def _holds(text: Column, phrase: Column) -> Column:
    start = F.concat(F.lit(" "), F.left(F.substring_index(phrase, " ", 1), F.lit(4)))
    return F.contains(text, phrase) & F.contains(F.concat(F.lit(" "), text), start)


def phrase_hits(
    texts: DataFrame, phrases: DataFrame, items_per_row: int = ITEMS_PER_ROW, hot_texts: int = HOT_TEXTS
) -> DataFrame:
    """Rows (row) of ``texts`` (row, side, norm) that hold a phrase of their side (side, phrase).

    Texts and phrases are lower-case words parted by one space. A phrase counts anywhere in the text, also
    inside words, if some word of the text starts with its first four characters.

    Only words move: each text lists its distinct words once, which meet the
    phrases under their rarest word by an equi-join. Words of very many texts are dealt to several tasks. The phrases found
    for a text go to it in bounded lists and are compared in place.
    """
    phrases = materialize(phrases.select("side", "phrase").filter("phrase <> ''").distinct(), "phrases")
    words = texts.select("row", "side", F.explode(F.array_distinct(F.split("norm", " "))).alias("word"))
    vocabulary = materialize(words.groupBy("word").agg(F.count("*").alias("n")), "vocabulary")
    index = materialize(phrase_index(vocabulary, phrases), "index")
    parts = F.ceil(F.col("n") / hot_texts)
    hot = materialize(index.filter(F.col("n") > hot_texts).select(F.col("word").alias("_w"), parts.alias("_parts")).distinct(), "hot")
    dealt = words.join(hot, F.col("word") == F.col("_w"), "left").select(
        "row", "side", "word", F.pmod(F.xxhash64("row"), F.coalesce("_parts", F.lit(1))).alias("part"))
    spread = index.select("side", "word", "phrase", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    met = dealt.join(spread, ["side", "word", "part"]).select("row", "phrase").distinct()
    listed = in_slices(materialize(met, "met"), "row", "phrase", items_per_row).withColumnRenamed("row", "_r")
    found = texts.select("row", "norm").join(listed, F.col("row") == F.col("_r"))
    return found.filter(F.exists("items", lambda p: _holds(F.col("norm"), p))).select("row").distinct()
