"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: White space between words, and characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the and of to in is was that for with on as by an are from it at or this "
    "le la les de des du et est en un une que qui dans pour sur avec "
    "der die das und ist in den von zu mit ein eine auf für nicht "
    "el los las y es por con para una del se lo"
).split()

#: (name, value over its base, least, most): a document is kept if each ratio lies within its limits; null limits are open.
#: A ratio whose base is 0 counts as 0.
THRESHOLDS = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    ("words_per_line", "n_words", "n_lines", 3.0, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("stop_words_per_word", "n_stop_words", "n_words", 0.002, None),
    ("words_with_letters", "n_alpha_words", "n_words", 0.6, None),
    ("words_like_the_last", "n_same_words", "n_words", None, 0.3),
)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words that lie in a window of `window` words found twice or more in the array.

    Windows are compared by a 64-bit hash of their words' hashes. If all are distinct, which a hash set tells, none
    repeats. Else they are sorted with their starts, so that equal ones are neighbours; the starts of those are sorted
    and each covers the words up to its window's end or the next start. Runs in n log n for n words.
    """
    def hashed(ws: Column) -> Column:
        return F.transform(ws, lambda w: F.xxhash64(w))

    def windows(hs: Column) -> Column:
        """Hashes of all windows, doubling their width."""
        out, width = hs, 1
        while width < window:
            n = F.size(hs) - 2 * width + 1
            out = F.zip_with(F.slice(out, F.lit(1), n), F.slice(out, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b))
            width *= 2
        return out

    def covered(gs: Column) -> Column:
        order = F.array_sort(F.transform(gs, lambda g, i: F.struct(g.alias("g"), i.alias("at"))))
        return _let(order, lambda ss: _let(F.array_sort(F.filter(F.transform(ss, lambda s, i: F.when(
            ((i > 0) & (F.get(ss, i - 1)["g"] == s["g"])) | ((i < F.size(ss) - 1) & (F.get(ss, i + 1)["g"] == s["g"])), s["at"]
        )), lambda x: x.isNotNull())), spread))

    def spread(starts: Column) -> Column:
        following = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.lit(2_000_000_000)))
        return F.aggregate(F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(window))), F.lit(0), lambda s, x: s + x)

    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    found = _let(hashed(words), lambda hs: _let(windows(hs), lambda gs: F.when(F.size(F.array_distinct(gs)) == F.size(gs), F.lit(0)).otherwise(covered(gs))))
    return F.when(F.size(words) >= window, found).otherwise(F.lit(0)).cast("long")


def _same_as_last(words: Column) -> Column:
    """Words equal to the one before."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    return F.size(F.filter(pairs, lambda x: x)).cast("long")


def quality_rules(docs: DataFrame, *, text_col: str = "text", thresholds=THRESHOLDS, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """The documents' columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
    n_alpha_words, n_same_words (long), base_failed, failed_rules (names, comma-joined), kept.

    base_failed: fewer than least_words words, or more than most_repeated percent of them in repeated windows. kept:
    not base_failed and every threshold holds. Whole texts are measured in one projection; nothing is shuffled.
    A null text counts as an empty one, which base_failed rejects. Repeated rows are kept. Columns of the input with the
    name of a result column, in any case of letters, are replaced. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    measured = F.transform(F.array(text), lambda t: _let(_words(t), lambda ws: _let(lines(t), lambda ls: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeated_words(ws).alias("n_repeat_words"),
        F.size(ls).cast("long").alias("n_lines"),
        F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        _same_as_last(ws).alias("n_same_words"),
    ))))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_alpha_words", "n_same_words"]
    added = [*names, "base_failed", "failed_rules", "kept"]
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]

    def ratio(over: str, under: str) -> Column:
        return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))

    def broken(name: str, over: str, under: str, least, most) -> Column:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (ratio(over, under) < least)
        if most is not None:
            bad = bad | (ratio(over, under) > most)
        return F.when(bad, F.lit(name))

    failed = F.concat_ws(",", *[broken(*t) for t in thresholds])
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    # as a generator's output the counts are worked out once, also under a filter on the verdict
    counted = docs.select(*own, F.inline(measured))
    return counted.select(*own, *names, base.alias("base_failed"), failed.alias("failed_rules"), (~base & (failed == "")).alias("kept"))
