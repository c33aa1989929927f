"""Quality rules from distribution divergence, in Spark expressions only.

Base rules count words, symbols, repeated lines and words in repeated windows. The verdict then compares a text's
histogram of character classes and of common words to references of every language, learned over all documents of
that language, by Jensen-Shannon distance; texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import let, words_of, written

#: The commonest words of the languages that the word histogram has bins for.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "on", "with",
    "de", "la", "le", "et", "les", "des", "un", "une", "en", "que",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "ein",
    "el", "y", "los", "las", "del", "se",
]

#: Character classes: a histogram bin for each, and one for all other characters. Distances count digits with small
#: letters, as clean texts hold few or many of them; their share has a limit of its own.
CLASSES = ["small letters", "capitals", "white space", "stops", "quotes, brackets and dashes", "digits", "letters without case and marks", "other"]

MIN_WORDS = 50  # base rule: fewer words fail
REPEAT_SHARE = 50  # base rule: more than this percentage of words in repeated windows fails
CLASS_DISTANCE = 0.13  # verdict: largest distance of character classes from the nearest reference
WORD_DISTANCE = 0.45  # verdict: largest distance of common words from a reference
DIGIT_SHARE = 25  # verdict: largest percentage of digits among characters
WORD_MARGIN = 0.98  # and largest share of the distance that a text without any common word has from the reference
COMMON_SHARE = 0.1  # references with fewer common words tell nothing by their absence
GUARD_WORDS = 50  # texts with fewer words are not judged by divergence
GUARD_CHARS = 200  # nor those with fewer characters

_SEP = "\x1f"
_ALL = 2**30


def class_counts(text: Column) -> Column:
    """Array of the counts of CLASSES. Later classes are counted in what earlier removals left."""
    size = lambda c: F.length(c).cast("bigint")

    def bins(rest: Column) -> Column:
        left = [rest, F.regexp_replace(rest, r"\p{Lu}+", "")]
        left.append(F.regexp_replace(left[-1], r"[\x09-\x0D\x20]+", ""))
        return let(left[2], lambda r: F.concat(F.array(size(text) - size(left[0]), size(left[0]) - size(left[1]), size(left[1]) - size(r)), _marks(r)))

    def _marks(r: Column) -> Column:
        return let(F.regexp_replace(r, r"[.,\u060C\u06D4\u0964\u0965\u3001\u3002\uFF0C\uFF0E]+", ""), lambda q: let(F.regexp_replace(q, r"[;:!?'\x22()\u061B\u061F\u05BE\u05F3\u05F4\u3008-\u300F\u30FB\uFF01\uFF08\uFF09\uFF1A\uFF1B\uFF1F-]+", ""), lambda o: let(F.regexp_replace(o, r"\p{Nd}+", ""), lambda d: let(F.regexp_replace(d, r"[\p{L}\p{M}\u200C\u200D&&[^\p{Lu}\p{Ll}]]+", ""), lambda e: F.array(size(r) - size(q), size(q) - size(o), size(o) - size(d), size(d) - size(e), size(e))))))

    return let(F.regexp_replace(text, r"\p{Ll}+", ""), bins)


def word_counts(words: Column) -> Column:
    """Array of the counts of COMMON_WORDS among words, and of all other words."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def counts(found: Column, n: Column) -> Column:
        marked = F.concat(F.lit(_SEP), F.array_join(found, _SEP + _SEP), F.lit(_SEP))
        of = lambda s, w: ((F.length(s) - F.length(F.replace(s, F.lit(_SEP + w + _SEP), F.lit("")))) / (len(w) + 2)).cast("bigint")
        return let(let(marked, lambda s: F.array(*[of(s, w) for w in COMMON_WORDS])), lambda a: F.concat(a, F.array(n - total(a))))

    return let(words, lambda ws: let(F.filter(ws, lambda w: w.isin(COMMON_WORDS)), lambda c: counts(c, F.size(ws).cast("bigint"))))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""
    spread = lambda at: F.size(F.array_distinct(F.concat(at, F.transform(at, lambda x: x + 1), F.transform(at, lambda x: x + 2))))

    def by_value(hashes: Column, twice: Column) -> Column:
        """For few repeated windows: look every window up among them."""
        return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())

    def by_order(hashes: Column) -> Column:
        """For many: sort windows with their places, and compare neighbours."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
        return let(pairs, twins)

    def covered(hashes: Column) -> Column:
        equal = lambda s: F.array_distinct(F.filter(F.transform(s, lambda h, k: F.when(F.get(s, k + 1) == h, h)), lambda h: h.isNotNull()))
        places = let(let(F.sort_array(hashes), equal), lambda twice: F.when(F.size(twice) <= 32, by_value(hashes, twice)).otherwise(by_order(hashes)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places, spread))

    def windows(w: Column) -> Column:
        two = F.zip_with(w, F.slice(w, 2, _ALL), lambda a, b: F.xxhash64(a, b))
        three = F.zip_with(two, F.slice(w, 3, _ALL), lambda ab, c: F.xxhash64(ab, c))
        return F.slice(three, 1, F.size(w) - 2)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), covered)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


#: Histograms of character classes and of common words, and their language.
Reference = tuple[list[float], list[float], str | None]


def _folded(classes: Column) -> Column:
    """Counts of classes with digits among small letters."""
    digits = CLASSES.index("digits")
    return F.array(classes[0] + classes[digits], *[classes[i] for i in range(1, len(CLASSES)) if i != digits])


def _few_digits(classes: Column) -> Column:
    total = F.aggregate(classes, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return classes[CLASSES.index("digits")] * 100 <= DIGIT_SHARE * total


def references(counts: DataFrame) -> list[Reference]:
    """Histograms (character classes, common words) and name of each language, over all its documents that are mostly plain.

    counts: columns lang, classes, common. A document takes part unless over 1 % of its characters are outside the
    named classes or over 20 % are capitals, so that junk does not shape what it is held against. Documents without a
    language count as one more. One row for each language comes to the driver.
    """
    total = F.aggregate("classes", F.lit(0).cast("bigint"), lambda x, y: x + y)
    plain = counts.where((F.col("classes")[len(CLASSES) - 1] * 100 <= total) & (F.col("classes")[1] * 5 <= total)).withColumn("classes", _folded(F.col("classes")))
    n, m = len(CLASSES) - 1, len(COMMON_WORDS) + 1
    sums = plain.groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(n)], *[F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(m)])
    found = []
    for row in sorted(sums.collect(), key=lambda r: str(r["lang"])):
        c, w = [row[f"c{i}"] or 0 for i in range(n)], [row[f"w{i}"] or 0 for i in range(m)]
        if sum(c) and sum(w):
            found.append(([x / sum(c) for x in c], [x / sum(w) for x in w], row["lang"]))
    return found


def distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of an array of counts from a reference; null for no counts."""
    ref = F.array(*[F.lit(float(q)) for q in reference])

    def term(c: Column, q: Column) -> Column:
        return let(c / total, lambda p: F.when(p > 0, p * F.log(2 * p / (p + q))).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log(2 * q / (p + q))).otherwise(F.lit(0.0)))

    divergence = F.aggregate(F.zip_with(counts, ref, term), F.lit(0.0), lambda a, x: a + x) / F.lit(2 * math.log(2))
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def word_limit(common: list[float]) -> float:
    """Largest distance of common words from a reference: below that of a text without any, where the reference has some."""
    rest = common[-1]
    if 1 - rest < COMMON_SHARE:
        return WORD_DISTANCE
    bare = math.sqrt(((1 - rest) + math.log2(2 / (1 + rest)) + (rest * math.log2(2 * rest / (1 + rest)) if rest else 0)) / 2)
    return min(WORD_DISTANCE, WORD_MARGIN * bare)


def _distances(counts: Column, refs: list[list[float]]) -> Column:
    """Distance from each reference."""

    def over(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y).cast("double")
        return let(total, lambda t: F.array(*[distance(a, t, r) for r in refs]))

    return let(counts, over) if refs else F.array().cast("array<double>")


def _near(classes: Column, words: Column, lang: Column, refs: list[Reference]) -> Column:
    """Whether both distances from one reference are within limits; true without references.

    References with few common words can't tell junk by its words: they serve their own language only, unless all are so.
    """
    if not refs:
        return F.lit(True)
    telling = [1 - r[1][-1] >= COMMON_SHARE for r in refs]
    found = F.lit(False)
    for i, (_, common, name) in enumerate(refs):
        near = (F.coalesce(classes[i], F.lit(0.0)) <= CLASS_DISTANCE) & (F.coalesce(words[i], F.lit(0.0)) <= word_limit(common))
        found = found | (near if telling[i] or not any(telling) else near & lang.eqNullSafe(F.lit(name)))
    return found


def histograms(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Language and histograms of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(lang_col).alias("lang"), class_counts(text).alias("classes"), word_counts(words_of(text)).alias("common"))


def counts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, language and histograms of every document, from one pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).cast("bigint").alias("n_repeat_words"), word_counts(w).alias("common"))

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    read = base.select(
        "doc_id", "lang", F.length("text").cast("bigint").alias("n"), let(words_of(F.col("text")), of).alias("w"), class_counts(F.col("text")).alias("classes"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"), duplicate_lines(F.col("text")).cast("bigint").alias("n_dup_lines"),
    )
    return read.select("doc_id", "lang", "n", "w.n_words", (F.col("n") - F.col("classes")[2]).alias("word_chars"), "n_symbols", "n_dup_lines", "w.n_repeat_words", "classes", "w.common")


def verdicts(counts: DataFrame, refs: list[Reference]) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    far = counts.select("*", failed.alias("base_failed"), _distances(_folded(F.col("classes")), [r[0] for r in refs]).alias("by_class"), _distances(F.col("common"), [r[1] for r in refs]).alias("by_word"))
    judged = (F.col("n_words") >= GUARD_WORDS) & (F.col("n") >= GUARD_CHARS)
    near = _near(F.col("by_class"), F.col("by_word"), F.col("lang"), refs) & _few_digits(F.col("classes"))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (~judged | near)).alias("kept"), F.array_min("by_class").alias("class_distance"), F.array_min("by_word").alias("word_distance"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row of counts and verdict for every document.

    Null texts are empty: no words, so they fail the base rule. Repeated rows each have their row, null ids stay null,
    and other columns are ignored. References come from the same documents; a table without any letters has no
    reference, and its texts are judged by the base rules alone. A null language is a language of its own.
    """
    counts = written(counts_of(docs, id_col, text_col, lang_col), "counts")
    return verdicts(counts, references(counts))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with their columns as they are. Texts are read twice rather than shuffled."""
    refs = references(histograms(docs, text_col, lang_col))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def good(w: Column) -> Column:
        by_word = _distances(word_counts(w), [r[1] for r in refs])
        near = let(class_counts(text), lambda c: _few_digits(c) & let(_distances(_folded(c), [r[0] for r in refs]), lambda a: let(by_word, lambda b: _near(a, b, F.col(lang_col), refs))))
        judged = (F.size(w) >= GUARD_WORDS) & (F.length(text) >= GUARD_CHARS)
        return (F.size(w) >= MIN_WORDS) & (100 * repeated_words(w) <= REPEAT_SHARE * F.size(w)) & (~judged | near)

    return docs.where(let(words_of(text), good))
