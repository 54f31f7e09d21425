"""Quality rules by distribution divergence.

A document's character-class histogram and common-word histogram are compared with references of its
language by the Jensen-Shannon distance (base 2, so 0 to 1). The references are fitted on the whole corpus:
one aggregation, a row per language, over the documents that pass the base rules.

Defined results: a null or empty text has no words and fails the base rules; a null or unknown language, or one
whose reference rests on too few words, is compared with the reference of all languages; guards on length switch
each comparison off where the histogram would be noise. Repeated rows are judged alike. Only documents' doc_id,
text and lang are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, small, words

#: Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "for", "on", "with", "was", "it"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "im"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "est", "que", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "con"],
}
CLASSES = ("small letters and the rest", "capitals", "digits", "space", "stops", "symbols")
#: Jensen-Shannon distances from which a document is rejected, and the least counts for a comparison to hold.
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.3
MIN_CHARS = 200
MIN_WORDS = 50
MIN_REFERENCE_WORDS = 2000


def _length_without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of the base rules and of both histograms, one narrow pass over the texts.

    Windows of three words are compared by 64-bit hashes. Texts whose hashes are all different, most of them, stop there;
    the others sort (hash, position) so that equal windows are neighbours.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    t = docs.select("doc_id", "lang", text.alias("t")).select("doc_id", "lang", "t", words(F.col("t")).alias("w"))
    n = F.size("w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    vocabulary = F.coalesce(F.element_at(lists, F.col("lang")), F.array(*map(F.lit, COMMON_WORDS["en"])))
    every = sorted({x for v in COMMON_WORDS.values() for x in v})
    bare = F.split(F.lower("t"), f"[{SPACE}.,;:!?()\"']+")
    t = t.select(
        "doc_id", "lang", n.cast("long").alias("n_words"), grams.alias("g"), lines.alias("lines"), vocabulary.alias("v"),
        F.char_length("t").alias("n_all"),
        _length_without(F.col("t"), f"[{SPACE}]+").alias("word_chars"),
        (F.char_length("t") - _length_without(F.col("t"), "[#*$%&|<>]+")).alias("n_symbols"),
        (F.char_length("t") - _length_without(F.col("t"), r"\p{Lu}+")).alias("n_upper"),
        (F.char_length("t") - _length_without(F.col("t"), "[0-9]+")).alias("n_digit"),
        (F.char_length("t") - _length_without(F.col("t"), "[.,;:!?'\"()-]+")).alias("n_stop"),
        F.filter(bare, lambda x: x.isin(every)).alias("c"),
    )
    t = t.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    repeated = F.array_sort(F.transform(F.filter("s", lambda x, k: ((k > 0) & (F.get("s", k - 1)["h"] == x["h"])) | (F.get("s", k + 1)["h"] == x["h"])), lambda x: x["i"]))
    t = t.withColumn("r", repeated)
    # a window covers three words; where windows overlap, count up to the next window's start only
    covered = F.aggregate("r", F.struct(F.lit(0).alias("sum"), F.lit(-9).alias("last")), lambda a, i: F.struct((a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum"), i.alias("last")), lambda a: a["sum"])
    counts = F.transform("v", lambda x: F.size(F.filter("c", lambda y: y == x)).cast("long"))
    n_space = F.col("n_all") - F.col("word_chars")
    letters = F.col("word_chars") - F.col("n_upper") - F.col("n_digit") - F.col("n_stop") - F.col("n_symbols")
    t = t.select(
        "doc_id", "lang", "n_words", F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.array(*[x.cast("long") for x in (letters, F.col("n_upper"), F.col("n_digit"), n_space, F.col("n_stop"), F.col("n_symbols"))]).alias("chars"), counts.alias("counts"),
    )
    # what is no common word of the language is one more place of the histogram
    common = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    t = t.withColumn("commons", F.concat("counts", F.array(F.greatest(F.lit(0).cast("long"), F.col("n_words") - common)))).drop("counts")
    return t.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(measures: DataFrame) -> DataFrame:
    """Summed histograms by language over all documents that pass the base rules; language null stands for all."""
    n_classes, n_common = len(CLASSES), len(COMMON_WORDS["en"]) + 1
    sums = [F.sum(F.element_at("chars", i + 1)).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.element_at("commons", i + 1)).alias(f"w{i}") for i in range(n_common)]
    by = measures.where(~F.col("base_failed")).groupBy("lang").agg(F.sum("n_words").alias("words"), *sums)
    return by.select(
        "lang", "words",
        F.array(*[f"c{i}" for i in range(n_classes)]).alias("ref_chars"),
        F.array(*[f"w{i}" for i in range(n_common)]).alias("ref_words"),
    )


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    # the total once, not again for every member
    return F.get(F.transform(F.array(F.greatest(total, F.lit(1).cast("long"))), lambda n: F.transform(counts, lambda x: x / n)), F.lit(0))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two count arrays of equal length."""

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(_share(p), _share(q), lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def quality_rules(docs: DataFrame, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per document: base counts, both distances and the verdict.

    The texts are read once; what later steps need is a narrow table in the shared folder. The table of
    references has a row per language and is broadcast only while its counted rows stay small.
    """
    m = materialize(base_measures(docs), "quality-measures")
    ref = materialize(references(m), "quality-references")
    n_classes, n_common = len(CLASSES), len(COMMON_WORDS["en"]) + 1

    def total(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.element_at(name, i + 1)) for i in range(n)])

    overall = ref.agg(total("ref_chars", n_classes).alias("chars"), total("ref_words", n_common).alias("words")).first()

    def literal(counts: list) -> Column:
        return F.array(*[F.lit(int(x or 0)).cast("long") for x in counts])

    # a language with too few words has no reference of its own
    own = small(ref.where((F.col("words") >= MIN_REFERENCE_WORDS) & F.col("lang").isNotNull()), 10_000)
    j = m.join(own, "lang", "left")
    j = j.withColumn("char_distance", js_distance(F.col("chars"), F.coalesce("ref_chars", literal(overall["chars"]))))
    j = j.withColumn("word_distance", js_distance(F.col("commons"), F.coalesce("ref_words", literal(overall["words"]))))
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    odd = ((n_chars >= MIN_CHARS) & (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance)) | ((F.col("n_words") >= MIN_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "char_distance", "word_distance")
