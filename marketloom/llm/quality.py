"""Quality rules [10]: counts of a text, and its distance from its language's usual distributions.

Two histograms of a document are compared with those of its language by Jensen-Shannon distance: classes of
characters, and common words. The language references are sums over all documents of that language, so they
follow the corpus. Texts too short for a histogram to mean anything aren't judged by it.

Everything is DataFrame functions; a text is read once, and its repeated windows are found inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import common

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of the languages with a reference of their own.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "this", "or", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "avec"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
#: Languages beyond these share one reference, so references are len(COMMON_WORDS) + 1 rows.
OTHER = "other"

CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{N}", "stop": r"[.,;:?'\"-]", "mark": r"[!#*$%&|<>=+@^~_/\\{}\[\]()]"}

#: Words from which on the histograms are judged.
JUDGED_WORDS = 40
#: The largest distances that pass. A short text's common words stray further: COMMON_SPREAD / sqrt(words) is added.
CHAR_LIMIT = 0.28
COMMON_LIMIT, COMMON_SPREAD = 0.20, 1.0
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, the language group, the counts and the two histograms. Texts themselves aren't returned."""
    text, lang = _judged_columns(docs, text_col, lang_col)
    df = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), lang.alias("lang"))
    df = df.withColumn("words", F.filter(F.split("text", SPACE + "+"), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(5)])
    df = df.withColumn("windows", F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), window)).otherwise(F.array().cast("array<bigint>")))
    forms = sorted({f for v in COMMON_WORDS.values() for w in v for f in (w, w[:1].upper() + w[1:], w.upper())})
    df = df.withColumn("hits", F.transform(F.filter("words", lambda w: w.isin(*forms)), lambda w: F.lower(w)))
    return df.select(
        "id",
        "lang",
        F.xxhash64("text", "lang").alias("h"),
        F.size("words").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_chars"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("windows").alias("n_repeat_words"),
        F.array(*[F.regexp_count("text", F.lit(p)).cast("double") for p in CLASSES.values()]).alias("classes"),
        F.transform(common_list(), lambda c: F.size(F.filter("hits", lambda w: w == c)).cast("double")).alias("common"),
    )


def _judged_columns(docs: DataFrame, text_col: str, lang_col: str) -> tuple[Column, Column]:
    """What a row is judged by: its text, null as empty, and its language group."""
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit(OTHER)) if lang_col in docs.columns else F.lit(OTHER)
    return F.coalesce(docs[text_col].cast("string"), F.lit("")), F.when(lang.isin(*COMMON_WORDS), lang).otherwise(OTHER)


def common_list() -> Column:
    """The common words of the row's language."""
    out = F.array(*map(F.lit, COMMON_WORDS["en"]))
    for lang, words in COMMON_WORDS.items():
        out = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(out)
    return out


def repeated_words(windows: str) -> Column:
    """Words covered by 5-word windows that occur twice or more; each such window adds what the one before it leaves."""

    def covered(s: Column) -> Column:
        near = lambda k: F.get(s, k)["h"]
        twice = F.transform(s, lambda x, k: F.when((x["h"] == near(k - 1)) | (x["h"] == near(k + 1)), x["i"]))
        at = F.array_sort(F.filter(twice, lambda i: i.isNotNull()))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).cast("long").alias("n")), lambda acc: acc["n"])

    dated = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    once = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(once, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(dated), covered), 1))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, to base 2, of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2))


def judged(stats: DataFrame) -> DataFrame:
    """Adds both distances, base_failed and kept to measured() rows, whose sums by language are the references."""
    n_common = len(COMMON_WORDS["en"])
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(n_common)]
    reference = stats.groupBy("lang").agg(*sums, F.sum("n_chars").alias("chars"), F.sum("n_words").alias("words"))
    share = lambda names, of: F.when(F.col(of) > 0, F.array(*[F.col(x) / F.col(of) for x in names], F.greatest(F.lit(0.0), 1 - sum(F.col(x) for x in names) / F.col(of))))
    reference = reference.select("lang", share([f"c{i}" for i in range(len(CLASSES))], "chars").alias("ref_classes"), share([f"w{i}" for i in range(n_common)], "words").alias("ref_common"))
    own = lambda name, of: F.when(F.col(of) > 0, F.concat(F.transform(name, lambda x: x / F.col(of)), F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(name, F.lit(0.0), lambda a, x: a + x) / F.col(of)))))
    df = stats.join(F.broadcast(reference), "lang")
    df = df.withColumn("char_distance", divergence(own("classes", "n_chars"), F.col("ref_classes"))).withColumn("word_distance", divergence(own("common", "n_words"), F.col("ref_common")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    usual = (F.col("n_words") < JUDGED_WORDS) | ((F.col("char_distance") <= CHAR_LIMIT) & (F.col("word_distance") <= COMMON_LIMIT + COMMON_SPREAD / F.sqrt("n_words")))
    return df.drop("ref_classes", "ref_common").withColumn("base_failed", failed).withColumn("kept", ~failed & usual)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the distances, base_failed and kept.

    Null, empty and blank texts have no words and fail. A null or unknown language is compared with all other such
    rows. Repeated rows get repeated results, null ids stay; further columns aren't read. An empty table gives
    an empty result.
    """
    return _quality(docs, id_col, text_col, lang_col).drop("h")


def _quality(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    stats, _ = common.written(measured(docs, id_col, text_col, lang_col), "measured")
    return judged(stats).drop("classes", "common", "n_chars")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns. Each row is judged by its own text and language, also where rows share an id."""
    bad = _quality(docs, id_col, text_col, lang_col).where("not kept").select(F.col("id").alias("__bad__"), F.col("h").alias("__hash__")).distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["__bad__"]) & (F.xxhash64(*_judged_columns(docs, text_col, lang_col)) == bad["__hash__"]), "left_anti")
