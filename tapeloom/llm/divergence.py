"""Quality rules: distribution divergence from language references. DataFrame functions only.

Each text's histogram of character classes and of its language's common words is compared with the language's own
(all documents of the language) by Jensen-Shannon distance; with that of all texts where a language has too little text
for a reference. Texts too short to fill a histogram are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import stored

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
#: Character classes of a histogram; lower-case ASCII letters come before them and all other characters after.
CLASSES = (r"[A-Z]", r"[0-9]", SPACE, r"[.,;:'\"()-]", r"[!?]", r"[#*$%&|<>=@_/\\^~+]")
#: Common words of a language's histogram; the last class holds all other words.
COMMON = 24
MARKS = "ABCDEFGHIJKLMNOPQRSTUVWX"
#: Most languages whose references (about 1 KB each) are sent to every executor; beyond it they are joined by shuffle.
BROADCAST_LANGUAGES = 10_000


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def _left(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def character_classes(df: DataFrame) -> DataFrame:
    """Adds ``_classes``: characters of each class of ``_text`` as doubles, and ``_rest``: all but its lower-case letters."""
    df = df.withColumn("_rest", F.regexp_replace("_text", "[a-z]+", ""))
    own = [_left(F.col("_rest"), f"[^{c[1:]}+") for c in CLASSES]
    df = df.withColumn("_own", F.array(F.length("_text") - F.length("_rest"), *own))
    known = F.aggregate("_own", F.lit(0), lambda a, x: a + x)
    return df.withColumn("_classes", F.transform(F.concat("_own", F.array(F.length("_text") - known)), lambda x: x.cast("double"))).drop("_own")


def base_counts(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words from ``_text``, ``_words`` and character classes.

    Windows of 8 words are hashed and sorted once per text; a window that equals a neighbour in the order repeats.
    """
    lines = F.filter(F.split("_text", "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "")
    df = df.withColumn("_lines", lines).select(
        "*", F.size("_words").cast("long").alias("n_words"), (F.length("_text") - F.element_at("_classes", 2 + CLASSES.index(SPACE))).cast("long").alias("word_chars"),
        _left(F.col("_rest"), r"[^#*$%&|<>]+").cast("long").alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    ).drop("_lines")

    def joined(name: str, step: int) -> Column:
        """Hash of each element with the one ``step`` after it."""
        n = F.greatest(F.size(name) - step, F.lit(0))
        return F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # windows of 2, 4, then 8 words
        df = df.withColumn("_h", joined("_h", step))
    order = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_w", order).drop("_h")
    n = F.size("_w") - 1
    twice = F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))).drop("_w")
    first = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_at", first, lambda a, p: F.struct((p + 8).alias("end"), (a["n"] + p + 8 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two arrays of counts; null if either has no counts."""

    def shares_of(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        return F.when(total > 0, F.zip_with(x, F.array_repeat(total, F.size(x)), lambda v, n: v / n))

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    shares = F.zip_with(shares_of(p), shares_of(q), lambda a, b: (term(a, b) + term(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(shares, F.lit(0.0), lambda a, v: a + v)))


def references(df: DataFrame, least_words: int) -> DataFrame:
    """Per language of (_lang, _text, _words): characters by class, the common words and their counts.

    Counts cover all documents. The top words are cut per task before they are ranked, so a hot language spreads. A
    language of fewer than ``least_words`` words has the counts of all languages.
    """
    names = [f"c{k}" for k in range(len(CLASSES) + 2)]
    classes = character_classes(df.select("_lang", "_text", F.size("_words").alias("_n"))).drop("_rest")
    classes = classes.groupBy("_lang").agg(F.sum("_n").alias("all_words"), *[F.sum(F.element_at("_classes", k + 1)).alias(c) for k, c in enumerate(names)])
    classes = stored(classes, "divergence-classes")
    counts = df.select("_lang", F.explode("_words").alias("word")).groupBy("_lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("k", rank).where(F.col("k") <= COMMON).groupBy("_lang").agg(_listed())
    own = classes.join(top, classes["_lang"].eqNullSafe(top["_lang"]), "left").drop(top["_lang"])
    small = classes.where(F.col("all_words") < least_words)
    whole = own.where(F.col("all_words") >= least_words).select("_lang", *_reference(names))
    if small.isEmpty():
        return whole
    common = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON).agg(_listed())
    pooled = classes.agg(F.sum("all_words").alias("all_words"), *[F.sum(c).alias(c) for c in names])
    pooled = stored(pooled.select("*", common.scalar().alias("top")).select(*_reference(names)), "divergence-pooled")
    return whole.unionByName(small.select("_lang", *[pooled.select(c).scalar().alias(c) for c in pooled.columns]))


def _listed() -> Column:
    """Words (word, n) of a group from the most frequent on; ties by the word."""
    return F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "word", "n"))), lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n"))).alias("top")  # COMMON rows


def _reference(names: list[str]) -> list[Column]:
    """ref_longest, ref_classes, ref_words, ref_counts of rows (all_words, classes, top)."""
    used = F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    tail = F.concat(F.transform("top", lambda x: x["n"].cast("double")), F.array_repeat(F.lit(0.0), F.lit(COMMON) - F.size("top")), F.array((F.col("all_words") - used).cast("double")))
    longest = F.array_max(F.transform("top", lambda x: F.length(x["word"])))
    return [longest.alias("ref_longest"), F.array(*[F.col(c).cast("double") for c in names]).alias("ref_classes"), F.transform("top", lambda x: x["word"]).alias("ref_words"), tail.alias("ref_counts")]


def judge_quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", class_limit: float = 0.25, word_limit: float = 0.3,
    least_chars: int = 300, least_words: int = 100, least_reference: int = 10_000,
) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    ``class_distance`` is null for texts of fewer than ``least_chars`` characters, ``word_distance`` for those of fewer
    than ``least_words`` words; a null never rejects. Texts of languages of fewer than ``least_reference`` words are held
    against all texts together. Null texts are empty. A null language is one of its own. Repeated rows come back as
    often as given.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    held = stored(references(rows, least_reference).withColumnRenamed("_lang", "_l"), "divergence-references")
    few = held.count() <= BROADCAST_LANGUAGES
    rows = rows.join(F.broadcast(held) if few else held, rows["_lang"].eqNullSafe(held["_l"]), "left")
    rows = base_counts(character_classes(rows)).drop("_rest")
    short = F.filter("_words", lambda w: F.length(w) <= F.col("ref_longest"))
    marks = F.array_join(F.transform(short, lambda w: F.substring(F.lit(MARKS), F.nullif(F.array_position("ref_words", w), F.lit(0)).cast("int"), F.lit(1))), "")
    rows = rows.withColumn("_marks", marks)
    counts = [F.length("_marks") - F.length(F.replace("_marks", F.lit(m), F.lit(""))) for m in MARKS]
    rows = rows.withColumn("_counts", F.transform(F.array(*counts, F.col("n_words").cast("int") - F.length("_marks")), lambda x: x.cast("double")))
    rows = rows.withColumn("class_distance", F.when((F.length("_text") >= least_chars), distance(F.col("_classes"), F.col("ref_classes"))))
    rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= least_words, distance(F.col("_counts"), F.col("ref_counts"))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > class_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return rows.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~failed & ~far).alias("kept"),
    )
