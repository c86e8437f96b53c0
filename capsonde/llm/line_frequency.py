"""Quality rules from one text alone, and from how many documents of a host share its lines.

One scan measures every text and hashes its normalised lines; the measures and hashes are written
once, without texts, and all that follows reads that table. Texts that a host holds several times
count once. A line in more than MIN_DOCS texts of its host, and in more than MAX_PERCENT of them,
is the host's and no document's own: it is removed, and a document that loses more than
DEPLETED_PERCENT of its words that way is rejected. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsonde.llm.storage import stored
from capsonde.session import broadcast_if_small

MIN_DOCS = 10
MAX_PERCENT = 1
DEPLETED_PERCENT = 50
MIN_WORDS = 50
REPEAT_PERCENT = 50
SALTS = 16

# What stands between words, and what counts as a symbol.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

UNEVEN_BLANKS = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
TEXT_KEY = ["host", "k1", "k2"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def normal(text: Column) -> Column:
    """Lower case, numbers as 0, blanks within a line as one; line breaks stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), UNEVEN_BLANKS, " ")


def normal_lines(text: Column) -> Column:
    """Normalised lines with a word, without blanks around them."""
    return F.filter(F.transform(F.split(normal(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _repeat_positions(grams: Column) -> Column:
    """Places whose value stands at another place of the array too, in ascending order."""
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.transform(F.array(placed), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"])))[0]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures of each whole text; a null text counts as the empty one.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and `lines`: hash and
    words of each normalised line. Windows of three words are told apart by 64-bit hashes
    within a text. Of the input only columns whose names differ from these are kept.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines", "_t", "_w", "_g", "_at"}
    kept = [c for c in docs.columns if c not in made]
    text = F.col("_t")
    step = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    step = step.select(*kept, "_t", words_of(text).alias("_w"))
    grams = F.transform(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    raw_lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.select(
        *kept, "_t", grams.alias("_g"), F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform(F.array(raw_lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.transform(normal_lines(text), lambda x: F.struct(
            F.xxhash64(x).alias("hash"),
            (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "))) + 1).alias("words"))).alias("lines"),
    )
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    step = step.withColumn("_at", F.when(repeats, _repeat_positions(F.col("_g"))).otherwise(F.array().cast("array<int>")))
    covered = F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3))).cast("long"))
    step = step.select(
        *[c for c in step.columns if c not in ("_t", "_g", "_at")],
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def frequent_lines(rows: DataFrame) -> DataFrame:
    """(host, hash, n_docs) of the lines above the limits; rows hold TEXT_KEY and `lines`."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = (
        rows.select("host", F.explode(F.array_distinct("lines.hash")).alias("hash"))
        .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") > MIN_DOCS)
    )
    same = F.col("host").eqNullSafe(F.col("_of"))
    small = broadcast_if_small(stored(hosts.withColumnRenamed("host", "_of"), "line-hosts"), 256)
    return counts.join(small, same).where(100 * F.col("n_docs") > MAX_PERCENT * F.col("host_docs")).select("host", "hash", "n_docs")


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, measures, n_removed_words, kept, and the hashes of its frequent lines.

    A null id or host is a value like any other, and every row is judged, repeated rows each for
    itself and alike. An empty or null text has no lines and fails the base rules. `kept` is false
    for base_failed, and where more than half of the words are in lines above the limits.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), F.col(text_col), F.char_length(text_col)).alias("k2"),
    )
    rows = stored(measured(keyed).drop("text"), "line-measures")
    one_each = rows.groupBy(*TEXT_KEY).agg(F.first("lines").alias("lines"))
    texts = stored(one_each, "line-texts")
    frequent = stored(frequent_lines(texts), "frequent-lines")
    lines = texts.select(*TEXT_KEY, F.inline("lines")).withColumn("salt", F.pmod("k1", F.lit(SALTS)))
    spread = frequent.select(
        F.col("host").alias("_host"), F.col("hash").alias("_hash"), F.explode(F.array([F.lit(i).cast("long") for i in range(SALTS)])).alias("_salt"))
    spread = broadcast_if_small(spread, 64)
    same = (F.col("hash") == F.col("_hash")) & (F.col("salt") == F.col("_salt")) & F.col("host").eqNullSafe(F.col("_host"))
    removed = (
        lines.join(spread, same)
        .groupBy(*TEXT_KEY).agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_set("hash")).alias("frequent"))
    )
    # A text's copies share a key, so its row is laid out once per salt.
    removed = stored(removed, "removed-lines").select(
        F.col("host").alias("_host"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "n_removed_words", "frequent",
        F.explode(F.array([F.lit(i).cast("long") for i in range(SALTS)])).alias("_salt"))
    salted = rows.drop("lines").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    same = (
        (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("salt") == F.col("_salt"))
        & F.col("host").eqNullSafe(F.col("_host")))
    lost = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    depleted = 100 * lost > DEPLETED_PERCENT * F.col("n_words")
    return salted.join(removed, same, "left").select(
        "doc_id", "host", "k1", "k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        lost.alias("n_removed_words"), F.coalesce("frequent", F.array().cast("array<bigint>")).alias("frequent"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def without_lines(text: Column, frequent: Column) -> Column:
    """The text without its lines whose normalised hash is in `frequent`, the others unchanged."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x: ~F.array_contains(frequent, F.xxhash64(F.trim(normal(x))))), "\n")


def clean(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns, frequent lines taken out of their texts.

    Texts without such lines stay as they are, and rows are never merged.
    """
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"))
    verdicts = judge(docs, host_col, text_col, id_col=host_col).where("kept").groupBy(*TEXT_KEY).agg(F.first("frequent").alias("frequent"))
    text, host = F.col("own")[text_col], F.col("own")[host_col]
    keyed = inner.withColumns({"h": host, "a": F.xxhash64(text), "b": F.xxhash64(F.lit(1), text, F.char_length(text))})
    same = (F.col("a") == F.col("k1")) & (F.col("b") == F.col("k2")) & F.col("h").eqNullSafe(F.col("host"))
    joined = keyed.join(verdicts, same)
    cut = F.when(F.size("frequent") > 0, without_lines(text, F.col("frequent"))).otherwise(text)
    return joined.select(*[(cut if c == text_col else F.col("own")[c]).alias(c) for c in names])
