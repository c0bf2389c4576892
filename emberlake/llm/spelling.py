"""Spelling variants: words one edit apart, found in sorted rotations of terminator-marked words (permuterm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import ascii_lower
from emberlake.session import materialize

#: Marks the end of a word inside its rotations; sorts before every letter.
END = "\x00"
#: Rotations of more letters are known by their digest, so a long word's rotations stay short rows.
SPELLED = 64
#: Letters of a run; a shorter run than ``least`` can't be a word, so the pattern passes over it.
LETTERS = "[A-Za-zÀ-ÿ]"


def _lower(run: Column) -> Column:
    """A-Z lower-cased; plain ASCII runs by the faster general function."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(ascii_lower(run))


def word_counts(docs: DataFrame, least: int = 7, occurrences: int = 2, misspelt: int | None = None) -> DataFrame:
    """``word, n``: runs of at least ``least`` letters in the whole texts of ``docs`` (``doc_id``, ``text``), A-Z lower-cased.

    With ``misspelt``, runs whose crc32 of ``doc_id:run`` it divides lose one letter first (a
    reproducible source of typing errors). Counts are combined before they are shuffled, so a
    word that is a third of all words costs no more than others. Null texts have no words; a
    null id is empty in the hashed text.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS + f"{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", _lower(F.col("run")).alias("word"))
    if misspelt:
        crc = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at, size = F.pmod(F.col("_crc"), F.length("word")).cast("int"), F.length("word")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, size))
        runs = runs.select("word", crc.alias("_crc")).select(F.when(F.col("_crc") % misspelt == 0, shorter).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.length("word") >= least)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def rotations(words: DataFrame) -> DataFrame:
    """The rotations of every word (``word``, ``n``) as ``key, skipped, fresh, n, name``.

    A word ``x c y`` gives, for every letter ``c``, the rotation ``y END x`` that skips it: words
    that differ in that one letter share it. Its whole rotations (``skipped`` empty) are what
    is left of a word that is longer by one letter. ``fresh`` is false for a letter like the
    one before it: taking out either leaves the same word. ``name`` is null where the word
    can be read off ``key`` and ``skipped``.
    """
    size, j = F.length("word"), F.col("j")
    skips = j > size
    at = F.when(skips, j - size - 1).otherwise(j)
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), 2 * size)).alias("j")).select("word", "n", skips.alias("skips"), at.alias("at"))
    at, skips = F.col("at"), F.col("skips")
    skipped = F.when(skips, F.substring("word", at + 1, F.lit(1))).otherwise(F.lit(""))
    fresh = ~skips | (at == 0) | (F.substring("word", at, F.lit(1)) != skipped)
    key = F.concat(F.substring("word", at + F.when(skips, 2).otherwise(1), size), F.lit(END), F.substring("word", F.lit(1), at))
    # a key has as many characters as the shorter word of a pair and the mark
    long_key = F.when(skips, size).otherwise(size + 1) > SPELLED
    return placed.select(
        F.when(long_key, F.sha2(key, 256)).otherwise(key).alias("key"), skipped.alias("skipped"), fresh.alias("fresh"), "n",
        F.when(long_key, name_of(F.col("word"))).alias("name"),
    )


def name_of(word: Column) -> Column:
    """The word, or a short name for it if it is long."""
    return F.when(F.length(word) >= SPELLED, F.concat(F.lit(END), F.sha2(word, 256))).otherwise(word)


def neighbours(words: DataFrame) -> DataFrame:
    """One row for each word and range of rotations that it shares with others: ``name, near, other_n, other``.

    ``near`` counts the words one edit away (over all ranges every such word is counted once) and
    ``other`` is the most frequent of the range, then the least. A range holds one word per
    letter of the alphabet, and one more; no pairs are listed.
    """
    shared = rotations(words).repartition("key")
    spelled = F.concat(F.substring_index("key", END, -1), F.col("skipped"), F.substring_index("key", END, 1))
    shared = shared.withColumn("name", F.coalesce("name", name_of(spelled)))
    group, ranked = Window.partitionBy("key"), Window.partitionBy("key").orderBy(F.desc("n"), "name")
    one, plain = F.struct("n", "name"), F.col("skipped") == ""
    scanned = shared.select(
        "name", "fresh", plain.alias("plain"), F.row_number().over(ranked).alias("at"), F.first(one).over(ranked).alias("top"), F.lead(one).over(ranked).alias("next"),
        F.count(F.lit(1)).over(group).alias("all"), F.count_if(plain).over(group).alias("plains"), F.count_if(~plain & F.col("fresh")).over(group).alias("longer"),
    ).where("all > 1")
    near = F.when(F.col("plain"), F.col("longer")).otherwise(F.col("all") - F.col("plains") - 1 + F.when(F.col("fresh"), F.col("plains")).otherwise(0))
    other = F.when(F.col("at") == 1, F.col("next")).otherwise(F.col("top"))
    return scanned.select("name", near.alias("near"), other["n"].alias("other_n"), other["name"].alias("other"))


def _with_long_names(found: DataFrame, words: DataFrame) -> DataFrame:
    """``other`` in full: long words were carried by a short name."""
    named = words.where(F.length("word") >= SPELLED).select(F.col("word").alias("_full"), name_of(F.col("word")).alias("other"))
    short = ~F.startswith(F.col("other"), F.lit(END))
    return found.where(short).unionByName(found.where(~short).join(named, "other").select("name", "near", "other_n", F.col("_full").alias("other")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows of ``word, form``: forms are followed to the last, in steps that double.

    A form is more frequent than its word by a factor, so the chains are short and have no rings.
    """
    at = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.where("moved").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = at.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        at = materialize(at, "spelling-roots")
    return at.select("word", "root")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (distinct ``word``, ``n``).

    ``form`` is the word's most frequent neighbour (one letter more, less or other; ties: the
    least in code-point order) if it is at least ``times`` as frequent, else null; ``root`` is
    where the forms lead to. Words of any letters are taken, the empty one too; null words and ones with U+0000 have no
    neighbours. Nobody's length is limited: the rotations of a word of L letters are L rows,
    but from their digests on; making them takes time with the square of L. An empty table
    gives no rows. Other columns are not looked at.
    """
    words = materialize(words.select("word", "n"), "spelling-words")
    usable = words.where(F.col("word").isNotNull() & ~F.contains(F.col("word"), F.lit(END)))
    found = _with_long_names(neighbours(usable), usable)
    best = found.groupBy("name").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("_best"))
    joined = words.withColumn("name", name_of(F.col("word"))).join(best, "name", "left")
    form_n = -F.col("_best")["n"]
    has = form_n >= times * F.col("n")
    judged = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("_best")["word"]).alias("form"), F.when(has, form_n).alias("form_n"))
    judged = materialize(judged, "spelling-forms")
    led = judged.join(roots(judged.where("form is not null")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
