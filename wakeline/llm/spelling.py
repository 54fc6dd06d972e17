"""Spelling variants: words one edit apart, found by their rarest positional bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import body, discard, small, written

#: The letters of a run, and those that are lower-cased.
LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One edit touches two bigrams of a word at most, so of three one is left whole.
RAREST = 3


def without(word: Column, at: Column) -> Column:
    """word without its code point at a place counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def lowered(run: Column) -> Column:
    """run with A-Z in lower case and all else unchanged; lower() is the faster way for runs of ASCII."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 1, every: int = 97) -> DataFrame:
    """word of each maximal run of shortest letters or more, A-Z lower-cased; where every divides the crc32 of "id:run" a letter is deleted."""
    found = F.regexp_extract_all(body(text_col), F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(found).alias("_run"))
    runs = runs.select("_id", lowered(F.col("_run")).alias("_run"))
    hashed = runs.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    return hashed.select(F.when(F.col("_h") % every == 0, without(F.col("_run"), at)).otherwise(F.col("_run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of words of enough code points and occurrences."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def rare_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, gram, pos): the RAREST first bigrams of each word by (words' bigrams that are the same, bigram, place).

    There are few different bigrams, so their counts go to all tasks (within small()'s bound). Two words one edit apart have
    bigrams that the edit leaves whole in both, in the same order; of each word's first three at most two are touched
    by it. Of the two words' last chosen bigrams let the earlier by (count, bigram) be of word a. One chosen bigram of a
    is whole, and its counterpart in b comes before b's last one, or is the same bigram as that; then no whole bigram
    of b comes before it but its own chosen ones, and it is chosen too.
    """
    grams = words.select("word", "n", F.posexplode(F.regexp_extract_all("word", F.lit("(?s)(?=(..))"), F.lit(1))).alias("pos", "gram"))
    counts = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("f")))
    ranked = grams.join(small(counts), "gram").withColumn("k", F.row_number().over(W.partitionBy("word").orderBy("f", "gram", "pos")))
    return ranked.filter(F.col("k") <= RAREST).select("word", "n", "gram", "pos")


def _keys(same: Column, rest: Column, length: Column, left: Column) -> Column:
    """Two hashes of what two words of one edit may share: an equal part, and the first or the second half of the shorter one's rest."""
    half = F.floor(left / 2).cast("int")
    return F.array(
        F.xxhash64(F.lit("first"), length, same, F.substring(rest, F.lit(1), half)),
        F.xxhash64(F.lit("second"), length, same, F.right(rest, left - half)),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb) once for each two words that differ by one inserted, deleted or replaced code point.

    A bigram that the edit leaves whole has the edit on one side of it only. So it is at the same place from the begin of both
    words, which are equal up to it, or from their end, and they are equal from it on: that is the limit on
    places. Of the rest, in which the edit is, one half is equal too: the first half of the shorter word's rest is how the other
    rest begins, or its second half is how that ends. The join's key is a hash of the equal part, that half and
    the shorter word's length, so its groups stay small when the vocabulary grows; the edit distance then decides.
    """
    length = F.length("word")
    sides = rare_bigrams(words).select(
        "word", "n", length.alias("len"),
        F.explode(F.array(
            F.struct(F.lit("begin").alias("side"), F.substring("word", F.lit(1), F.col("pos") + 2).alias("same"), F.substring("word", F.col("pos") + 3, length).alias("rest")),
            F.struct(F.lit("end").alias("side"), F.substring("word", F.col("pos") + 1, length).alias("same"), F.substring("word", F.lit(1), F.col("pos")).alias("rest")),
        )).alias("s"),
    ).select("word", "n", "len", "s.side", "s.same", "s.rest", F.length("s.rest").alias("left"))
    keys = lambda less: _keys(F.concat("side", F.lit(" "), "same"), F.col("rest"), F.col("len") - less, F.col("left") - less)
    rows = written(sides.select("word", "n", keys(0).alias("own"), F.when(F.col("left") > 0, keys(1)).alias("shorter")))
    left = rows.select(F.explode("own").alias("key"), F.col("word").alias("a"), F.col("n").alias("na"))
    right = rows.select(F.explode("own").alias("key"), F.lit(False).alias("longer"), F.col("word").alias("b"), F.col("n").alias("nb")).unionByName(
        rows.select(F.explode("shorter").alias("key"), F.lit(True).alias("longer"), F.col("word").alias("b"), F.col("n").alias("nb"))
    )
    met = left.join(right, "key").filter(F.col("longer") | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms(word, form) lead. Each round doubles the steps taken; forms must not go in circles."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, now = now, written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(before)
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words are the runs of letters of whole texts (see runs_of) of at least `shortest` code points (4 or more, so that each has three
    bigrams) that occur `least` times or more; shorter runs can't give any. Near words are one edit apart; a word's form is its near word of largest n (ties: smallest in code-point order) if
    that is ratio times its own n or more; its root is where forms lead. Counts grow along forms, so there are no circles.

    Texts are scanned once, and counted with a map-side combine; all else works on the vocabulary. A null text has no
    words, a null id counts as empty text, repeated rows count again, an empty table gives no rows, other
    columns don't matter. Words may be as long as a text.
    """
    words = written(vocabulary(runs_of(docs, id_col, text_col, shortest), shortest, least))
    pairs = written(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = written(words.join(best, "word", "left").withColumn("ok", -F.col("best.m") >= ratio * F.col("n")))
    ended = roots(found.filter("ok").select("word", F.col("best.near").alias("form")))
    return found.join(ended, "word", "left").select(
        "word",
        F.when(F.col("ok"), F.col("best.near")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("ok"), -F.col("best.m")).alias("form_n"),
    )
