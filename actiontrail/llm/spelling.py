"""Spelling variants: words that one inserted, deleted or replaced letter turns into each other.

Join by asymmetric q-chunks. The shorter word of a pair (of equal ones the smaller) gives two disjoint chunks, its halves; the other
gives positional grams. One edit leaves one of the two chunks whole, at its place or, behind an insertion, one further
on, so grams further than one from a chunk are not sent. Rows meet on (lengths, open span, the letters outside it): the
edit lies in the open span, and only those few letters are compared.

A chunk that many words share is not joined: its open span is halved and each half is chunked again, level by level, until the
words that meet make at most `most_pairs` pairs or the span has one letter, where the alphabet bounds them. The span halves at each
level, so there are at most as many levels as bits in the longest word's length. Every pair is found, whatever its chunks.

An insertion that fits on both sides of a border (into a run of equal letters) is taken where it fits last, so a pair counts once.

Texts that are null or empty have no words; without a doc_id no letter is taken out of a word. Repeated rows count as often as they
occur. Extra columns are ignored. An empty table gives an empty result. Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actiontrail.llm.shared import saved

RUN = "[A-Za-zÀ-ÿ]+"
DROP_ONE_IN = 97
MIN_LENGTH = 5
MIN_COUNT = 3
MOST_PAIRS = 4096
# The count at least doubles at each step from a word to its form, so this many doublings of the path reach its end.
ROOT_ROUNDS = 6


def _lower(word: Column) -> Column:
    """Only A-Z; `lower` is fast, but also changes other letters."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def noisy_words(docs: DataFrame, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word) for each run of letters, every `drop_one_in`-th (by hash) without one letter: the contract's own noise."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc_id", _lower(F.col("run")).alias("word"))
    hashed = low.select("word", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("word")).cast("int")
    cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return hashed.select(F.when(F.pmod("h", F.lit(drop_one_in)) == 0, cut).otherwise(F.col("word")).alias("word"))


def counted(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough."""
    return (words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def _outside(word: Column, lo: Column, hi: Column) -> Column:
    """The letters of a word before `lo` and from `hi` on."""
    return F.concat(F.substr(word, F.lit(1), lo), F.substr(word, hi + 1))


def _opened(rows: DataFrame, spans: Column) -> DataFrame:
    """One row for each open span (lo, hi) of the chunked word's length: what is outside meets, what is inside is compared."""
    out = rows.withColumn("span", F.explode(spans)).select("word", "n", "grams", "size", "longer", F.col("span.lo").alias("lo"), F.col("span.hi").alias("hi"))
    end = F.when(F.col("grams"), F.col("hi") + F.col("longer")).otherwise(F.col("hi"))
    return out.withColumn("outside", _outside(F.col("word"), F.col("lo"), end)).withColumn(
        "inside", F.substr("word", F.col("lo") + 1, end - F.col("lo")))


def _halves(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi")))


KEY = ["size", "longer", "lo", "hi", "outside"]


def _joined(rows: DataFrame) -> DataFrame:
    """Pairs (x, y) of one edit among rows that meet, each pair once."""
    chunks, grams = rows.where("NOT grams").drop("grams"), rows.where("grams").drop("grams")
    grams = grams.select(*KEY, F.col("word").alias("y"), F.col("n").alias("y_n"), F.col("inside").alias("y_inside"))
    both = chunks.join(grams, KEY)
    x, y = F.col("inside"), F.col("y_inside")
    last = (F.col("hi") == F.col("size")) | (x != F.substr(y, F.lit(1), F.col("hi") - F.col("lo")))
    one = F.when(F.col("longer") == 0, F.col("word") < F.col("y")).otherwise(last)
    return both.where(one & (F.levenshtein(x, y, 1) == 1)).select(F.col("word").alias("x"), F.col("n").alias("x_n"), "y", "y_n")


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(x, x_n, y, y_n): all pairs of distinct words (word, n) that are one edit apart, each pair once."""
    size = F.char_length("word")
    sides = F.array(*[F.struct(F.lit(grams).alias("grams"), (size - longer).alias("size"), F.lit(longer).alias("longer"))
                      for grams, longer in ((False, 0), (False, 1), (True, 0), (True, 1))])
    # A chunked word has its own length in both roles; a gram word is as long as its partner or longer by one.
    roles = words.select("word", "n", F.explode(sides).alias("role")).select(
        "word", "n", "role.grams", F.when(F.col("role.grams"), F.col("role.size")).otherwise(size).alias("size"), "role.longer").where("size > 0")
    rows = saved(_opened(roles, _halves(F.lit(0), F.col("size"))), "spelling-chunks")
    found = None
    while True:
        meets = rows.groupBy(*KEY).agg(F.count_if(~F.col("grams")).alias("xs"), F.count_if("grams").alias("ys"))
        meets = saved(meets.where("xs > 0 AND ys > 0").select(*KEY, ((F.col("xs") * F.col("ys") > most_pairs) & (F.col("hi") - F.col("lo") > 1)).alias("common")), "spelling-keys")
        placed = rows.join(meets, KEY)
        pairs = _joined(placed.where("NOT common").drop("common"))
        found = pairs if found is None else found.union(pairs)
        if meets.where("common").isEmpty():
            return found
        rows = saved(_opened(placed.where("common").drop("common"), _halves(F.col("lo"), F.col("hi"))), "spelling-chunks")


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, form, n_near, form_n): the most frequent near word (ties: the first in code-point order) if it is at least twice as frequent."""
    links = pairs.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("y_n").alias("near_n")).union(
        pairs.select("y", "x", "x_n"))
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    taken = F.coalesce(-F.col("best.n") >= 2 * F.col("n"), F.lit(False))
    return joined.select("word", "n", F.when(taken, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
                         F.when(taken, -F.col("best.n")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of the path word, form, form of the form ..."""
    paths = saved(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-forms")
    for _ in range(ROOT_ROUNDS):
        further = paths.select(F.col("word").alias("from"), F.col("root").alias("to"))
        moved = saved(paths.join(further, F.col("root") == F.col("from"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "spelling-forms")
        paths = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return paths


def variants(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words (word, n)."""
    words = saved(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    formed = saved(forms(words, near_pairs(words, most_pairs)), "spelling-formed")
    return (formed.join(roots(formed), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def variant_report(docs: DataFrame) -> DataFrame:
    return variants(counted(noisy_words(docs)))
