"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word is the binary vector of its letter multiset: one dimension per letter and occurrence. An inserted or deleted letter
changes one dimension, a replaced one two, so words one edit apart have Hamming distance two at most. The dimensions are
split by letter into ``PARTS`` partitions; two such vectors differ in two partitions at most, hence agree on some
``PARTS - 2`` of them. Every choice of that many partitions is a signature, made of 10 bits per partition (equal contents
give equal bits), and words that share a signature are candidates. A pair meets under every choice it agrees on and is
counted under the first.

Letters alone tell short words badly apart, so a signature may hold many words. Those of more than ``GROUP`` words are not
paired: their words meet by what is left when one letter is taken out, which words one edit apart share and which at most a
few words per letter of the alphabet can. Both ways are exact, and each link comes from one of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = 6
BITS = 10
GROUP = 64  # words of a signature that are paired directly

CHOICES = list(combinations(range(PARTS), PARTS - 2))
MASKS = [sum(((1 << BITS) - 1) << (BITS * p) for p in choice) for choice in CHOICES]


def word_counts(docs: DataFrame, every: int = 31) -> DataFrame:
    """Rows (word, n): how often each word occurs in all texts.

    Words are runs of Latin letters, A-Z lower-cased. Where ``every`` divides the CRC-32 h of ``doc_id:word``, the word loses
    its letter number h modulo its length: planted misspellings by which the grouping can be tried. ``every = 0`` plants
    none. A null doc_id counts as an empty one, a null or empty text has no words; texts of any length are read whole.
    """
    runs = docs.select(
        "doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")
    )
    word = F.col("run")
    if every:
        name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        runs = runs.select("run", F.crc32(F.concat(name, F.lit(":"), "run").cast("binary")).alias("_h"))
        out = (F.col("_h") % F.char_length("run")).cast("int")
        word = F.when(F.col("_h") % every == 0, without_letter(F.col("run"), out + 1)).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def without_letter(word: Column, at: Column) -> Column:
    """``word`` without its code point number ``at``, counted from 1."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.char_length(word)))


def packed_vector(word: Column) -> Column:
    """``BITS`` bits for each partition's letters, with their number of occurrences, in one long."""
    letters = F.array_sort(F.split(word, ""))

    def bits(part: int) -> Column:
        own = F.filter(letters, lambda letter: F.ascii(letter) % PARTS == part)
        return F.pmod(F.xxhash64(F.array_join(own, "")), F.lit(1 << BITS))

    parts = [bits(p) for p in range(PARTS)]
    packed = parts[0]
    for p in range(1, PARTS):
        packed = packed.bitwiseOR(F.shiftleft(parts[p], BITS * p))
    return packed


def first_choice(differing: Column) -> Column:
    """The first choice of partitions on which two vectors agree, from the bits in which they differ; null if there is none."""
    chosen = F.when(differing.bitwiseAND(F.lit(MASKS[0])) == 0, 0)
    for i, mask in enumerate(MASKS[1:], 1):
        chosen = chosen.when(differing.bitwiseAND(F.lit(mask)) == 0, i)
    return chosen


def _links_of_small_groups(small: DataFrame) -> DataFrame:
    a, b = [small.select("signature", *[F.col(c).alias(f"{s}_{c}") for c in ("word", "n", "packed")]) for s in "ab"]
    pairs = a.join(b, "signature")
    same = F.col("a_packed").bitwiseXOR(F.col("b_packed"))
    sizes = F.char_length("a_word") - F.char_length("b_word")
    met = (F.col("a_word") < F.col("b_word")) & (F.abs(sizes) <= 1) & (first_choice(same) == choice_of(F.col("signature")))
    return pairs.where(met & (F.levenshtein("a_word", "b_word", 1) == 1)).select("a_word", "a_n", "b_word", "b_n")


def _links_of_large_groups(large: DataFrame) -> DataFrame:
    """Links of words that share a signature of a large group.

    ``at`` is the place of the letter taken out, 0 for the whole word. Two words of one length that are left alike without
    the letter at the same place differ there alone; a word that is left when a longer one loses a letter is that one with a
    letter deleted. Of equal neighbouring letters the first stands for all, so each link is found once. Words that are left
    alike are at most a few for every letter of the alphabet and place; only links among them are emitted.
    """
    chosen = F.call_function("shiftleft", F.lit(1), choice_of(F.col("signature")).cast("int"))
    hot = large.groupBy("word", "n", "packed").agg(F.bit_or(chosen).alias("hot"))
    out = hot.select("*", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("at"))
    left = F.when(F.col("at") == 0, F.col("word")).otherwise(without_letter(F.col("word"), F.col("at")))
    again = F.substring("word", F.col("at"), F.lit(1)) == F.substring("word", F.col("at") - 1, F.lit(1))
    out = out.withColumn("left", left).withColumn("first", (F.col("at") == 1) | ~again)
    member = F.struct("word", "n", "packed", "hot", "at", "first")
    alike = out.groupBy("left").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    a = F.col("a")

    def linked(b: Column) -> Column:
        replaced = (a["at"] == b["at"]) & (a["at"] > 0) & (a["word"] < b["word"])
        deleted = (a["at"] == 0) & (b["at"] > 0) & b["first"]
        choice = first_choice(a["packed"].bitwiseXOR(b["packed"]))
        return (replaced | deleted) & (F.call_function("shiftright", a["hot"], choice).bitwiseAND(F.lit(1)) == 1)

    pairs = alike.select("members", F.explode("members").alias("a"))
    pairs = pairs.select("a", F.explode(F.filter("members", linked)).alias("b"))
    return pairs.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("word", "n")])


def choice_of(signature: Column) -> Column:
    return F.shiftrightunsigned(signature, BITS * PARTS)


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Rows (a_word, a_n, b_word, b_n): every pair of distinct words exactly one edit apart, once. Words must not repeat.

    A signature is one number: the bits of the chosen partitions below, the number of the choice above them.
    """
    vectors = words.select("word", "n", packed_vector(F.col("word")).alias("packed"))
    signatures = [
        F.col("packed").bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(F.lit(i).cast("bigint"), BITS * PARTS))
        for i, mask in enumerate(MASKS)
    ]
    signed = vectors.select("word", "n", "packed", F.explode(F.array(*signatures)).alias("signature"))
    # Written out so that all readers of the signatures ask for the same shuffle, which then runs once.
    signed = signed.where(F.col("signature").isNotNull())
    signed = signed.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("signature")))
    small = _links_of_small_groups(signed.where(F.col("_size") <= group))
    return small.unionByName(_links_of_large_groups(signed.where(F.col("_size") > group)))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for all rows (word, form): the end of the chain of forms, by doubling the steps.

    Chains must have no cycle; the number of rounds is the logarithm of the longest. No rows give no rows.
    """
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        joined = now.join(step, now["root"] == step["_word"], "left")
        next_ = written(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        now = next_.select("word", "root")
        if next_.where("moved").isEmpty():
            return now


def spelling_variants(counts: DataFrame, letters: int = 7, least: int = 2, times: int = 10, group: int = GROUP) -> DataFrame:
    """Per word of ``counts`` (word, n) that has ``letters`` code points and ``n >= least``: its form and its root.

    Columns word, form, root, n, n_near, form_n. Near words differ by exactly one inserted, deleted or replaced code point.
    A word's form is its most frequent near word (ties: first in code-point order) if that is at least ``times`` as frequent,
    else null; its root is where following forms ends, the word itself if it has none. ``times`` must be above 1, so chains
    end. Null words play no part; a word that comes in several rows counts once with its summed n. An empty table gives no rows.
    """
    if times <= 1:
        raise ValueError("times must be above 1")
    words = counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    return _grouped(words, letters, least, times, group)


def variants_of_texts(docs: DataFrame, every: int = 31, letters: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """``spelling_variants`` of the words of all texts; see ``word_counts``. Other columns than doc_id and text play no part."""
    return _grouped(word_counts(docs, every), letters, least, times, GROUP)


def _grouped(words: DataFrame, letters: int, least: int, times: int, group: int) -> DataFrame:
    words = written(words.where((F.col("n") >= least) & (F.char_length("word") >= letters)))
    links = near_words(words, group)
    ends = F.array(
        F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n")),
    )
    # Most frequent first; bytes of UTF-8 order words as code points do.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    nearest = links.select(F.inline(ends)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    nearest = nearest.select(F.col("word").alias("_word"), "n_near", "best.near", (-F.col("best.less")).alias("near_n"))
    joined = words.join(nearest, words["word"] == nearest["_word"], "left")
    enough = F.col("near_n") >= times * F.col("n")
    formed = written(
        joined.select(
            "word", F.when(enough, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("near_n")).cast("bigint").alias("form_n"),
        )
    )
    ends = roots(formed.where("form is not null").select("word", "form")).select(F.col("word").alias("_word"), "root")
    return formed.join(ends, formed["word"] == ends["_word"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("bigint").alias("n"), "n_near", "form_n"
    )
