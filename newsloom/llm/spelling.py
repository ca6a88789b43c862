"""Spelling variants: pairs of words one edit apart, from the merges of an errata trie along its heavy paths."""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import discard, filled, stash

#: Letters of a word, as a class of a regular expression.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: Longest word of the trie; near words of which one is longer share all blocks but one of BLOCKS.
TRIE_CHARS = 64
BLOCKS = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(word: Column) -> Column:
    """The word with A-Z, and nothing else, in lower case."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def runs(docs: DataFrame, min_chars: int = MIN_CHARS, letters: str = LETTERS) -> DataFrame:
    """(doc_id, text) -> (doc_id, word): each maximal run of letters of at least ``min_chars``, lower-cased, repeats
    included. Null texts have none; extra columns are left out."""
    found = F.regexp_extract_all(F.col("text"), F.lit(f"[{letters}]{{{min_chars},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("word")).select("doc_id", lowered(F.col("word")).alias("word"))


def without(word: Column, at: Column) -> Column:
    """The word without the code point at a place counted from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word) -> (word, n): the words of at least ``min_chars`` code points that occur ``min_count`` times or more."""
    return words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def light_entries(words: DataFrame) -> DataFrame:
    """(word, n) distinct -> (word, n, at, c, heavy): each edge of the words' trie that a word takes off a heavy path.

    A node is a prefix; its children are the next code points, and the end of a word is a child named "". The heavy child
    is the one with most words below it (of equals the last in code-point order), so a word leaves heavy paths no more
    often than the binary logarithm of the number of words: that bounds all merges, small into large. at: the
    prefix's length; c: the code point taken; heavy: the one that the heavy path takes there.
    """
    spots = F.sequence(F.lit(0), F.char_length("word"))
    steps = words.select("word", "n", F.explode(spots).alias("at"))
    steps = steps.select("word", "n", "at", F.substr("word", F.lit(1), F.col("at")).alias("p"), F.substr("word", F.col("at") + 1, F.lit(1)).alias("c"))
    below = steps.groupBy("p", "c").agg(F.count("*").alias("words"))
    # a node has no more children than there are letters
    kids = below.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("words", "c")), asc=False).alias("kids")).where(F.size("kids") > 1)
    light = kids.select("p", F.col("kids")[0]["c"].alias("heavy"), F.explode(F.slice("kids", F.lit(2), F.size("kids") - 1)).alias("kid"))
    return steps.join(light.select("p", F.col("kid.c").alias("c"), "heavy"), ["p", "c"]).select("word", "n", "at", "c", "heavy")


def _merged(words: DataFrame) -> DataFrame:
    """(word, n) -> (members): groups of words in which each two are one edit apart, and each such pair is in one group.

    A light word p c s is merged into the heavy subtree of p in three ways: with c replaced by the heavy code point, with c
    skipped, and with the heavy one skipped on the other side (so that it stands before c). Where its end coincides with a
    word's, the two are near; light words that coincide with c replaced are near each other too, whether or not the heavy
    subtree has that word. Two near words part at one node, and c is skipped only where s does not begin with it, so no
    pair comes twice.
    """
    w, at, c, h = F.col("word"), F.col("at"), F.col("c"), F.col("heavy")
    before, after = F.substr(w, F.lit(1), at), F.substr(w, at + 2)
    inner = c != ""
    merges = F.array(
        F.struct(F.when(inner, F.concat(before, h, after)).alias("key"), at.alias("spot"), F.lit("").alias("own")),
        F.struct(F.when(inner & ~F.startswith(after, c), F.concat(before, after)).alias("key"), F.lit(-1).alias("spot"), w.alias("own")),
        F.struct(F.concat(before, h, F.substr(w, at + 1)).alias("key"), F.lit(-2).alias("spot"), w.alias("own")),
    )
    ends = light_entries(words).select("word", "n", F.inline(merges)).where("key is not null")
    met = ends.join(words.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key", "left").where("spot >= 0 or key_n is not null")
    member = F.struct((-F.col("n")).alias("less"), "word")
    # in a group of one spot each word has a letter of its own there, so a group is no larger than the alphabet
    groups = met.groupBy("key", "spot", "own").agg(F.collect_list(member).alias("light"), F.first("key_n").alias("key_n"))
    heavy = F.when(F.col("key_n").isNotNull(), F.array(F.struct((-F.col("key_n")).alias("less"), F.col("key").alias("word")))).otherwise(F.array().cast("array<struct<less: bigint, word: string>>"))
    return groups.select(F.concat("light", heavy).alias("members")).where(F.size("members") > 1)


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, n) -> (members): pairs of near words of which one exceeds TRIE_CHARS. One edit lies in one of BLOCKS blocks of
    the shorter word; what stands before and after that block is equal in both, so words are compared that share these."""
    long = words.where(F.char_length("word") >= TRIE_CHARS)
    sized = long.select("word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("size"))
    cut = lambda j: F.floor(F.col("size") * j / BLOCKS).cast("int")
    shared = F.array(*(F.struct(F.lit(j).alias("block"), F.xxhash64(F.substr("word", F.lit(1), cut(j)), F.lit("|"), F.substr("word", F.char_length("word") - F.col("size") + cut(j + 1) + 1)).alias("rest")) for j in range(BLOCKS)))
    keyed = sized.select("word", "n", "size", F.inline(shared))
    other = keyed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "size", "block", "rest")
    # of equal lengths each pair is met once, in order; else the longer word has the size of the shorter
    pair = (F.char_length("word") == F.col("size")) & ((F.char_length("other") > F.col("size")) | (F.col("word") < F.col("other"))) & (F.char_length("other") > TRIE_CHARS)
    near = keyed.join(other, ["size", "block", "rest"]).where(pair).where(F.levenshtein("word", "other", 1) == 1)
    found = near.select("word", "n", "other", "other_n").distinct()
    return found.select(F.array(F.struct((-F.col("n")).alias("less"), "word"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("members"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) distinct, written -> (word, n_near, nearest): for each word with near words their number and, as a struct
    (less: the negative count, word), the most frequent of them, of equals the first in code-point order."""
    groups = _merged(words.where(F.char_length("word") <= TRIE_CHARS)).unionByName(_long_pairs(words))
    told = groups.select(F.array_sort("members").alias("m")).select(F.posexplode("m").alias("i", "one"), "m")
    # the best of the others: the first of the group, for the first itself the second
    told = told.select(F.col("one.word").alias("word"), (F.size("m") - 1).alias("others"), F.when(F.col("i") == 0, F.col("m")[1]).otherwise(F.col("m")[0]).alias("best"))
    return told.groupBy("word").agg(F.sum("others").alias("n_near"), F.min("best").alias("nearest"))


def _rooted(forms: DataFrame, steps: float) -> DataFrame:
    """(word, form) -> (word, root) in the shared folder: the last of a word's forms, by doubling; ``steps`` bounds the chains."""
    roots = stash(forms.withColumnRenamed("form", "root"), "spelling-roots")
    for _ in range(ceil(log2(max(steps, 1)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, roots = roots, stash(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        discard(before)
    return roots


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n) -> (word, form, root, n, n_near, form_n), a row for each word.

    Two words are near if they differ by one inserted, deleted or replaced code point; n_near counts a word's near words.
    form: the most frequent near word, of equals the first in code-point order, if its n is ``ratio`` (over 1) times the word's
    or more; form_n: its n. root: where the forms lead, the word itself without one. Null and empty words are left out, the counts of
    a repeated word are added up, a null count is 0; columns other than word and n are ignored; an empty table gives no rows.
    Words are range-partitioned, so most of a trie node is counted within one task; hot prefixes are
    aggregated before they are shuffled. Letters of words up to TRIE_CHARS code points are compared through the trie,
    longer words by blocks, exactly as well.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, else forms can run in a circle")
    held = words.where("word <> ''").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    held = stash(held.repartitionByRange("word"), "spelling-words")
    near = near_words(held)
    usable = -F.col("nearest.less") >= ratio * F.col("n")
    named = held.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usable, F.col("nearest.word")).alias("form"), F.when(usable, -F.col("nearest.less")).alias("form_n"))
    named = stash(named, "spelling-forms")
    most = held.agg(F.max("n")).first()[0] or 1
    # counts above 0 grow by ratio at least with each form; one more step may start from 0
    roots = _rooted(named.where("form is not null").select("word", "form"), 2 + log(max(most, 1), ratio))
    discard(held)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def marked_runs(docs: DataFrame, every: int) -> DataFrame:
    """runs() in which one code point is missing wherever ``every`` divides the crc32 of ``doc_id:word``: the code point at that
    number modulo the length. A known rate of errors, to measure variants() on. A null doc_id counts as no digits."""
    sign = F.crc32(F.concat(filled(F.col("doc_id").cast("string")), F.lit(":"), F.col("word")))
    marked = runs(docs).select("word", sign.alias("sign"))
    return marked.select(F.when(F.col("sign") % every == 0, without(F.col("word"), (F.col("sign") % F.char_length("word")).cast("int"))).otherwise(F.col("word")).alias("word"))
