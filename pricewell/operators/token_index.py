"""Substring search over short texts by an inverted index of q-grams.

A query matches a text if each of its tokens is a substring of the normalised text. Tokens hold no blank,
so a token is found in a text exactly if a word of the text contains it. The index therefore is over distinct words:

1. ``vocabulary``: distinct words with the number of texts that have them;
2. ``postings``: (gram, word) for grams of two and three letters;
3. a token's rarest gram names candidate words, and containment is then tested: (token, word);
4. a query's rarest token names candidate texts, and its other tokens are then tested: (query, text).

Every step is an equality join on distinct words, tokens, queries or texts. Candidates of a query are at most
the texts of its rarest token, and of a single-token query they are the answer itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.text import normalize, tokens

LONGEST_GRAM = 3


def grams(word: Column, size: int) -> Column:
    """Distinct substrings of ``size`` letters; none of a shorter word."""
    at = F.sequence(F.lit(1), F.length(word) - size + 1)
    return F.when(F.length(word) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(word, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def query_key(query: Column) -> Column:
    """A query's distinct tokens in order, as one string; empty if it has none."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(query))), " ")


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n) from (word, text) rows."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def postings(words: DataFrame) -> DataFrame:
    """(gram, word) of distinct words."""
    return words.select("word", F.explode(F.concat(*[grams(F.col("word"), k) for k in range(2, LONGEST_GRAM + 1)])).alias("gram"))


def token_words(found: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, word, n): the words that contain each token (``found``: distinct tokens of two letters or more)."""
    index = postings(vocab)
    size = F.least(F.length("token"), F.lit(LONGEST_GRAM))
    own = found.withColumn("gram", F.explode(F.when(size == 2, grams(F.col("token"), 2)).otherwise(grams(F.col("token"), LONGEST_GRAM))))
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
    # a gram without postings says that no word contains the token
    rarest = own.join(counts, "gram", "left").groupBy("token").agg(F.min_by("gram", F.struct(F.coalesce("rows", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(index, "gram").filter(F.contains("word", "token")).select("token", "word").join(vocab, "word")


def matching_texts(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, text): for distinct keys (``query_key``) the distinct normalised texts that hold all their tokens."""
    words = texts.select("text", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).filter("word <> ''")
    asked = queries.filter("key <> ''").withColumn("tokens", F.split("key", " "))
    each = asked.select("key", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    found = token_words(each.select("token").distinct(), vocabulary(words))
    # a token that no word contains ends its query
    weight = found.groupBy("token").agg(F.sum("n").alias("weight"))
    rarest = each.join(weight, "token").groupBy("key").agg(F.count(F.lit(1)).alias("known"), F.first("size").alias("size"), F.min_by("token", F.struct("weight", "token")).alias("token"))
    near = rarest.filter("known = size").select("key", "size", "token").join(found.select("token", "word"), "token").join(words, "word")
    holds = F.forall(F.split("key", " "), lambda t: F.contains("text", t))
    return near.filter((F.col("size") == 1) | holds).select("key", "text").distinct()


def keyed_texts(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows once for each distinct normalised text among ``names``, as ``_text``."""
    told = F.array_distinct(F.filter(F.array(*[normalize(F.col(n)) for n in names]), lambda t: t.isNotNull() & (t != "")))
    return rows.withColumn("_text", F.explode(told))
