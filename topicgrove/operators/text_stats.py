"""Term statistics: weighted tf and idf by group, background statistics, vocabularies and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgrove.functions.text import is_phrase, keep_probability, tokens, uniform
from topicgrove.operators.ranges import numbered, summed_up


def count_terms(docs: DataFrame, *by: str, terms_col: str = "phrases", weight: str | None = None) -> DataFrame:
    """(by..., doc_id, term, n, weight) of documents with arrays of terms; a document without terms has a null term."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = docs.select(*by, "doc_id", w.cast("double").alias("weight"), F.explode_outer(terms_col).alias("term"))
    return each.groupBy(*by, "doc_id", "weight", "term").agg(F.count("term").alias("n"))


def term_sums(counts: DataFrame, *by: str) -> DataFrame:
    """(by..., term, mass, df) from ``count_terms`` rows: weighted occurrences and documents of each term."""
    return counts.where("term is not null").groupBy(*by, "term").agg(F.sum(F.col("n") * F.col("weight")).alias("mass"), F.sum("weight").alias("df"))


def group_totals(counts: DataFrame, *by: str) -> DataFrame:
    """(by..., all_mass, all_docs) from ``count_terms`` rows; a row a group, whose keys are taxonomy nodes."""
    docs = counts.groupBy(*by, "doc_id").agg(F.max("weight").alias("weight"), F.sum(F.col("n") * F.col("weight")).alias("mass"))
    return docs.groupBy(*by).agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_docs"))


def rolled_up(sums: DataFrame, totals: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Sums and totals of coarser groups, where each document is in one of the finer ones."""
    return (
        sums.groupBy(*by, "term").agg(F.sum("mass").alias("mass"), F.sum("df").alias("df")),
        totals.groupBy(*by).agg(F.sum("all_mass").alias("all_mass"), F.sum("all_docs").alias("all_docs")),
    )


def from_sums(by_term: DataFrame, totals: DataFrame, *by: str, phrases: DataFrame | None = None) -> DataFrame:
    """(by..., term, tf, idf) as ``tf_idf`` gives it."""
    keys = list(by)
    if phrases is not None:
        listed = F.broadcast(totals.select(*keys)).crossJoin(phrases.select("term").distinct()) if keys else phrases.select("term").distinct()
        by_term = listed.join(by_term, [*keys, "term"], "left")
    joined = by_term.join(F.broadcast(totals), keys) if keys else by_term.crossJoin(F.broadcast(totals))
    tf = F.coalesce(F.try_divide("mass", "all_mass"), F.lit(0.0))
    idf = F.when(F.col("df") > 0, F.ln(F.col("all_docs") / F.col("df"))).otherwise(0.0)
    return joined.select(*keys, "term", tf.alias("tf"), idf.alias("idf"))


def tf_idf(counts: DataFrame, *by: str, phrases: DataFrame | None = None) -> DataFrame:
    """(by..., term, tf, idf) from ``count_terms`` rows.

    tf is the weighted share of all occurrences, those outside ``phrases`` included; idf = ln(sum of weights of all
    documents / sum of weights of documents with the term). A listed phrase that is absent has 0 and 0 where there is
    a group to be absent from. A group without occurrences has tf 0.
    """
    return from_sums(term_sums(counts, *by), group_totals(counts, *by), *by, phrases=phrases)


def background_tf_idf(counts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(term, tf, idf) of listed phrases in unweighted background counts: tf = (count + 1) / all, idf = ln(docs / df) or 0."""
    by_term = counts.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))
    totals = counts.agg(F.sum("n").alias("all"), F.count_distinct("doc_id").alias("docs"))
    joined = phrases.select("term").distinct().join(by_term, "term", "left").crossJoin(F.broadcast(totals))
    tf = F.try_divide(F.coalesce("n", F.lit(0)) + F.lit(1.0), F.col("all"))
    idf = F.when(F.col("df") > 0, F.ln(F.col("docs") / F.col("df"))).otherwise(0.0)
    return joined.select("term", F.coalesce(tf, F.lit(0.0)).alias("tf"), idf.alias("idf"))


def distinct_terms(counts: DataFrame) -> DataFrame:
    return counts.where("term is not null").select("term").distinct()


def rescaled(df: DataFrame, col: str, *by: str, low: int = 1, high: int = 10) -> DataFrame:
    """A column ``replicas``: the value moved linearly onto low..high and cut to an integer; ``low`` if all are equal."""
    ends = df.groupBy(*by).agg(F.min(col).alias("_min"), F.max(col).alias("_max"))
    joined = df.join(F.broadcast(ends), list(by)) if by else df.crossJoin(F.broadcast(ends))
    share = (F.col(col) - F.col("_min")) / F.nullif(F.col("_max") - F.col("_min"), F.lit(0.0))
    return joined.withColumn("replicas", F.coalesce(F.floor(low + (high - low) * share), F.lit(low)).cast("int")).drop("_min", "_max")


def replicated(df: DataFrame, replicas: str = "replicas") -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(replicas))))


def word_counts(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, cn) of lines; each line also ends a sentence, ``</s>``. Phrases count one more, so that pruning keeps them."""
    words = lines.select(F.explode(F.array_append(tokens(F.col(text_col)), "</s>")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("cn"))
    return counted.select("word", (F.col("cn") + is_phrase(F.col("word")).cast("long")).alias("cn"))


def context_word_counts(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, cn) of context lines, whose first token is the target and does not count."""
    contexts = F.slice(tokens(F.col(text_col)), F.lit(2), F.size(tokens(F.col(text_col))))
    words = lines.select(F.explode(F.array_append(contexts, "</s>")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("cn"))


def pruned(vocabulary: DataFrame, min_count: int = 2) -> DataFrame:
    return vocabulary.where((F.col("cn") >= min_count) | (F.col("word") == "</s>"))


def ranked(vocabulary: DataFrame) -> DataFrame:
    """(word, cn, idx): ``</s>`` first, then by falling count, ties by word; numbered by sorted ranges."""
    return numbered(vocabulary.select("word", "cn"), "idx", F.col("word") != "</s>", F.desc("cn"), F.col("word"))


def keep_probabilities(vocabulary: DataFrame, sample: float = 1e-4) -> DataFrame:
    total = vocabulary.agg(F.sum("cn").alias("_total"))
    return vocabulary.crossJoin(F.broadcast(total)).withColumn("keep_p", keep_probability(F.col("cn"), F.col("_total"), sample)).drop("_total")


def subsampled(words: DataFrame, vocabulary: DataFrame, sample: float = 1e-4, seed: int = 0) -> DataFrame:
    """Occurrences (doc_id, pos, word) that frequent-word subsampling keeps, the same at each run."""
    kept = words.join(keep_probabilities(vocabulary, sample).select("word", "keep_p"), "word")
    return kept.where(F.col("keep_p") >= uniform("doc_id", "pos", seed=seed)).drop("keep_p")


def noise_distribution(vocabulary: DataFrame, power: float = 0.75) -> DataFrame:
    """(word, p, upto): chance of each word as a negative and the running sum in vocabulary order."""
    massed = vocabulary.select("word", "cn", F.pow(F.col("cn").cast("double"), F.lit(power)).alias("mass"))
    total = massed.agg(F.sum("mass").alias("all_mass"))  # one row
    shares = massed.crossJoin(F.broadcast(total)).select("word", "cn", (F.col("mass") / F.col("all_mass")).alias("p"))
    return summed_up(shares, "p", "upto", F.desc("cn"), F.col("word"))


def skipgram_pairs(docs: DataFrame, window: int, words_col: str = "words") -> DataFrame:
    """(doc_id, center, context, n) of words at most ``window`` apart, from each row's own array: nothing is joined."""
    at = docs.select("doc_id", F.posexplode(words_col).alias("pos", "center"), F.col(words_col).alias("_w"))
    near = F.concat(
        F.slice("_w", F.greatest(F.lit(1), F.col("pos") + 1 - window), F.least(F.col("pos"), F.lit(window))),
        F.slice("_w", F.col("pos") + 2, F.lit(window)),
    )
    each = at.select("doc_id", "center", F.explode(near).alias("context"))
    return each.groupBy("doc_id", "center", "context").agg(F.count("*").alias("n"))
