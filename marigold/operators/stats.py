"""Distributions, divergences, folds, rating summaries and health reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marigold.functions import vectors

# Transition matrices of an answer towards a pole, rows and columns (positive, negative).
POSITIVE_STEP = ((0.8, 0.2), (0.45, 0.55))
NEGATIVE_STEP = ((0.55, 0.45), (0.2, 0.8))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def distributions(df: DataFrame, smoothing: float = 1e-6) -> DataFrame:
    """(type_label, question_id, answer_value, p): smoothed distribution of each type's answers over its question's support."""
    require_columns(df, ("type_label", "question_id", "answer_value"))
    counts = df.where("answer_value IS NOT NULL").groupBy("type_label", "question_id", "answer_value").agg(F.count("*").alias("n"))
    support = counts.select("question_id", "answer_value").distinct()
    cells = df.select("type_label", "question_id").where("type_label IS NOT NULL").distinct().join(support, "question_id")
    filled = cells.join(counts, ["type_label", "question_id", "answer_value"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + F.lit(smoothing))
    return filled.select("type_label", "question_id", "answer_value", (F.col("c") / F.sum("c").over(Window.partitionBy("type_label", "question_id"))).alias("p"))


def _kl(p: Column, q: Column, epsilon: float = 1e-12) -> Column:
    a, b = (F.least(F.lit(1.0), F.greatest(F.lit(epsilon), x)) for x in (p, q))
    return F.sum(a * F.ln(a / b))


def divergence_rank(df: DataFrame, top_k: int = 20, smoothing: float = 1e-6) -> DataFrame:
    """(question, type_a, type_b, kl_ab, kl_ba, jsd): the pairs of types that a question tells apart best."""
    d = distributions(df, smoothing)
    a = d.select(F.col("question_id").alias("question"), F.col("type_label").alias("type_a"), "answer_value", F.col("p").alias("pa"))
    b = d.select(F.col("question_id").alias("question"), F.col("type_label").alias("type_b"), "answer_value", F.col("p").alias("pb"))
    m = (F.col("pa") + F.col("pb")) * 0.5
    pairs = a.join(b, ["question", "answer_value"]).where("type_a < type_b").groupBy("question", "type_a", "type_b")
    scored = pairs.agg(_kl(F.col("pa"), F.col("pb")).alias("kl_ab"), _kl(F.col("pb"), F.col("pa")).alias("kl_ba"), (0.5 * _kl(F.col("pa"), m) + 0.5 * _kl(F.col("pb"), m)).alias("jsd"))
    rounded = scored.select("question", "type_a", "type_b", *(F.round(c, 6).alias(c) for c in ("kl_ab", "kl_ba", "jsd")))
    return rounded.orderBy(F.desc("jsd"), F.desc("kl_ab"), F.desc("kl_ba"), "question", "type_a", "type_b").limit(top_k)


def rater_disagreement(df: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(question, mean_jsd, flagged): mean pairwise divergence of raters (type_label) per question, flagged above the threshold."""
    all_pairs = divergence_rank(df, top_k=2**31 - 1)
    return all_pairs.groupBy("question").agg(F.round(F.avg("jsd"), 6).alias("mean_jsd")).withColumn("flagged", F.col("mean_jsd") > threshold)


def _step(state: Column, positive: Column) -> Column:
    def next_value(j: int) -> Column:
        up = state["p"] * POSITIVE_STEP[0][j] + state["n"] * POSITIVE_STEP[1][j]
        down = state["p"] * NEGATIVE_STEP[0][j] + state["n"] * NEGATIVE_STEP[1][j]
        return F.when(positive, up).otherwise(down)

    p, n = next_value(0), next_value(1)
    return F.struct(F.when(p + n > 0, p / (p + n)).otherwise(0.5).alias("p"), F.when(p + n > 0, n / (p + n)).otherwise(0.5).alias("n"))


def markov_fold(answers: DataFrame, keys: Sequence[str], order: Sequence[str], positive: Column) -> DataFrame:
    """keys, p_pos, p_neg: each group's state after its answers in order, from (0.5, 0.5). A session's answers are few by nature."""
    steps = answers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, positive.alias("_pos")))).alias("_a"))
    start = F.struct(F.lit(0.5).alias("p"), F.lit(0.5).alias("n"))
    return steps.select(*keys, F.aggregate("_a", start, lambda s, a: _step(s, a["_pos"])).alias("s")).select(*keys, F.col("s.p").alias("p_pos"), F.col("s.n").alias("p_neg"))


def type_scores(axes: DataFrame, types: dict[str, str], top: int = 5) -> DataFrame:
    """(session, code, score, pct): product of four axis marginals, the best `top` types and their share among these.

    axes: session and p_e, p_n, p_t, p_j. types: four letters by code, a small fixed table that is part of the plan."""

    def score(letters: str) -> Column:
        e, n, t, j = (F.col(p) if letters[i] == first else 1 - F.col(p) for i, (first, p) in enumerate((("E", "p_e"), ("N", "p_n"), ("T", "p_t"), ("J", "p_j"))))
        return e * n * t * j

    scored = axes.select("session", F.explode(F.array(*(F.struct(F.lit(c).alias("code"), score(m).alias("score")) for c, m in types.items()))).alias("x")).select("session", "x.*")
    best = Window.partitionBy("session").orderBy(F.desc(F.round("score", 12)), "code")
    kept = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top)
    total = F.sum("score").over(Window.partitionBy("session"))
    return kept.select("session", "code", "score", (F.col("score") / F.when(total == 0, 1.0).otherwise(total) * 100).alias("pct"))


def uniformity(df: DataFrame, axis: str, ddof: int = 0) -> DataFrame:
    """(n_axes, min_axis, max_axis, uniformity): deviation over mean of the counts per axis, population (0) or sample (1)."""
    c = df.groupBy(axis).agg(F.count("*").alias("n"))
    deviation = F.stddev_pop("n") if ddof == 0 else F.stddev_samp("n")
    return c.agg(F.count("*").alias("n_axes"), F.min_by(axis, F.struct("n", axis)).alias("min_axis"), F.max_by(axis, F.struct("n", axis)).alias("max_axis"), F.round(deviation / F.avg("n"), 6).alias("uniformity"))


def value_counts(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """(value, n, percent): the most frequent values, nulls and empties aside; ties by value."""
    counted = df.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("value", "n", F.floor(F.col("n") * 100 / F.col("total")).alias("percent")).orderBy(F.desc("n"), "value").limit(top)


def term_frequency(terms: DataFrame, column: str, *, min_support: int = 3, min_length: int = 3, top: int = 100) -> DataFrame:
    """(term, n): frequent terms of enough length."""
    counted = terms.where(F.length(column) >= min_length).groupBy(F.col(column).alias("term")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_support).orderBy(F.desc("n"), "term").limit(top)


def term_lists(special: DataFrame, general: DataFrame, column: str, *, min_support: int = 3, top: int = 100, second: int = 25) -> DataFrame:
    """(list, term, n): frequent special terms, and frequent general terms that are not among them."""
    first = term_frequency(special, column, min_support=min_support, top=top)
    rest = term_frequency(general, column, min_support=min_support, top=top).join(first.select("term"), "term", "left_anti").orderBy(F.desc("n"), "term").limit(second)
    return first.select(F.lit("special").alias("list"), "term", "n").unionByName(rest.select(F.lit("general").alias("list"), "term", "n"))


def dimension_mode(df: DataFrame, vector_col: str, prefer: str = "larger") -> DataFrame:
    """(dimension, n): the most frequent vector length; ties to the larger one, or with prefer="smaller" to the smaller."""
    counted = df.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("dimension")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.desc("dimension") if prefer == "larger" else F.asc("dimension")).limit(1)


def health_report(profiles: DataFrame, vectors: DataFrame, *, id_col: str = "cid", name_col: str = "name") -> DataFrame:
    """One row: rows, duplicate and missing ids and names, coverage both ways; the true intersection beside the legacy figure."""
    p = profiles.agg(F.count("*").alias("n_profiles"), F.countDistinct(id_col).alias("profile_ids"), F.sum(F.when(F.coalesce(F.trim(F.col(name_col).cast("string")), F.lit("")) == "", 1).otherwise(0)).alias("missing_names"))
    v = vectors.agg(F.count("*").alias("n_vectors"), F.countDistinct(id_col).alias("vector_ids"))
    ids = profiles.select(F.col(id_col).alias("i")).where("i IS NOT NULL").distinct().withColumn("p", F.lit(1)).join(vectors.select(F.col(id_col).alias("i")).where("i IS NOT NULL").distinct().withColumn("v", F.lit(1)), "i", "full")
    both = ids.agg(F.count(F.when(F.col("p").isNotNull() & F.col("v").isNotNull(), 1)).alias("intersection"), F.count(F.when(F.col("p").isNull(), 1)).alias("vectors_without_profile"), F.count(F.when(F.col("v").isNull(), 1)).alias("profiles_without_vector"))
    one = p.crossJoin(v).crossJoin(both)
    return one.select("n_profiles", "n_vectors", (F.col("n_profiles") - F.col("profile_ids")).alias("duplicate_ids"), "missing_names", "intersection", "vectors_without_profile", "profiles_without_vector", (F.least("profile_ids", "vector_ids") - F.col("vectors_without_profile")).alias("legacy_intersection"))


def no_progress_stop(pages: DataFrame, *, keys: Sequence[str], order: str, new_col: str, limit: int) -> DataFrame:
    """The pages that a crawl reads: it stops after `limit` pages in a row with nothing new."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = pages.withColumn("_g", F.sum(F.when(F.col(new_col) > 0, 1).otherwise(0)).over(w))
    barren = F.sum(F.when(F.col(new_col) > 0, 0).otherwise(1)).over(Window.partitionBy(*keys, "_g").orderBy(order))
    stopped = F.max(F.when(F.col("_b") >= limit, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_b", barren).withColumn("_s", F.coalesce(stopped, F.lit(0))).where("_s = 0").drop("_g", "_b", "_s")


def moving_average(df: DataFrame, time_col: str, value_col: str, weeks: int = 3) -> DataFrame:
    """(week, mean, moving): weekly means and the mean over the last `weeks` of them."""
    weekly = df.groupBy(F.window(time_col, "7 days").alias("w")).agg(F.avg(value_col).alias("mean")).select(F.col("w.start").alias("week"), "mean")
    return weekly.withColumn("moving", F.avg("mean").over(Window.orderBy("week").rowsBetween(-(weeks - 1), 0)))


def krippendorff_alpha(ratings: DataFrame, *, unit: str, value: str) -> DataFrame:
    """(alpha, units): nominal reliability from the coincidences of values within units that have at least two ratings."""
    cells = ratings.where(F.col(value).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    sized = cells.withColumn("m", F.sum("n").over(Window.partitionBy("u"))).where("m > 1")
    within = sized.groupBy("u").agg(F.first("m").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree")).agg(F.sum((F.col("m") * (F.col("m") - 1) - F.col("agree")) / (F.col("m") - 1)).alias("observed"), F.sum("m").alias("total"), F.count("*").alias("units"))
    margins = sized.groupBy("v").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    observed, total = F.col("observed") / F.col("total"), F.col("total")
    expected = (total * (total - 1) - F.col("same")) / (total * (total - 1))
    return within.crossJoin(margins).select(F.round(F.when(expected == 0, 1.0).otherwise(1 - observed / expected), 6).alias("alpha"), "units")


def topic_shift(turns: DataFrame, score: Column, *, keys: Sequence[str], order: str, threshold: float = 0.55) -> DataFrame:
    """turns with the similarity to the turn before it and whether it shifts the topic; a first turn does not."""
    return turns.withColumn("similarity", score).withColumn("shift", F.coalesce(F.col("similarity") < threshold, F.lit(False)))


def lexicon_rates(df: DataFrame, lexicon: Sequence[str], *, id_col: str, text_col: str) -> DataFrame:
    """(id, hits, tokens, per_100): how often the words of a lexicon occur per 100 tokens."""
    from marigold.functions.text import ascii_words

    words = ascii_words(F.col(text_col))
    hits = F.size(F.filter(words, lambda w: w.isin(*[x.lower() for x in lexicon])))
    return df.select(id_col, hits.cast("long").alias("hits"), F.size(words).cast("long").alias("tokens")).withColumn("per_100", F.round(F.when(F.col("tokens") > 0, F.col("hits") * 100.0 / F.col("tokens")).otherwise(0.0), 6))


def embedding_pool(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(dimensions, mean_nonzero, mean_norm): largest length, mean number of components that are not zero, mean Euclidean norm."""
    v = F.col(vector_col)
    nonzero = F.size(F.filter(v, lambda x: x != 0))
    return df.where(v.isNotNull()).agg(F.max(F.size(v)).alias("dimensions"), F.round(F.avg(nonzero), 6).alias("mean_nonzero"), F.round(F.avg(vectors.norm(v)), 6).alias("mean_norm"))


def fleiss_kappa(ratings: DataFrame, *, unit: str, value: str) -> DataFrame:
    """(kappa, units): nominal agreement beyond chance over all units of at least two ratings, whose numbers may differ: the mean of each
    unit's own share of agreeing pairs against the chance of the pooled values."""
    cells = ratings.where(F.col(value).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    sized = cells.withColumn("m", F.sum("n").over(Window.partitionBy("u"))).where("m > 1")
    agree = sized.groupBy("u").agg(((F.sum(F.col("n") * F.col("n")) - F.first("m")) / (F.first("m") * (F.first("m") - 1))).alias("p")).agg(F.avg("p").alias("observed"), F.count("*").alias("units"))
    shares = sized.groupBy("v").agg(F.sum("n").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("expected"))
    kappa = F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return agree.crossJoin(shares).select(F.round(kappa, 6).alias("kappa"), "units")


def intraclass_correlation(ratings: DataFrame, *, unit: str, value: str) -> DataFrame:
    """(icc, units): one-way random-effects ICC(1) of units with at least two ratings, for unequal numbers of ratings."""
    per = ratings.where(F.col(value).isNotNull()).groupBy(F.col(unit).alias("u")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("v")).where("n > 1")
    grand = per.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    away = F.col("mean") - F.col("grand")
    total = per.crossJoin(F.broadcast(grand)).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * away * away).alias("means"), F.count("*").alias("units"))
    between = F.col("means") / (F.col("units") - 1)
    within = F.col("within") / (F.col("total") - F.col("units"))
    size = (F.col("total") - F.col("squares") / F.col("total")) / (F.col("units") - 1)
    spread = between + (size - 1) * within
    return total.select(F.round(F.when(spread == 0, 0.0).otherwise((between - within) / spread), 6).alias("icc"), "units")


def counters(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, and counters that are filled while it is read; no pass of its own."""
    observed = Observation(name)
    return df.observe(observed, *(F.count(F.when(c, 1)).alias(n) for n, c in counts.items())), observed
