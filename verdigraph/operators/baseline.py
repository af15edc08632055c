"""Baseline text classifiers: trained on one split, chosen on another, scored on a third.

``bayes`` is multinomial naive Bayes as DataFrame work: word counts per class, every smoothing of a grid
scored in one pass. ``logistic`` is logistic regression over words, by full gradient steps as aggregates, every
penalty of a grid in the same passes. ``fit_baseline`` is one over hashed words.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.scores import verdict
from verdigraph.functions.text import NOT_SPACE, collapse_ws, words
from verdigraph.operators.metrics import confusion, with_fractions
from verdigraph.session import cut_lineage


@dataclass
class Fitted:
    """The chosen model with the settings and validation result that chose it."""

    model: Transformer
    reg: float
    valid_bacc: float


def fit_baseline(
    train: DataFrame, valid: DataFrame, regs: Iterable[float] = (0.01, 0.1), features: int = 1 << 14, rounds: int = 10,
    text: str = "func", target: str = "target",
) -> Fitted:
    """Hashed word counts into logistic regression; best balanced accuracy wins, first on ties."""
    tokenizer = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=f"{NOT_SPACE}+", gaps=False)
    hashing = HashingTF(inputCol="_words", outputCol="features", numFeatures=features)

    def featurise(df: DataFrame) -> DataFrame:
        cleaned = df.select("idx", F.col(target).cast("double").alias("label"), collapse_ws(text).alias("_text"))
        return hashing.transform(tokenizer.transform(cleaned)).select("idx", "label", "features")

    seen = featurise(train).persist(StorageLevel.MEMORY_AND_DISK)
    held = featurise(valid).persist(StorageLevel.MEMORY_AND_DISK)
    best: Fitted | None = None
    try:
        for reg in regs:
            model = LogisticRegression(regParam=reg, maxIter=rounds, aggregationDepth=3).fit(seen)
            scored = model.transform(held).select(
                F.col("label").cast("int").alias("target"),
                verdict(vector_to_array("probability")[1]).alias("pred"),
            )
            bacc = with_fractions(confusion(scored)).select(F.nanvl("bacc", F.lit(0.0))).first()[0]
            if best is None or bacc > best.valid_bacc:
                best = Fitted(PipelineModel([tokenizer, hashing, model]), reg, bacc)
    finally:
        seen.unpersist()
        held.unpersist()
    if best is None:
        raise ValueError("no regularisation setting given")
    return best


def score_baseline(fitted: Fitted, df: DataFrame, text: str = "func", target: str = "target") -> DataFrame:
    """idx, target, score, pred."""
    cleaned = df.select("idx", F.col(target).alias("target"), collapse_ws(text).alias("_text"))
    score = vector_to_array("probability")[1]
    scored = fitted.model.transform(cleaned).select("idx", "target", score.alias("score"))
    return scored.withColumn("pred", verdict(F.col("score")))


def word_odds(train: DataFrame, alphas: Sequence[float], text: str = "func", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(token, o0, o1, ...) and one row (p): log-odds of class 1 of every training word for each smoothing, and the prior's."""
    each = train.select(F.col(target).alias("y"), F.explode(words(text)).alias("token"))

    def of(label: int):
        return F.count_if(F.col("y") == label)

    counts = each.groupBy("token").agg(of(0).alias("c0"), of(1).alias("c1"))
    totals = counts.agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), F.count(F.lit(1)).alias("v"))
    joined = counts.join(totals)  # totals is the one row of an aggregate
    odds = [
        (F.ln((F.col("c1") + a) / (F.col("t1") + a * F.col("v"))) - F.ln((F.col("c0") + a) / (F.col("t0") + a * F.col("v")))).alias(f"o{i}")
        for i, a in enumerate(map(float, alphas))
    ]
    prior = train.agg((F.ln(F.count_if(F.col(target) == 1)) - F.ln(F.count_if(F.col(target) == 0))).alias("p"))
    return joined.select("token", *odds), prior


def bayes_scores(odds: DataFrame, prior: DataFrame, df: DataFrame, n: int, text: str = "func", target: str = "target") -> DataFrame:
    """idx, target, s0, s1, ...: each text's log-odds under each smoothing; unseen words count nothing."""
    each = df.select("idx", F.col(target).alias("target"), F.explode_outer(words(text)).alias("token"))
    sums = [F.coalesce(F.sum(f"o{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(n)]
    summed = each.join(odds, "token", "left").groupBy("idx", "target").agg(*sums)
    return summed.select("idx", "target", *[F.round(F.col(f"s{i}") + prior.scalar(), 6).alias(f"s{i}") for i in range(n)])


def bayes(train: DataFrame, valid: DataFrame, test: DataFrame, alphas: Sequence[float] = (0.1, 1.0), text: str = "func", target: str = "target") -> DataFrame:
    """idx, target, score, pred, alpha, valid_bacc of the test texts, under the smoothing of best balanced accuracy.

    Ties go to the smoothing named first. A positive score is class 1.
    """
    odds, prior = word_odds(train, alphas, text, target)
    held = bayes_scores(odds, prior, valid, len(alphas), text, target)
    at, bacc = _best(held, len(alphas))
    tested = bayes_scores(odds, prior, test, len(alphas), text, target).select("idx", "target", F.col(f"s{at}").alias("score"))
    return _judged(tested).withColumns({"alpha": F.lit(float(alphas[at])), "valid_bacc": F.lit(bacc)})


def _best(held: DataFrame, n: int) -> tuple[int, float]:
    """Which of the scores s0, s1, ... of labelled texts has the best balanced accuracy, the first on ties, and that value."""
    tried = held.select("target", F.posexplode(F.array(*[F.col(f"s{i}") for i in range(n)])).alias("i", "s"))
    judged = confusion(tried.withColumn("pred", (F.col("s") > 0).cast("int")), ["i"])
    ranked = with_fractions(judged).select("i", F.round(F.nanvl("bacc", F.lit(0.0)), 9).alias("bacc"))
    best = ranked.agg(F.max(F.struct("bacc", (-F.col("i")).alias("i"))).alias("b")).select("b.*").first()
    if best is None or best["i"] is None:
        raise ValueError("no texts to choose a setting on")
    return -best["i"], best["bacc"]


def _judged(scored: DataFrame) -> DataFrame:
    return scored.withColumn("pred", (F.col("score") > 0).cast("int"))


BIAS = ""  # no word is empty


def word_lists(df: DataFrame, text: str = "func", target: str = "target") -> DataFrame:
    """idx, target, tokens (the bias and the distinct words) and x, the value of each word: 1 / sqrt of their number."""
    found = F.array_distinct(F.coalesce(words(text), F.array().cast("array<string>")))
    listed = df.select("idx", F.col(target).alias("target"), found.alias("_words"))
    x = F.lit(1.0) / F.sqrt(F.greatest(F.size("_words"), F.lit(1)).cast("double"))
    return listed.select("idx", "target", F.concat(F.array(F.lit(BIAS)), "_words").alias("tokens"), x.alias("x"))


def _value() -> Column:
    return F.when(F.col("token") == BIAS, 1.0).otherwise(F.col("x"))


def margins(lists: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """idx, m0, m1, ...: each text's sum of weighted words under each setting; unknown words count nothing."""
    each = lists.select("idx", "x", F.explode("tokens").alias("token"))
    sums = [F.coalesce(F.sum(F.col(f"w{i}") * _value()), F.lit(0.0)).alias(f"m{i}") for i in range(n)]
    return each.join(weights, "token", "left").groupBy("idx").agg(*sums)


def logistic_weights(train: DataFrame, penalties: Sequence[float], rounds: int, rate: float) -> DataFrame:
    """token, w0, w1, ...: weights after ``rounds`` full gradient steps from zero, one column a penalty.

    ``train`` as from :func:`word_lists`, idx unique. Both classes weigh the same in the loss. A step is two
    aggregates: margins by text, and residuals by word, which come together before they are sent. What is carried
    from step to step is one row a word.
    """
    sizes = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == 1).alias("n1"))
    own = F.when(F.col("target") == 1, F.col("n1")).otherwise(F.col("n") - F.col("n1"))
    # Of one text's residual: half the rows by the rows of its class, over all rows.
    docs = cut_lineage(train.join(sizes).select("idx", F.col("target").cast("double").alias("y"), "tokens", "x", (0.5 / own).alias("_share")))
    weights: DataFrame | None = None
    for _ in range(rounds):
        if weights is None:
            held = docs.withColumns({f"m{i}": F.lit(0.0) for i in range(len(penalties))})
        else:
            held = docs.join(margins(docs, weights, len(penalties)), "idx")
        rest = [((F.lit(1.0) / (F.exp(-F.col(f"m{i}")) + 1.0) - F.col("y")) * F.col("_share")).alias(f"r{i}") for i in range(len(penalties))]
        each = held.select("x", F.explode("tokens").alias("token"), *rest)
        slopes = each.groupBy("token").agg(*[F.sum(F.col(f"r{i}") * _value()).alias(f"g{i}") for i in range(len(penalties))])
        if weights is None:
            stepped = [(F.col(f"g{i}") * -rate).alias(f"w{i}") for i in range(len(penalties))]
        else:  # every word of the training texts has a slope and a weight
            slopes = slopes.join(weights, "token")
            stepped = [(F.col(f"w{i}") * (1.0 - rate * p) - F.col(f"g{i}") * rate).alias(f"w{i}") for i, p in enumerate(penalties)]
        weights = cut_lineage(slopes.select("token", *stepped))
    if weights is None:
        raise ValueError("at least one round")
    return weights


def logistic(
    train: DataFrame, valid: DataFrame, test: DataFrame, penalties: Sequence[float] = (0.0, 0.01), rounds: int = 6, rate: float = 4.0,
    text: str = "func", target: str = "target",
) -> DataFrame:
    """idx, target, score, pred, penalty, valid_bacc of the test texts, under the penalty of best balanced accuracy.

    Words count once a text. Ties go to the penalty named first; a positive score is class 1.
    """
    penalties = [float(p) for p in penalties]
    weights = logistic_weights(word_lists(train, text, target), penalties, rounds, float(rate))

    def scores(df: DataFrame) -> DataFrame:
        rows = df.select("idx", F.col(target).alias("target"))
        shown = [F.round(f"m{i}", 6).alias(f"s{i}") for i in range(len(penalties))]
        return rows.join(margins(word_lists(df, text, target), weights, len(penalties)), "idx").select("idx", "target", *shown)

    at, bacc = _best(scores(valid), len(penalties))
    tested = scores(test).select("idx", "target", F.col(f"s{at}").alias("score"))
    return _judged(tested).withColumns({"penalty": F.lit(penalties[at]), "valid_bacc": F.lit(bacc)})
