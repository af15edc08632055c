"""Losses over tables of scores, logits and paired vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.scores import binary_log_loss, class_nll, dot

# The guard in a mean over links, the smallest norm product, the hidden cell's score.
MEAN_GUARD = 1e-10
NORM_FLOOR = 1e-8
HIDDEN = -1e9


def log_loss(
    df: DataFrame, score: str = "score", label: str = "target",
    weights: tuple[float, float] | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Plain mean of the (class-weighted) binary log loss."""
    return df.groupBy(*by).agg(F.avg(binary_log_loss(F.col(score), F.col(label), weights)).alias("loss"))


def cross_entropy(
    df: DataFrame, logits: str = "logits", label: str = "target",
    weights: Sequence[float] | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Softmax cross-entropy; with class weights the mean divides by the weights' sum."""
    return cross_entropies(df, {"loss": weights}, logits, label, by)


def cross_entropies(
    df: DataFrame, weights: Mapping[str, Sequence[float] | None], logits: str = "logits", label: str = "target", by: Sequence[str] = ()
) -> DataFrame:
    """Several weightings of the cross-entropy in one pass, each under its name."""
    at = F.col(label).cast("int") + 1
    own = {n: F.lit(1.0) if w is None else F.element_at(F.array(*[F.lit(float(x)) for x in w]), at) for n, w in weights.items()}
    weighed = df.select(*by, class_nll(F.col(logits), F.col(label)).alias("_nll"), *[c.alias(f"_w_{n}") for n, c in own.items()])
    return weighed.groupBy(*by).agg(*[(F.sum(F.col(f"_w_{n}") * F.col("_nll")) / F.sum(f"_w_{n}")).alias(n) for n in own])


def batch_mean_loss(df: DataFrame, loss: str = "loss", batch: str = "batch", by: Sequence[str] = ()) -> DataFrame:
    """Mean of batch means: a short last batch weighs as much as a full one."""
    per_batch = df.groupBy(*by, batch).agg(F.avg(loss).alias("_mean"))
    return per_batch.groupBy(*by).agg(F.avg("_mean").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def to_groups(
    df: DataFrame, group_size: int, group: str = "group", pos: str = "pos", first: str = "view1", second: str = "view2", short: bool = False
) -> DataFrame:
    """One row per group of exactly ``group_size`` members: arrays of both views by position.

    Every member fills the slot of its position, so a group row never outgrows ``group_size``.
    A position outside the group, or a missing or repeated one, is an error. With ``short`` positions may be
    missing: the arrays hold the members there are, and ``slots`` their positions.
    """
    slot = F.col(pos)

    def filled(name: str) -> Column:
        return F.array(*[F.max_by(F.when(slot == i, F.col(name)), (slot == i)) for i in range(group_size)])

    def present(name: str) -> Column:
        return F.transform("slots", lambda i: F.get(name, i))

    complete = (F.count(F.lit(1)) == group_size) & (F.count_if((slot >= 0) & (slot < group_size)) == group_size)
    if short:
        complete = F.count(F.lit(1)) == F.count_if((slot >= 0) & (slot < group_size))
    for i in range(group_size):
        complete = complete & (F.count_if(slot == i) <= 1 if short else F.count_if(slot == i) == 1)
    held = F.array_compact(F.array(*[F.when(F.count_if(slot == i) > 0, i) for i in range(group_size)]))
    wrong = F.raise_error(F.lit(f"a group needs each position below {group_size} {'at most ' if short else ''}once"))
    grouped = df.groupBy(group).agg(
        filled(first).alias("firsts"), filled(second).alias("seconds"), complete.alias("_complete"), *([held.alias("slots")] if short else [])
    )
    if short:
        grouped = grouped.withColumns({name: present(name) for name in ("firsts", "seconds")})
    return grouped.withColumn("firsts", F.when(F.col("_complete"), F.col("firsts")).otherwise(wrong)).drop("_complete")


def group_cosine(groups: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Each member's cosine with every member's second view, as one array by position, or by ``slots`` where groups have them."""
    rows = groups.select("*", F.posexplode("firsts").alias("row", "_view"))

    def scaled(other: Column) -> Column:
        mine = F.col("_view")
        norms = F.greatest(F.sqrt(dot(mine, mine) * dot(other, other)), F.lit(NORM_FLOOR))
        return dot(mine, other) / norms / F.lit(float(temperature))

    if "slots" not in groups.columns:
        return rows.select("group", "row", F.transform("seconds", scaled).alias("sims"))
    return rows.select("group", F.get("slots", F.col("row")).alias("row"), "slots", F.transform("seconds", scaled).alias("sims"))


def contrastive_loss(sims: DataFrame, mask: bool = False) -> DataFrame:
    """Mean cross-entropy of each member against its own position in its row of similarities.

    The masked form keeps only the diagonal, the first row and the first column. ``slots`` gives the positions of the
    similarities where a group lacks some.
    """
    row = F.col("row")
    seen = F.col("sims")
    short = "slots" in sims.columns
    if mask:

        def shown(s: Column, k: Column) -> Column:
            j = F.get("slots", k) if short else k
            return F.when((row == j) | (row == 0) | (j == 0), s).otherwise(F.lit(HIDDEN))

        seen = F.transform(seen, shown)
    kept = sims.withColumn("_seen", seen)
    own = F.array_position("slots", row) - 1 if short else row
    return kept.agg(F.avg(class_nll(F.col("_seen"), own)).alias("loss"), F.count(F.lit(1)).alias("n_rows"))


def check_eos(df: DataFrame, eos: int, ids: str = "input_ids", strict: bool = False) -> DataFrame:
    """Fewest and most EOS ids over all rows, and whether they agree; ``strict`` raises if not."""
    count = F.size(F.filter(ids, lambda x: x == eos))
    found = df.agg(F.min(count).alias("fewest"), F.max(count).alias("most")).withColumn(
        "uniform", F.col("fewest") == F.col("most")
    )
    if strict:
        error = F.raise_error(F.lit("all examples must have the same number of EOS ids"))
        found = found.withColumn("uniform", F.when(F.col("uniform"), F.lit(True)).otherwise(error))
    return found


def pool_vectors(
    links: DataFrame, vectors: DataFrame, node: Sequence[str] = ("idx", "node"), token: Sequence[str] = ("idx", "token")
) -> DataFrame:
    """Per node, the sum of its linked tokens' vectors over (their number + a guard).

    The vector sum is a partial aggregate: nothing is exploded per dimension and nothing collected.
    """
    met = links.join(vectors, list(token)).withColumn("_vec", array_to_vector(F.col("vector").cast("array<double>")))
    summed = met.groupBy(*node).agg(
        Summarizer.sum(F.col("_vec")).alias("_sum"), F.count(F.lit(1)).alias("n_tokens")
    )
    guarded = F.col("n_tokens").cast("double") + F.lit(MEAN_GUARD)
    return summed.select(
        *node, "n_tokens", F.transform(vector_to_array("_sum"), lambda x: x / guarded).alias("vector")
    )
