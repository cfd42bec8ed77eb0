"""Sampling filters over logits: rows (row, token, logit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let


def repetition_penalty(logits: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Positive logits of seen tokens are divided, negative ones multiplied, once per token."""
    hit = seen.select("row", "token", F.lit(True).alias("__seen")).distinct()
    new = F.when(F.col("__seen") & (F.col("logit") > 0), F.col("logit") / penalty).when(F.col("__seen"), F.col("logit") * penalty).otherwise(F.col("logit"))
    return logits.join(hit, ["row", "token"], "left").withColumn("logit", new).drop("__seen")


def temperature(logits: DataFrame, t: float) -> DataFrame:
    """Divide by ``t``; at 0 only the largest logit (of several the lowest token) stays."""
    if t == 0:
        return logits.groupBy("row").agg(F.min(F.struct((-F.col("logit")).alias("l"), "token")).alias("m")).select("row", "m.token", (-F.col("m.l")).alias("logit"))
    return logits.withColumn("logit", F.col("logit") / t)


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Logits not below the k-th largest: ties stay; k <= 0 keeps all."""
    if k <= 0:
        return logits
    rank = F.rank().over(Window.partitionBy("row").orderBy(F.desc("logit")))
    return logits.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def softmax(logits: DataFrame) -> DataFrame:
    w = Window.partitionBy("row")
    e = F.exp(F.col("logit") - F.max("logit").over(w))
    return logits.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def top_p(logits: DataFrame, p: float) -> DataFrame:
    """Tokens whose strictly earlier probability mass is below ``p``; the top one always stays."""
    before = Window.partitionBy("row").orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, -1)
    mass = F.coalesce(F.sum("p").over(before), F.lit(0.0))
    return softmax(logits).withColumn("__m", F.round(mass, 12)).where((F.col("__m") < p) | (F.col("__m") == 0)).drop("__m")


def best_prefix(words: DataFrame, cap: float, cost: float) -> DataFrame:
    """Rows (utt, pos, weight, log_p) to (utt, k): argmax of sum(weight * min(exp(log_p), cap)) - cost * k; 0 scores 0.

    Null and NaN count as nothing; of equal scores the smallest k wins.
    """
    gain = F.when(F.col("log_p").isNull() | F.isnan("log_p"), 0.0).otherwise(F.col("weight") * F.least(F.exp("log_p"), F.lit(cap)))
    upto = Window.partitionBy("utt").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = words.withColumn("k", F.row_number().over(Window.partitionBy("utt").orderBy("pos"))).withColumn("score", F.round(F.sum(gain).over(upto) - cost * F.col("k"), 9))
    best = scored.groupBy("utt").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
    return best.select("utt", F.when(F.col("b.score") > 0, -F.col("b.k")).otherwise(0).alias("k"))


def sample(logits: DataFrame, draws: DataFrame, seen: DataFrame | None = None, penalty: float = 1.0, t: float = 1.0, k: int = 0, p: float = 1.0) -> DataFrame:
    """Rows (row, token): penalty, temperature, top-k, top-p, softmax, then the token at which the cumulated probability
    passes the row's draw (row, u in [0, 1)), largest logits first; temperature 0 takes the largest after the penalty."""
    rows = logits if seen is None or penalty == 1.0 else repetition_penalty(logits, seen, penalty)
    rows = temperature(rows, t)
    if t == 0:
        return rows.select("row", "token")
    rows = top_k(rows, k)
    rows = softmax(top_p(rows, p).select("row", "token", "logit") if p < 1 else rows)
    upto = Window.partitionBy("row").orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, 0)
    reached = rows.withColumn("__c", F.sum("p").over(upto)).join(draws.select("row", "u"), "row")
    pick = F.struct((F.col("__c") <= F.col("u")).alias("before"), F.when(F.col("__c") > F.col("u"), F.col("__c")).otherwise(-F.col("__c")).alias("c"), "token")
    return reached.groupBy("row").agg(F.min(pick).alias("b")).select("row", "b.token")


# ---------------------------------------------------------------- the same rules on arrays, a row at a time


def penalize_array(logits: Column, seen: Column, penalty: float) -> Column:
    """``repetition_penalty`` of an array of logits by token; ``seen`` is an array of tokens."""
    return F.transform(logits, lambda x, i: F.when(~F.array_contains(seen, i), x).when(x > 0, x / penalty).otherwise(x * penalty))


def top_k_array(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become -inf; ties stay."""
    least = F.get(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)) - 1)
    return let(least, lambda least: F.transform(logits, lambda x: F.when(x >= least, x).otherwise(F.lit(float("-inf"))))) if k > 0 else logits


def softmax_array(logits: Column) -> Column:
    share = lambda exps: let(F.aggregate(exps, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(exps, lambda x: x / total))
    return let(F.array_max(logits), lambda top: let(F.transform(logits, lambda x: F.exp(x - top)), share))


def top_p_array(logits: Column, p: float) -> Column:
    """Logits whose strictly earlier probability mass reaches ``p`` become -inf; the largest always stays."""
    both = F.arrays_zip(softmax_array(logits).alias("p"), F.sequence(F.lit(0), F.size(logits) - 1).alias("i"))
    ordered = F.array_sort(both, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["i"] < b["i"], -1).otherwise(1))
    start = F.struct(F.lit(0.0).alias("mass"), F.expr("cast(array() as array<int>)").alias("kept"))
    step = lambda s, x: F.struct((s["mass"] + x["p"]).alias("mass"), F.when(F.round(s["mass"], 12) < p, F.concat(s["kept"], F.array(x["i"]))).when(F.size(s["kept"]) == 0, F.array(x["i"])).otherwise(s["kept"]).alias("kept"))
    kept = F.aggregate(ordered, start, step, lambda s: s["kept"])
    return let(kept, lambda kept: F.transform(logits, lambda x, i: F.when(F.array_contains(kept, i), x).otherwise(F.lit(float("-inf")))))


def argmax_array(logits: Column) -> Column:
    """The token of the largest logit, of several the lowest."""
    return F.array_position(logits, F.array_max(logits)) - 1
