"""Mixing sources to target weights, with DataFrame functions only.

Documents are counted into cells (source, language, topic).  Iterative proportional fitting rakes the
cells' tokens until every marginal has its target share; the cell's factor, scaled to the token
budget, is the rate at which its documents are taken.  With a highest rate the cells are raked inside
that bound, to the targets as far as their tokens reach.  Cells are few and bounded by the values of the
three columns, not by the documents; sums over a value are pre-aggregated, so no value gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import stored

DIMS = ("source", "lang", "topic")
NONE = "(none)"
ROUNDS = 20
TOLERANCE = 1e-12
#: Cells that a join may broadcast: a few short columns each.
FEW_CELLS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """A plain genre mark by what a text holds; the first that applies."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains("License") | t.contains("license"), "licensed").when(t.contains("@"), "contact")
        .when(t.contains("!!"), "shouting").when(F.length(t) < 600, "short").otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(value, target): shares of tokens raised to ``power`` and rescaled to sum to one."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("s"))
    raised = sums.select("value", F.pow("s", F.lit(power)).alias("p"))
    total = raised.agg(F.sum("p").alias("all"))
    return raised.join(F.broadcast(total)).select("value", F.when(F.col("all") > 0, F.col("p") / F.col("all")).otherwise(0.0).alias("target"))  # one row


def stated(cells: DataFrame, dim: str, weights: dict[str, float]) -> DataFrame:
    """(value, target) from given weights; values without one share the weight of ``None`` by their tokens.

    Weights of values that hold no tokens go to the others in proportion.
    """
    given = {k: float(v) for k, v in weights.items() if k is not None}
    rest = float(weights.get(None, 0.0))
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("s"))
    weight = None
    for k, v in given.items():
        weight = F.when(F.col("value") == k, F.lit(v)) if weight is None else weight.when(F.col("value") == k, F.lit(v))
    marked = sums.withColumn("w", weight if weight is not None else F.lit(None).cast("double"))
    free = marked.agg(
        F.sum(F.when(F.col("w").isNull(), F.col("s"))).alias("free"), F.sum(F.when(F.col("s") > 0, F.col("w"))).alias("named")
    )
    share = F.when(F.col("s") <= 0, 0.0).otherwise(F.coalesce("w", F.lit(rest) * F.col("s") / F.col("free")))
    scale = F.coalesce("named", F.lit(0.0)) + F.when(F.coalesce("free", F.lit(0.0)) > 0, F.lit(rest)).otherwise(0.0)
    return marked.join(F.broadcast(free)).select("value", F.when(scale > 0, share / scale).otherwise(0.0).alias("target"))  # one row


def label(docs: DataFrame, topic_of=topic, text: str = "text") -> DataFrame:
    """doc_id, the three dims (null becomes ``(none)``) and n_tokens of every document."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), name("source"), name("lang"), topic_of(F.col(text)).alias("topic"), tokens(F.col(text)).alias("n_tokens")
    )


def cells_of(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` plus ``factor``: tokens * factor has every target share (or the nearest that the cells allow).

    Each round scales the factor by target / present share for one dim after the other and is written
    before the next, so the plan stays short.  It ends when no share is off by more than
    ``tolerance`` or after ``rounds``.
    """
    for dim in DIMS:
        cells = cells.join(targets[dim].select(F.col("value").alias(dim), F.col("target").alias(f"t_{dim}")), dim, "left").fillna(0.0, [f"t_{dim}"])
    # shares of all tokens; only ratios matter, so the sum of tokens scales out
    state = kept = stored(cells.withColumn("factor", F.lit(1.0)), "cells")
    for _ in range(rounds):
        total = state.agg(F.sum(F.col("tokens") * F.col("factor")).alias("all")).first()["all"] or 0.0  # one number
        if total <= 0:
            break
        step, gaps = state.withColumn("gap", F.lit(0.0)), F.col("gap")
        for dim in DIMS:
            now = step.groupBy(dim).agg((F.sum(F.col("tokens") * F.col("factor")) / F.lit(float(total))).alias("share"))
            gaps = F.greatest(F.col("gap"), F.abs(F.coalesce(F.col("share"), F.lit(0.0)) - F.col(f"t_{dim}")))
            factor = F.when(F.col("share") > 0, F.col("factor") * F.col(f"t_{dim}") / F.col("share")).otherwise(F.col("factor"))
            step = step.join(now, dim).withColumn("gap", gaps).withColumn("factor", factor).drop("share")
        state = kept = stored(step, "cells", replaces=kept.folder)
        worst = state.agg(F.max("gap").alias("gap")).first()["gap"]
        state = state.drop("gap")
        if worst is None or worst <= tolerance:
            break
    return state


def rates(raked: DataFrame, budget: float, max_rate: float | None) -> DataFrame:
    """``raked`` plus ``rate``: expected copies of each document of the cell, for ``budget`` of all tokens.

    With ``max_rate`` no document is taken more often; what a capped cell cannot give is asked of the
    others in proportion, as long as there are any.
    """
    sums = raked.agg(F.sum("tokens").cast("double").alias("t"), F.sum(F.col("tokens") * F.col("factor")).alias("w")).first()
    total, weight = sums["t"] or 0.0, sums["w"] or 0.0
    scale = budget * total / weight if weight > 0 else 0.0
    if max_rate is not None and weight > 0:
        while True:  # the scale only grows, and each step caps at least one cell more
            capped = F.col("factor") * F.lit(scale) >= F.lit(max_rate)
            s = raked.agg(
                F.sum(F.when(capped, F.col("tokens") * F.lit(max_rate))).alias("full"), F.sum(F.when(~capped, F.col("tokens") * F.col("factor"))).alias("open")
            ).first()
            full, open_ = s["full"] or 0.0, s["open"] or 0.0
            if open_ <= 0 or budget * total <= full:
                break
            new = (budget * total - full) / open_
            if new <= scale * (1 + 1e-9):
                break
            scale = new
    rate = F.col("factor") * F.lit(float(scale))
    return raked.withColumn("rate", rate if max_rate is None else F.least(rate, F.lit(float(max_rate))))


def within(cells: DataFrame, dim: str, target: DataFrame, budget: float, max_rate: float) -> DataFrame:
    """(value, target) that the tokens can give when ``budget`` of them is taken and none more often than ``max_rate``.

    A value that holds too little gives all it has; what it lacks is asked of the others in proportion to their targets.
    """
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
    total = sums.agg(F.sum("tokens").alias("all")).first()["all"] or 0.0  # one number
    spent = min(budget, max_rate) * total
    if spent <= 0:
        return target
    free = F.when(F.col("tokens") > 0, F.col("target") * F.lit(float(total)) / F.col("tokens")).otherwise(0.0)
    rated = rates(sums.join(target, "value").withColumn("factor", free), budget, max_rate)
    return rated.select("value", (F.col("rate") * F.col("tokens") / F.lit(float(spent))).alias("target"))


def rake_within(cells: DataFrame, targets: dict[str, DataFrame], budget: float, max_rate: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Like :func:`rake` for ``budget`` of the tokens, with no factor above ``max_rate`` taking part.

    A step for a dim scales the factors of a value so that its capped cells, taken at ``max_rate``,
    and its open ones reach the target together; what a capped cell cannot give comes from cells of
    the same value as long as there are any.  Targets that the tokens cannot give are those of :func:`within`.
    """
    cells = stored(cells, "cells")
    for dim in DIMS:
        reached = within(cells, dim, targets[dim], budget, max_rate).select(F.col("value").alias(dim), F.col("target").alias(f"t_{dim}"))
        cells = stored(cells.join(reached, dim, "left").fillna(0.0, [f"t_{dim}"]), "cells", replaces=cells.folder)
    total = cells.agg(F.sum("tokens").alias("all")).first()["all"] or 0  # one number
    spent, most = float(min(budget, max_rate) * total), F.lit(float(max_rate))
    state = kept = stored(cells.withColumn("factor", F.lit(float(min(budget, max_rate)))), "cells", replaces=cells.folder)
    if spent <= 0:
        return state
    capped, has = F.col("factor") >= most, F.col("tokens") > 0
    for _ in range(rounds):
        step = state.withColumn("gap", F.lit(0.0))
        for dim in DIMS:
            now = step.groupBy(dim).agg(
                F.coalesce(F.sum(F.when(capped, F.col("tokens") * most)), F.lit(0.0)).alias("full"),
                F.coalesce(F.sum(F.when(~capped & has, F.col("tokens") * F.col("factor"))), F.lit(0.0)).alias("open"),
            )
            need, full, open_ = F.col(f"t_{dim}") * F.lit(spent), F.col("full"), F.col("open")
            by = F.when((open_ > 0) & (need > full), (need - full) / open_).when((full + open_ > 0) & (need < full + open_), need / (full + open_)).otherwise(1.0)
            gap = F.greatest(F.col("gap"), F.abs(full + open_ - need) / F.lit(spent))
            step = step.join(now, dim).withColumn("gap", gap).withColumn("factor", F.col("factor") * by).drop("full", "open")
        state = kept = stored(step, "cells", replaces=kept.folder)
        worst = state.agg(F.max("gap").alias("gap")).first()["gap"]
        state = state.drop("gap")
        if worst is None or worst <= tolerance:
            break
    return state


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone, so a repeated task draws the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _rated(labelled: DataFrame, lang_weights, source_power, topic_power, budget, max_rate, rounds) -> DataFrame:
    """Cells with their rate."""
    cells = stored(cells_of(labelled), "cells")
    targets = {
        "source": tempered(cells, "source", source_power), "topic": tempered(cells, "topic", topic_power),
        "lang": tempered(cells, "lang", 0.7) if lang_weights is None else stated(cells, "lang", lang_weights),
    }
    raked = rake(cells, targets, rounds) if max_rate is None else rake_within(cells, targets, budget, max_rate, rounds)
    rated = stored(rates(raked, budget, max_rate).select(*DIMS, F.round("rate", 6).alias("rate")), "rates")
    return F.broadcast(rated) if rated.count() <= FEW_CELLS else rated  # counted; beyond that an ordinary join


def _copies(seed: int) -> Column:
    whole = F.floor("rate")
    return (whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")).cast("long")


def sample_rates(
    docs: DataFrame, lang_weights: dict | None = None, source_power: float = 0.5, topic_power: float = 0.7, budget: float = 1.0,
    max_rate: float | None = None, seed: int = 11, rounds: int = ROUNDS, topic_of=topic,
) -> DataFrame:
    """Every document with its cell's rate and the copies it is taken: doc_id, source, lang, topic, n_tokens, rate, copies.

    ``copies`` is the whole part of the rate plus one with the probability of the rest.  Null source
    or lang is a value of its own, ``(none)``; empty and null texts have no tokens and the rate of
    their cell; rows that repeat draw alike; no rows give no rows; other columns are ignored.
    """
    labelled = label(docs, topic_of)
    rated = _rated(labelled, lang_weights, source_power, topic_power, budget, max_rate, rounds)
    return labelled.join(rated, list(DIMS)).select("doc_id", *DIMS, "n_tokens", "rate", _copies(seed).alias("copies"))


def sampled(
    docs: DataFrame, lang_weights: dict | None = None, source_power: float = 0.5, topic_power: float = 0.7, budget: float = 1.0,
    max_rate: float | None = None, seed: int = 11, rounds: int = ROUNDS, topic_of=topic,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as :func:`sample_rates` takes them."""
    rated = _rated(label(docs, topic_of), lang_weights, source_power, topic_power, budget, max_rate, rounds)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), name("source").alias("source"), name("lang").alias("lang"), topic_of(F.col("text")).alias("topic"))
    taken = whole.join(rated, list(DIMS)).withColumn("_n", _copies(seed)).where("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")
