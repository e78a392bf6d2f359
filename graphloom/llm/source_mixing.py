"""Mixing sources to target weights by entropy balancing.

Among all rates that meet the constraints (tokens of each source, and of each language, as shares of the whole), the ones
nearest to uniform in relative entropy are r = exp(l[source] + m[language]). The multipliers minimise the convex dual
sum(tokens * exp(l + m)) - sum(target * multiplier); Newton's method with backtracking finds them. Tokens are summed over all documents
once, by source and language; dual, gradient and Hessian depend on these sums alone. Each iteration is a distributed aggregation of
that table (tokens at the present rates) of which the driver sees a row per pair that occurs, and solves a system of as many
unknowns as there are sources and languages; it is dense, so sources should number thousands, not millions. Rates are then scaled so that the smallest
is `least`, and rounded into copies: the whole part, and one more where a hash of the document falls below the fraction.

Targets default to the present shares to the power `temper`, for sources and languages alike. A source or language without
tokens, or without a target, keeps its relative rate (multiplier 0). Null sources and languages count as a source and a language
of their own. Null, empty and blank texts have no tokens; they get their pair's rate, or `least` if the pair has no
tokens. Repeated ids with equal texts round alike. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut

TEMPER = 0.7
LEAST = 1.0
TOLERANCE = 1e-9
MOST_STEPS = 100
TOKEN = r"\S+"
#: Rows up to which a table of multipliers or rates is broadcast; larger ones are joined by shuffling.
BROADCAST = 100_000


def weighed(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    return documents.select(
        F.col(id).alias("i"), F.xxhash64(id, text).alias("h"), F.col(source).cast("string").alias("s"), F.col(lang).cast("string").alias("l"), F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long").alias("n")
    )


def targets(tokens: dict, temper: float = TEMPER) -> dict:
    """Shares to the power temper, normalised."""
    total = sum(tokens.values())
    power = {k: (n / total) ** temper for k, n in tokens.items() if n > 0}
    return {k: p / sum(power.values()) for k, p in power.items()}


def summed(rows: DataFrame) -> DataFrame:
    """(s, l, n): the tokens of each source and language that has any."""
    return cut(rows.groupBy("s", "l").agg(F.sum("n").cast("double").alias("n")).where("n > 0"))


def multipliers(pairs: DataFrame, by_source: dict | None = None, by_lang: dict | None = None, temper: float = TEMPER) -> tuple[dict, dict]:
    """Logarithms of the rates by source and by language, for summed tokens (s, l, n); their total stays as it is.

    Raises ValueError if the targets can't be met together: not within TOLERANCE after MOST_STEPS.
    """
    spark = pairs.sparkSession
    now = pairs.collect()
    if not now:
        return {}, {}
    total = sum(x["n"] for x in now)
    margins: list[dict] = [{}, {}]
    for x in now:
        for m, k in zip(margins, (x["s"], x["l"]), strict=True):
            m[k] = m.get(k, 0.0) + x["n"]
    goals = [targets(m, temper) if g is None else {k: v for k, v in g.items() if k in m} for g, m in zip((by_source, by_lang), margins, strict=True)]
    goals = [{k: v / sum(g.values()) * sum(m[k] for k in g) / total for k, v in g.items()} if g else {} for g, m in zip(goals, margins, strict=True)]
    names = [(0, k) for k in sorted(goals[0], key=str)] + [(1, k) for k in sorted(goals[1], key=str)]
    place = {k: j for j, k in enumerate(names)}
    goal = np.array([goals[a][k] for a, k in names])
    x = np.zeros(len(names))

    def state(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual, gradient and Hessian at x, from tokens summed at its rates."""
        frame = pairs
        for side, column in ((0, "s"), (1, "l")):
            own = [(k, float(x[j])) for (a, k), j in place.items() if a == side]
            table = spark.createDataFrame(own, f"_k{side} string, _x{side} double")
            frame = frame.join(F.broadcast(table) if len(own) < BROADCAST else table, F.col(column).eqNullSafe(F.col(f"_k{side}")), "left")
        tilted = frame.groupBy("s", "l").agg((F.sum(F.col("n") * F.exp(F.coalesce("_x0", F.lit(0.0)) + F.coalesce("_x1", F.lit(0.0)))) / total).alias("w")).collect()
        gradient, hessian, value = -goal.copy(), np.zeros((len(x), len(x))), -float(goal @ x)
        for row in tilted:
            own = [place[k] for k in ((0, row["s"]), (1, row["l"])) if k in place]
            w = row["w"]
            value += w
            for j in own:
                gradient[j] += w
                for k in own:
                    hessian[j, k] += w
        return value, gradient, hessian

    value, gradient, hessian = state(x)
    for _ in range(MOST_STEPS):
        if np.abs(gradient).max(initial=0) < TOLERANCE:
            return {k: x[j] for (a, k), j in place.items() if a == 0}, {k: x[j] for (a, k), j in place.items() if a == 1}
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        size = 1.0
        while True:
            to = x - size * step
            new = state(to)
            if new[0] <= value - 1e-4 * size * float(gradient @ step) + 1e-14 or size < 1e-6:
                break
            size /= 2
        x, (value, gradient, hessian) = to, new
    raise ValueError(f"the targets can't be met together: they are missed by {np.abs(gradient).max():.2g} of all tokens")


def _pairs(rows: DataFrame, by_source: dict | None, by_lang: dict | None, temper: float, least: float) -> DataFrame:
    """Source, language and rate of each pair that has tokens; broadcast unless there are too many."""
    sums = summed(rows)
    of_source, of_lang = multipliers(sums, by_source, by_lang, temper)
    pairs = [(x["s"], x["l"], of_source.get(x["s"], 0.0) + of_lang.get(x["l"], 0.0)) for x in sums.collect()]
    lowest = min((x for _, _, x in pairs), default=0.0)
    table = rows.sparkSession.createDataFrame([(s, m, float(np.exp(x - lowest) * least)) for s, m, x in pairs], "__graphloom_s string, __graphloom_l string, __graphloom_rate double")
    return F.broadcast(table) if len(pairs) < BROADCAST else table


def _copies(rate: Column, key: Column) -> Column:
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(17)), 11).cast("double") / F.lit(float(1 << 53))
    return F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")


def mixed(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", by_source: dict | None = None, by_lang: dict | None = None, temper: float = TEMPER, least: float = LEAST) -> DataFrame:
    """A row per document: id, source, lang, tokens, rate, copies."""
    rows = cut(weighed(documents, id, text, source, lang))
    pairs = _pairs(rows, by_source, by_lang, temper, least)
    rate = F.round(F.coalesce("__graphloom_rate", F.lit(float(least))), 9)
    rated = rows.join(pairs, F.col("s").eqNullSafe(F.col("__graphloom_s")) & F.col("l").eqNullSafe(F.col("__graphloom_l")), "left")
    return rated.select(F.col("i").alias(id), F.col("s").alias(source), F.col("l").alias(lang), F.col("n").alias("tokens"), rate.alias("rate"), _copies(rate, F.col("h")).alias("copies"))


def weighted(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", by_source: dict | None = None, by_lang: dict | None = None, temper: float = TEMPER, least: float = LEAST) -> DataFrame:
    """The documents that get a copy, with their own columns, and mix_rate and mix_copies (which replace columns of those names)."""
    pairs = _pairs(weighed(documents, id, text, source, lang), by_source, by_lang, temper, least)
    rate = F.round(F.coalesce("__graphloom_rate", F.lit(float(least))), 9)
    rated = documents.join(pairs, F.col(source).cast("string").eqNullSafe(F.col("__graphloom_s")) & F.col(lang).cast("string").eqNullSafe(F.col("__graphloom_l")), "left")
    key = F.xxhash64(id, text)
    return rated.withColumns({"mix_rate": rate, "mix_copies": _copies(rate, key)}).drop("__graphloom_s", "__graphloom_l", "__graphloom_rate").where("mix_copies > 0")
