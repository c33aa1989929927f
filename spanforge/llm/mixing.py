"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source x language x topic. The tokens of the cells are raked until their marginals meet
the targets; a document is then sampled with its cell's calibrated probability, decided by a hash of its id.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import words_of

DIMS = ("source", "lang", "topic")
MAX_CELLS = 1_000_000  # bound of the contingency table that comes to the driver
TEMPER = 0.7  # default targets: a category's share to this power, so that large ones shrink
BUDGET = 0.8  # share of all tokens that a sample aims at, by default; the largest that meets the targets bounds it
MET = 1e-6  # marginals this near their targets meet them

_SCALE = 1 << 52


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's own marks."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    return (
        F.when(size == 0, "empty")
        .when(t.rlike(r"(?i)licen[sc]ed? under|all rights reserved"), "licence")
        .when(t.rlike(r"[#*$%&|<>]"), "marked")
        .when(size < 500, "note")
        .when(size < 5000, "article")
        .otherwise("book")
    )


def _sums(values: np.ndarray, at: list[np.ndarray], goals: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of the cells' values by category, for each axis."""
    return [np.bincount(i, values, len(g)) for i, g in zip(at, goals, strict=True)]


def rake(tokens: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Shares (sum 1) of the cells whose marginals meet the targets; cells without tokens stay empty.

    at: for each axis the cells' categories; targets: for each axis the shares of its categories. Those of categories
    without tokens are spread over the others. Only cells that exist are held, however many categories there are.
    """
    shares = tokens / tokens.sum()
    for _ in range(rounds):
        off = 0.0
        for axis, goal in enumerate(targets):
            have = np.bincount(at[axis], shares, len(goal))
            goal = np.where(have > 0, goal, 0.0)
            goal = goal / goal.sum()
            ratio = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            off = max(off, np.abs(goal - have).max())
            shares = shares * ratio[at[axis]]
        if off < tol:
            break
    return shares


def _bounded(tokens: np.ndarray, at: list[np.ndarray], goals: list[np.ndarray], rounds: int = 300) -> tuple[np.ndarray, float]:
    """Tokens to take of each cell, at most all of them, raked to the goals' marginals; and how far off they are.

    tokens: of the cells that have some; at: for each axis the cells' categories. A category's factor solves
    sum(min(tokens, factor * rest)) = goal by Newton's steps, which rise to it: the sum is concave and piecewise linear.
    """
    factors = [np.ones(len(g)) for g in goals]
    taken, off = tokens, np.inf
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            rest = tokens.copy()
            for other, f in enumerate(factors):
                if other != axis:
                    rest *= f[at[other]]
            add = lambda x: np.bincount(at[axis], x, len(goal))  # noqa: B023, E731
            f = np.divide(goal, all_rest := add(rest), out=np.zeros(len(goal)), where=all_rest > 0)
            for _ in range(50):
                full = f[at[axis]] * rest >= tokens
                free = add(np.where(full, 0.0, rest))
                step = np.divide(goal - add(np.where(full, tokens, 0.0)), free, out=f.copy(), where=free > 0)
                if (step <= f * (1 + 1e-13)).all():
                    break
                f = np.maximum(f, step)
            factors[axis] = f
        share = np.ones(len(tokens))
        for axis, f in enumerate(factors):
            share *= f[at[axis]]
        taken = np.minimum(1.0, share) * tokens
        off = max(np.abs(np.bincount(i, taken, len(g)) - g).max() / g.sum() for i, g in zip(at, goals, strict=True))
        if off < MET:
            break
    return taken, off


def probabilities(tokens: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray], budget: float = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """(weight, probability) of each cell: raked share over own share, and the chance that brings the sample there.

    The sample aims at budget as a share of all tokens. Where no cell needs more than all its tokens for that, chances
    are in proportion to weights; otherwise cells are raked again with their tokens as upper bounds. A budget at which
    the targets cannot be met is lowered to the largest at which they are, with a warning. Targets that no sample
    meets, as cells without tokens stand against them, are warned of too, and chances are in proportion to weights.
    """
    shares = rake(tokens, at, targets)
    own = tokens / tokens.sum()
    weight = np.divide(shares, own, out=np.zeros_like(shares), where=own > 0)
    sure = 1 / weight.max()
    if budget <= sure:
        return weight, np.minimum(1.0, weight * budget)
    some = np.flatnonzero(tokens)
    have = _sums(tokens, at, targets)
    goals = [np.where(h > 0, g, 0.0) for g, h in zip(targets, have, strict=True)]
    goals = [g / g.sum() for g in goals]
    if max(np.abs(s - g).max() for s, g in zip(_sums(shares, at, goals), goals, strict=True)) > MET:
        warnings.warn("no sample meets the targets of all dimensions; the nearest raking is scaled to its scarcest cell", stacklevel=2)
        return weight, np.minimum(1.0, weight * sure)
    most = min([budget, *((h[g > 0] / g[g > 0]).min() / tokens.sum() for g, h in zip(goals, have, strict=True))])
    chance, low, high = np.minimum(1.0, weight * sure), sure, most
    for k in range(16):
        size = high if k == 0 else (low + high) / 2
        taken, off = _bounded(tokens[some], [i[some] for i in at], [g * size * tokens.sum() for g in goals])
        if off < MET:
            chance = np.zeros_like(tokens)
            chance[some] = taken / tokens[some]
            low = size
            if k == 0:
                break
        else:
            high = size
    if low < budget:
        scarce = ", ".join(f"{i}:{n}" for i, (g, h) in enumerate(zip(goals, have, strict=True)) for n in np.flatnonzero(g * budget * tokens.sum() > h * (1 + MET)))
        warnings.warn(f"the targets are infeasible at {budget:.3f} of all tokens and met at {low:.3f}; categories (axis:place) with too few tokens: {scarce or 'none alone'}", stacklevel=2)
    return weight, chance


def _categories(source_col: str, lang_col: str, text_col: str, topic: Column | None) -> list[Column]:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return [text(F.col(source_col)).alias("source"), text(F.col(lang_col)).alias("lang"), (topic_of(F.col(text_col)) if topic is None else text(topic)).alias("topic")]


def cells(docs: DataFrame, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", topic: Column | None = None) -> list[tuple[str, str, str, int, int]]:
    """(source, lang, topic, documents, tokens) over all documents; at most MAX_CELLS rows come to the driver."""
    rows = docs.select(*_categories(source_col, lang_col, text_col, topic), F.size(words_of(F.col(text_col))).cast("long").alias("tokens"))
    found = rows.groupBy(*DIMS).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")).limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic; use coarser sources")
    return sorted((r["source"], r["lang"], r["topic"], r["docs"], r["tokens"]) for r in found)


def calibrate(found: list[tuple[str, str, str, int, int]], targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> list[tuple[str, str, str, float, float]]:
    """(source, lang, topic, weight, probability) of each cell. A dimension without targets gets its tempered shares."""
    names = [sorted({c[i] for c in found}) for i in range(3)]
    index = [{n: k for k, n in enumerate(x)} for x in names]
    at = [np.array([index[i][c[i]] for c in found], np.intp) for i in range(3)]
    tokens = np.array([c[4] for c in found], float)
    if not tokens.sum():
        return [(*c[:3], 0.0, 0.0) for c in found]
    goals = []
    for i, dim in enumerate(DIMS):
        absent = sorted(n for n, x in (targets or {}).get(dim, {}).items() if x and n not in index[i])
        if absent:
            warnings.warn(f"targets of {dim} without documents are spread over the others: {', '.join(absent)}", stacklevel=2)
        have = np.bincount(at[i], tokens, len(names[i]))
        goal = np.array([(targets or {}).get(dim, {}).get(n, 0.0) for n in names[i]]) if (targets or {}).get(dim) else (have / have.sum()) ** TEMPER * (have > 0)
        goals.append(goal / goal.sum())
    weight, chance = probabilities(tokens, at, goals, budget)
    return [(*c[:3], float(w), float(p)) for c, w, p in zip(found, weight, chance, strict=True)]


def _drawn(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id; a null id draws from its text."""
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    return F.pmod(h, F.lit(_SCALE)) / F.lit(float(_SCALE))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text", *, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 17, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and sampled of every document.

    targets: shares by category for any of source, lang and topic; topic: the column to take topics from, by default
    the marks that topic_of finds in a text. Null sources, languages and topics are the category "".
    Documents without tokens have weight and probability 0 in a cell of such documents only. Equal ids draw equally,
    so repeated rows go together. Other columns are ignored; an empty table gives an empty result.
    """
    table = calibrate(cells(docs, source_col, lang_col, text_col, topic), targets, budget)
    rows = docs.select(F.col(id_col).alias("doc_id"), *_categories(source_col, lang_col, text_col, topic), F.size(words_of(F.col(text_col))).cast("long").alias("n_tokens"), _drawn(id_col, text_col, seed).alias("draw"))
    if not table:
        return rows.select("doc_id", *DIMS, "n_tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"), F.lit(False).alias("sampled"))
    spark = docs.sparkSession
    found = F.broadcast(spark.createDataFrame(table, "source string, lang string, topic string, weight double, probability double"))  # MAX_CELLS rows at most
    return rows.join(found, list(DIMS)).select("doc_id", *DIMS, "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text", *, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 17, topic: Column | None = None) -> DataFrame:
    """The sampled documents, with their columns as they are.

    Parameters and nulls are as in mix. Equal ids draw equally, so repeated rows stay or go together; documents without
    tokens go. An empty table gives an empty result.
    """
    table = calibrate(cells(docs, source_col, lang_col, text_col, topic), targets, budget)
    if not table:
        return docs
    found = docs.sparkSession.createDataFrame([(s, g, t, p) for s, g, t, _, p in table], "__source string, __lang string, __topic string, __chance double")
    keyed = docs.withColumns(dict(zip(("__s", "__l", "__t"), _categories(source_col, lang_col, text_col, topic), strict=True)))
    joined = keyed.join(F.broadcast(found), (F.col("__s") == F.col("__source")) & (F.col("__l") == F.col("__lang")) & (F.col("__t") == F.col("__topic")))
    return joined.where(_drawn(id_col, text_col, seed) < F.col("__chance")).select(*docs.columns)
