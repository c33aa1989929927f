"""Learning models of APIs from their realizations, a group for each API; realizations come in the order of rid."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import patterns as P
from spanforge.plans.lineage import cut

MODELS = "api string, model string, generalized boolean, original string, first_sym string, max_len int"
STATS = "api string, empty_allowed boolean, n_train int, n_redundant int, n_test int, successes int, fails int"
TRAIN = 50  # generic learner: models added at most
TRAIN_LESS = 100  # less generic learner
TRAIN_ALIGNED = 50  # alignment learner: training realizations at most
LONG = 100  # mean length beyond which the alignment learner is not tried


class _Learned:
    """A learner's models as (text, generalized, original), matched by position sets."""

    def __init__(self) -> None:
        self.models: list[tuple[str, bool, str]] = []
        self.machines: dict[str, P.Machine] = {}
        self.redundant = 0
        self.train = 0

    def accepts(self, seq: str) -> bool:
        return any(self.machine(m[0]).full(seq) for m in self.models)

    def machine(self, text: str) -> P.Machine:
        if text not in self.machines:
            self.machines[text] = P.Machine(text)
        return self.machines[text]


def learn_generic(seqs: list[str]) -> tuple[_Learned, list[str]]:
    """Fold realizations until min(TRAIN, half) models are added; what a model matches already is redundant. The rest is for test."""
    out, cap = _Learned(), min(TRAIN, math.ceil(len(seqs) / 2))
    for i, seq in enumerate(seqs):
        if out.train >= cap:
            return out, seqs[i:]
        if out.accepts(seq):
            out.redundant += 1
            continue
        text = P.fold(seq)
        if text is not None:
            out.models.append((text, True, seq))
            out.train += 1
    return out, []


def learn_less_generic(seqs: list[str]) -> tuple[_Learned, list[str]]:
    """Keep realizations as they are, and generalize by folding only on a second witness of the same folded pattern."""
    out, cap = _Learned(), min(TRAIN_LESS, math.ceil(len(seqs) / 2))
    folds: dict[str, str | None] = {}
    for i, seq in enumerate(seqs):
        if out.train >= cap:
            return out, seqs[i:]
        if out.accepts(seq):
            out.redundant += 1
            continue
        text = folds.setdefault(seq, P.fold(seq))
        if text is not None and any(g and m == text for m, g, _ in out.models):
            out.redundant += 1
            continue
        same = [k for k, (_, g, o) in enumerate(out.models) if text is not None and not g and folds.setdefault(o, P.fold(o)) == text]
        if same:
            out.models = [m for k, m in enumerate(out.models) if k not in same]
            out.models.append((text, text != seq, seq))
        else:
            out.models.append((seq, False, seq))
        out.train += 1
    return out, []


LEARNERS: dict[str, Callable[[list[str]], tuple[_Learned, list[str]]]] = {"generic": learn_generic, "less_generic": learn_less_generic}


def learn_group(api: str, seqs: list[str], kind: str) -> tuple[list[tuple], tuple | None]:
    """(model rows, stats row) of one API; none of either where all realizations are empty."""
    full = [s for s in seqs if s]
    if not full:
        return [], None
    learned, test = LEARNERS[kind](full)
    good = sum(learned.accepts(s) for s in test)
    rows = []
    for text, general, original in learned.models:
        tree = P.parse(text)
        rows.append((api, text, general, original, P.first_symbol(tree), P.max_length(tree)))
    return rows, (api, len(full) < len(seqs), learned.train, learned.redundant, len(test), learned.redundant + good, len(test) - good)


def build_models(encoded: DataFrame, kind: str = "less_generic") -> tuple[DataFrame, DataFrame]:
    """(models, stats) from realizations (api, rid, enc)."""

    names, told = ([c.split()[0] for c in x.split(", ")] for x in (MODELS, STATS))
    more = [c for c in told if c not in names]

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        rows, row = learn_group(group["api"].iloc[0], list(group.sort_values("rid")["enc"]), kind)
        found = [dict(zip(names, r, strict=True), __stats=False) for r in rows] + ([dict(zip(told, row, strict=True), __stats=True)] if row else [])
        columns = [*names, *more, "__stats"]
        return pd.DataFrame([[x.get(c) for c in columns] for x in found], columns=columns, dtype=object)

    types = [c for c in STATS.split(", ") if c.split()[0] in more]
    # learned once: both results read the checkpoint
    both = cut(encoded.select("api", "rid", "enc").groupBy("api").applyInPandas(learn, ", ".join([MODELS, *types, "__stats boolean"])))
    return both.where("NOT __stats").select(*names), both.where("__stats").select(*told)


def learn_aligned(seqs: list[str], api: str = "") -> tuple[str, int, int]:
    """(pattern, matched, failed): realizations aligned one after another; with over 10 the later half is for test."""
    train = seqs if len(seqs) <= 10 else seqs[: min(TRAIN_ALIGNED, len(seqs) // 2)]
    test = seqs[len(train) :] if len(train) < len(seqs) else []
    pattern: P.Aligned = [(frozenset((c,)), P.MANDATORY) for c in train[0]]
    if len(train) > 1:
        pattern = P.from_pair(*P.align(train[0], train[1]))
        for s in train[2:]:
            pattern = P.widen(pattern, s)
    text = P.aligned_text(pattern)
    machine = P.Machine(text)
    if not all(machine.full(s) for s in train):
        raise ValueError(f"{api}: the aligned pattern {text} does not match its own realizations")
    good = sum(machine.full(s) for s in test)
    return text, good, len(test) - good


def build_aligned(encoded: DataFrame) -> DataFrame:
    """(api, status, model, successes, fails) of the alignment learner; status is "too long" beyond a mean of LONG."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seqs = [s for s in group.sort_values("rid")["enc"] if s]
        api = group["api"].iloc[0]
        if not seqs:
            rows = []
        elif sum(map(len, seqs)) / len(seqs) > LONG:
            rows = [(api, "too long", None, 0, 0)]
        else:
            rows = [(api, "ok", *learn_aligned(seqs, api))]
        return pd.DataFrame(rows, columns=["api", "status", "model", "successes", "fails"])

    return encoded.groupBy("api").applyInPandas(run, "api string, status string, model string, successes int, fails int")


def length_stats(kb: DataFrame) -> DataFrame:
    """(api, total, mean) length of realizations."""
    return kb.groupBy("api").agg(F.sum(F.size("calls")).cast("long").alias("total"), F.avg(F.size("calls")).alias("mean"))


def call_names(kb: DataFrame) -> DataFrame:
    """(api, name) of every call that an API makes."""
    return kb.select("api", F.explode("calls").alias("c")).select("api", F.col("c.name").alias("name")).distinct()


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    return results.select("api", "model"), results.drop("model")


def success_ratio(stats: DataFrame) -> DataFrame:
    """Corpus ratios of successes and fails; null without any."""
    total = F.sum(F.col("successes") + F.col("fails"))
    return stats.agg((F.sum("successes") / F.nullif(total, F.lit(0))).alias("success"), (F.sum("fails") / F.nullif(total, F.lit(0))).alias("fail"))


def troublesome(stats: DataFrame, low: float = 0.15, high: float = 1.0) -> DataFrame:
    """(api, ratio) of fails within the bounds, the worst first."""
    ratio = F.col("fails") / F.nullif(F.col("successes") + F.col("fails"), F.lit(0))
    return stats.select("api", ratio.alias("ratio")).where(F.col("ratio").between(low, high)).orderBy(F.col("ratio").desc(), "api")


def evaluate(encoded: DataFrame, models: DataFrame) -> DataFrame:
    """(api, successes, fails): distinct realizations count as often as they occur; models are patterns of the API.

    An equi-join on the API, so a realization meets that API's models only.
    """
    seqs = encoded.where("enc <> ''").groupBy("api", "enc").agg(F.count(F.lit(1)).alias("n"))
    hit = seqs.join(models.select("api", "model"), "api").groupBy("api", "enc", "n").agg(F.bool_or(F.expr("enc RLIKE concat('^(?:', model, ')$')")).alias("ok"))
    return hit.groupBy("api").agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).cast("long").alias("successes"), F.sum(F.when(F.col("ok"), 0).otherwise(F.col("n"))).cast("long").alias("fails"))


def evaluate_timed(encoded: DataFrame, models: DataFrame, timeout: float = 5.0) -> DataFrame:
    """(api, successes, fails, timeouts) as evaluate has them; a realization that no model matches and that took one too long is a time-out."""
    import regex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for api, enc, n, patterns in zip(batch["api"], batch["enc"], batch["n"], batch["models"], strict=True):
                late = ok = False
                for p in patterns:
                    try:
                        ok = regex.compile(p).fullmatch(enc, timeout=timeout) is not None
                    except TimeoutError:
                        late = True
                    if ok:
                        break
                out.append((api, n * ok, n * (not ok and not late), n * (not ok and late)))
            yield pd.DataFrame(out, columns=["api", "successes", "fails", "timeouts"])

    seqs = encoded.where("enc <> ''").groupBy("api", "enc").agg(F.count(F.lit(1)).alias("n"))
    own = models.groupBy("api").agg(F.array_sort(F.collect_set("model")).alias("models"))
    tried = seqs.join(own, "api").select("api", "enc", "n", "models").mapInPandas(run, "api string, successes long, fails long, timeouts long")
    return tried.groupBy("api").agg(*[F.sum(c).cast("long").alias(c) for c in ("successes", "fails", "timeouts")])


def expensive(stats: DataFrame, low: float = 0.01, high: float = 1.0) -> DataFrame:
    """(api, ratio) of time-outs within the bounds, the worst first."""
    ratio = F.col("timeouts") / F.nullif(F.col("successes") + F.col("fails") + F.col("timeouts"), F.lit(0))
    return stats.select("api", ratio.alias("ratio")).where(F.col("ratio").between(low, high)).orderBy(F.col("ratio").desc(), "api")


def count_matches(encoded: DataFrame, models: DataFrame) -> DataFrame:
    """(api, model, n, total): realizations that each model matches whole, and the API's non-empty ones."""
    seqs = encoded.where("enc <> ''").groupBy("api", "enc").agg(F.count(F.lit(1)).alias("k"))
    joined = seqs.join(models.select("api", "model").distinct(), "api")
    n = F.sum(F.when(F.expr("enc RLIKE concat('^(?:', model, ')$')"), F.col("k")).otherwise(0)).cast("long")
    return joined.groupBy("api", "model").agg(n.alias("n"), F.sum("k").cast("long").alias("total"))


def local_rare(counts: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Models that match less than the threshold of their API's realizations."""
    return counts.where(F.col("n") / F.col("total") < threshold)


def global_rare(counts: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(model, n_apis): models that are rare in every API that has them."""
    return counts.groupBy("model").agg(F.count(F.lit(1)).alias("n_apis"), F.count_if(F.col("n") / F.col("total") < threshold).alias("rare")).where("rare = n_apis").select("model", "n_apis")


def same_models(models: DataFrame) -> DataFrame:
    """(api, other): for each API the first later one that shares a model."""
    after = models.select("api", "model").distinct().withColumn("other", F.lead("api").over(Window.partitionBy("model").orderBy("api")))
    return after.where("other IS NOT NULL").groupBy("api").agg(F.min("other").alias("other"))


def sharing(models: DataFrame, api: str) -> DataFrame:
    """APIs with a model of the given one."""
    own = models.where(F.col("api") == api).select("model").distinct()
    return models.where(F.col("api") != api).join(own, "model", "left_semi").select("api").distinct()


def model_owners(models: DataFrame, model: str) -> DataFrame:
    return models.where(F.col("model") == model).select("api").distinct()


def numbered(models: DataFrame) -> DataFrame:
    """models with model_id, stable by API and text."""
    return models.withColumn("model_id", F.row_number().over(Window.orderBy("api", "model")))


def syscall_only(models: DataFrame, symbols: DataFrame, empty_apis: DataFrame | None = None) -> DataFrame:
    """Models whose symbols are all events; with empty_apis (api) those too that call only such APIs beside an event."""
    m = models.select("api", "model").distinct()
    chars = m.withColumn("sym", F.explode(F.filter(F.split(F.regexp_replace("model", r"[()?+*|]", ""), ""), lambda c: c != ""))).join(symbols.select("sym", "kind", "name"), "sym")
    if empty_apis is not None:
        chars = chars.join(empty_apis.select(F.col("api").alias("name"), F.lit(True).alias("void")).distinct(), "name", "left")
    else:
        chars = chars.withColumn("void", F.lit(None).cast("boolean"))
    kept = chars.groupBy("api", "model").agg(F.bool_and((F.col("kind") == "SYS") | F.coalesce("void", F.lit(False))).alias("leaf"), F.bool_or(F.col("kind") == "SYS").alias("some"))
    return kept.where("leaf AND some").select("api", "model")
