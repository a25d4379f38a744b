"""Text quality by a sparse ensemble of rules that Spark evaluates as column expressions.

Statistics of each text are column expressions. Small regression trees are boosted on the
statistics of a bounded sample of labelled rows; every path from a root to a node is a rule,
a conjunction of thresholds. A logistic model with lasso weights keeps few of the rules,
and the model is compiled into one column expression, so that scoring the corpus is a scan
without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the statistics, in the order of the sample's columns.
STATISTICS = ("chars", "words", "word_chars", "longest_word", "upper", "digits", "marks", "symbols", "distinct_words", "repeats", "lines", "distinct_lines", "ends", "letters")


def _share(text: Column, pattern: str, of: Column) -> Column:
    """Share of characters that match."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / of


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Adds a column for each statistic; a null text counts as empty. Shares of nothing are 0."""
    t, words = F.col("_t"), F.col("_w")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    docs = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    docs = docs.withColumn("_w", F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    values = {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "word_chars": chars / n,
        "longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double"),
        "upper": _share(t, r"\p{Lu}+", chars),
        "digits": _share(t, r"[0-9]+", chars),
        "marks": _share(t, r"[.,;:!?'\"()-]+", chars),
        "symbols": _share(t, r"[^\p{L}\p{N}\s.,;:!?'\"()-]+", chars),
        "distinct_words": F.size(F.array_distinct(words)) / n,
        # words equal to the one before
        "repeats": F.size(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b")), lambda p: p["a"] == p["b"])) / n,
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "ends": _share(t, r"[.!?]+", n),
        "letters": _share(t, r"\p{L}+", chars),
    }
    return docs.withColumns({f"_{k}": values[k] for k in STATISTICS}).drop("_t", "_w")


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, threshold, above) means statistic > threshold if above, else <=."""

    terms: tuple[tuple[int, float, bool], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, threshold, above in self.terms:
            out &= (x[:, j] > threshold) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for j, threshold, above in self.terms:
            c = F.col(f"_{STATISTICS[j]}")
            out &= c > threshold if above else c <= threshold
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((w * r.of(x) for r, w in self.rules), np.zeros(len(x)))

    def score(self) -> Column:
        """The score as a column expression over the statistics."""
        margin = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            margin += F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def _tree(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> list[tuple[Rule, float, np.ndarray]]:
    """All nodes below the root as (rule, mean, rows) of a tree of least squares; leaves last of their path."""
    out, todo = [], [((), np.arange(len(x)))]
    while todo:
        terms, rows = todo.pop()
        if len(terms) >= depth or len(rows) < 2 * least:
            continue
        y, best = target[rows], None
        for j, thresholds in enumerate(cuts):
            if not len(thresholds):
                continue
            place = np.searchsorted(thresholds, x[rows, j], side="left")  # values <= thresholds[k] have place <= k
            n = np.cumsum(np.bincount(place, minlength=len(thresholds) + 1))[:-1]
            s = np.cumsum(np.bincount(place, y, minlength=len(thresholds) + 1))[:-1]
            m, total = len(rows) - n, y.sum()
            ok = (n >= least) & (m >= least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1), -1)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0]:
                    best = (gain[k], j, float(thresholds[k]))
        if best is None or best[0] <= y.sum() ** 2 / len(y) + 1e-9:
            continue
        _, j, threshold = best
        above = x[rows, j] > threshold
        for side in (False, True):
            part, path = rows[above == side], (*terms, (j, threshold, side))
            out.append((Rule(path), float(target[part].mean()), part))
            todo.append((path, part))
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.2, penalty: float = 1.5e-3, steps: int = 400) -> Model:
    """Rules from boosted trees, then lasso weights by accelerated proximal gradient. One class or none: its smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(base, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    margin, rules, least = np.full(len(y), base), {}, max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        nodes = _tree(x, y - p, cuts, depth, least)
        inner = {n[0].terms[:-1] for n in nodes}
        for rule, _, rows in nodes:
            rules.setdefault(rule.terms, rule)
            if rule.terms not in inner:
                margin[rows] += rate * np.clip((y[rows] - p[rows]).sum() / max(1e-6, (p[rows] * (1 - p[rows])).sum()), -4, 4)
    found = list(rules.values())
    if not found:
        return Model(base, ())
    z = np.stack([r.of(x) for r in found], axis=1).astype(float)
    # rules that hold for the same rows are one
    _, first = np.unique(np.packbits(z.astype(bool), axis=0), axis=1, return_index=True)
    found, z = [found[i] for i in sorted(first)], z[:, sorted(first)]
    spread = np.maximum(z.std(axis=0), 0.02)
    z = np.hstack([z / spread, np.ones((len(y), 1))])
    rate_ = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    w = np.zeros(z.shape[1])
    w[-1] = base
    v, t = w.copy(), 1.0
    for _ in range(steps):
        gradient = z.T @ (1 / (1 + np.exp(-(z @ v))) - y) / len(y)
        new = v - rate_ * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate_ * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    weights = w[:-1] / spread
    return Model(float(w[-1]), tuple((r, float(k)) for r, k in zip(found, weights) if abs(k) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> Model:
    """Fit on the texts of at most sample_rows labelled rows, those with the smallest hashes of their ids."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    # the sample has at most sample_rows rows of two numbers
    rows = with_statistics(texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")), "_text")
    found = rows.orderBy("_id", "_label").select("_label", *(f"_{s}" for s in STATISTICS)).toPandas().to_numpy(float)
    return fit(found[:, 1:], found[:, 0])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, score, predicted (1 if score >= threshold).

    Null texts are scored as empty ones. Null ids and repeated rows are returned like any other. An empty table gives an
    empty result. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    out = with_statistics(texts, "_text").select("doc_id", model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
