"""Quality rules: native text statistics and a learned decision list emitted as `when` chains."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, only

#: Statistics that rules may test; each is a DOUBLE column of `statistics`.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "distinct_share")


def _left(text: Column, dropped: str) -> Column:
    """Code points that remain after a pattern is dropped."""
    return F.char_length(F.regexp_replace(text, dropped, "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found at least twice in the array, the first included."""
    at = lambda i, k: F.get(words, i + k)
    keys = F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(at(i, k) for k in range(5)))))
    keys = F.coalesce(keys, F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        # sorted (key, place) pairs put equal windows side by side, so the cost is n log n at any repetition
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda p: F.filter(p, lambda x, j: F.coalesce((F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]), F.lit(False)))
        places = let(pairs, lambda p: F.sort_array(F.transform(twice(p), lambda x: x["i"])))
        gaps = let(places, lambda q: F.aggregate(F.transform(q, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(q, j + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda s, g: s + g))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(gaps)

    return let(keys, covered)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (LONG) and the DOUBLE
    columns `f_<name>` of FEATURES, from whole texts, with built-in functions alone.

    A null text counts as empty; shares over nothing are 0. Windows are told apart by 64-bit hashes.
    Cost per document is n log n in its words and it holds one document at a time.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__t", t)
    out = out.withColumn("__w", F.filter(F.split("__t", SPACES), lambda w: w != ""))
    out = out.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": _left(F.col("__t"), SPACES),
        "n_symbols": _left(F.col("__t"), r"[^#*$%&|<>]+"),
        "__lines": F.size("__l"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("__w")),
        "__distinct": F.size(F.array_distinct("__w")),
        "__upper": _left(F.col("__t"), r"[^\p{Lu}]+"),
        "__bang": _left(F.col("__t"), r"[^!?]+"),
        "__digit": _left(F.col("__t"), r"[^0-9]+"),
    })
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    feats = {
        "n_words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "__lines"), "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("__upper", "word_chars"),
        "bang_share": share("__bang", "word_chars"), "digit_share": share("__digit", "word_chars"), "distinct_share": share("__distinct", "n_words"),
    }
    return out.withColumns({f"f_{k}": v for k, v in feats.items()}).drop("__t", "__w", "__l", "__lines", "__distinct", "__upper", "__bang", "__digit")


@dataclass(frozen=True)
class Rule:
    """All of `tests` (feature, '<=' or '>', threshold) hold: reject."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.tests:
            out = out & ((F.col(f"f_{name}") <= F.lit(cut)) if op == "<=" else (F.col(f"f_{name}") > F.lit(cut)))
        return out

    def mask(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, op, cut in self.tests:
            v = x[:, FEATURES.index(name)]
            out &= (v <= cut) if op == "<=" else (v > cut)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {c:g}" for n, op, c in self.tests) or "always"


def learn_rules(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, max_rules: int = 24, max_tests: int = 4, cuts: int = 64) -> list[Rule]:
    """Sequential covering: grow a conjunction by information gain on two thirds of the rows, prune it
    on the other third, keep it while its precision on both parts reaches `precision`, remove the rows
    it covers and go on. Rows are (features in FEATURES order); every third row is the pruning part.
    """
    rules, held = [], np.arange(len(x)) % 3 == 2
    alive = np.ones(len(x), bool)
    right = lambda m: ((bad & m).sum() + 0.5) / (m.sum() + 1.0)
    while len(rules) < max_rules and (bad & alive).any():
        grow, prune = alive & ~held, alive & held
        covered, tests = grow.copy(), []
        while len(tests) < max_tests and (covered & ~bad).any():
            p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
            if not p0:
                break
            base, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
            for k, name in enumerate(FEATURES):
                v = x[covered, k]
                for cut in np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="lower"))[:-1]:
                    low = covered & (x[:, k] <= cut)
                    p1, n1 = (low & bad).sum(), (low & ~bad).sum()
                    for op, p, n in (("<=", p1, n1), (">", p0 - p1, n0 - n1)):
                        gain = p * (np.log2(p / (p + n)) - base) if p else 0
                        if gain > best[0]:
                            best = (gain, (name, op, float(cut)), low if op == "<=" else covered & ~low)
            if best[1] is None:
                break
            name, op, cut = best[1]
            v = x[covered, FEATURES.index(name)]
            tests.append((name, op, float((cut + v[v > cut].min()) / 2)))  # halfway to the next value seen
            covered = best[2]
        worth = lambda r: ((r.mask(x) & prune & bad).sum() - (r.mask(x) & prune & ~bad).sum()) / max(1, (r.mask(x) & prune).sum())
        rule = Rule(tuple(tests))
        while len(rule.tests) > 1:  # drop final tests while the held-out worth doesn't fall
            shorter = Rule(rule.tests[:-1])
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        # of tests of one kind only the tightest says anything
        tight = {(n, o): min((c for a, b, c in rule.tests if (a, b) == (n, o)), key=lambda c: c if o == "<=" else -c) for n, o, _ in rule.tests}
        rule = Rule(tuple((n, o, c) for (n, o), c in tight.items()))
        m = rule.mask(x) & alive
        if not tests or not (m & bad).any() or right(m & ~held) < precision - 0.05 or ((m & held).sum() >= 5 and right(m & held) < precision - 0.1):
            break
        rules.append(rule)
        alive &= ~m
    return rules


def fit_quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, seed: int = 7, **options) -> list[Rule]:
    """Learn rules from at most `sample_rows` labelled documents (the labels of least id hash).

    The sample is the documented bound on what reaches the driver: `sample_rows` rows of nine doubles.
    A null quality or doc_id takes no part; without labelled rows of both kinds no rule is learned.
    """
    marks = only(labels, {"doc_id": "long", "quality": "int"}).filter("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    marks = marks.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(sample_rows)
    rows = only(docs, {"doc_id": "long", "text": "string"}).join(F.broadcast(marks), "doc_id")
    got = statistics(rows).select("doc_id", "quality", *(f"f_{k}" for k in FEATURES)).orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(sample_rows).toPandas()
    if not len(got) or got["quality"].nunique() < 2:
        return []
    return learn_rules(got[[f"f_{k}" for k in FEATURES]].to_numpy("float64"), got["quality"].to_numpy() == 0, **options)


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the first rule that holds rejects; else keep."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`docs` with the counts of `statistics`, base_failed (fewer than 10 words, or over a fifth of the
    words in repeated 5-word windows) and kept (false if base_failed, else the rules' verdict).

    Columns of `docs` that clash with the added ones are replaced. Empty tables give no rows.
    """
    out = statistics(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # a row number in these columns keeps a filter on them above the projections: pushed below, it would
    # compute the statistics again for each of its tests
    here = F.monotonically_increasing_id() >= 0
    out = out.withColumn("base_failed", failed & here).withColumn("kept", here & F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
    return out.drop(*(f"f_{k}" for k in FEATURES))


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `docs`, with its columns, that `quality` keeps."""
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))
    return quality(rows, rules).filter("kept").select("__doc.*")
