"""Quality rules: decision lists learned by sequential covering, applied as Spark conditional expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SPACE = "[\\\\x20\\\\x09-\\\\x0D]"


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics of each whole text (a null text has none): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, and those that only the learned rules use: n_lines, n_upper, n_marks. Row by row, with no shuffle; a
    text of n words takes n log n steps. Columns of these names are replaced, all others stay."""
    t = "__t"
    own = [c for c in docs.columns if c not in STATISTICS]
    # the row's own columns stay inside one struct, so that no name clashes with those used here
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row") if own else F.lit(None).alias("__row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(t))
    df = df.withColumn("__w", F.expr(f"array_remove(split({t}, '{SPACE}+'), '')"))
    df = df.withColumn("__n", F.size("__w"))
    # 64-bit hashes of the 3-word windows; the repeated values come from a sort of plain longs
    df = df.withColumn("__h", F.expr("CASE WHEN __n < 4 THEN array() ELSE transform(sequence(0, __n - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) END"))
    df = df.withColumn("__s", F.sort_array("__h"))
    df = df.withColumn("__d", F.expr("array_distinct(filter(__s, (x, i) -> i > 0 AND x = __s[greatest(i - 1, 0)]))"))
    few = "filter(transform(__h, (x, i) -> CASE WHEN array_contains(__d, x) THEN i END), x -> x IS NOT NULL)"
    # texts with many repeated windows: places by a sort of (hash, place), so that the work stays n log n; both ways give the
    # same places (tested), and the first is half the cost where few windows repeat
    many = (
        "transform(filter(arrays_zip(__p, slice(concat(__p, array(NULL)), 2, size(__p)), slice(concat(array(NULL), __p), 1, size(__p))), "
        "x -> coalesce(x.__p.h = x.`1`.h, false) OR coalesce(x.__p.h = x.`2`.h, false)), x -> x.__p.i)"
    )
    df = df.withColumn("__p", F.expr("CASE WHEN size(__d) > 64 THEN sort_array(transform(__h, (x, i) -> named_struct('h', x, 'i', i))) END"))
    df = df.withColumn("__r", F.expr(f"CASE WHEN size(__d) = 0 THEN array() WHEN size(__d) <= 64 THEN {few} ELSE {many} END"))
    df = df.withColumn("__l", F.expr(f"filter(split({t}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    gone = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    stats = {
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": gone("#*$%&|<>").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.expr("cast(size(array_distinct(flatten(transform(__r, i -> array(i, i + 1, i + 2))))) as bigint)"),
        "n_lines": F.size("__l").cast("long"),
        "n_upper": F.expr(f"cast(regexp_count({t}, '\\\\p{{Lu}}') as bigint)"),
        "n_marks": gone("!?").cast("long"),
    }
    # the generator keeps later filters from being rewritten in terms of the text, which would copy these expressions
    # into each other without end
    return df.select("__row", F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in stats.items()]))).alias("__stats")).select(*["__row.*"] * bool(own), "__stats.*")


#: Ratios that rules test, from the statistics; each is null where its divisor is 0.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
    "words": ("n_words", None),
}


def ratios(stats: DataFrame) -> DataFrame:
    cols = {k: (F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) if b else F.col(a).cast("double")) for k, (a, b) in RATIOS.items()}
    return stats.withColumns(cols)


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.cut if self.above else x[self.name] <= self.cut

    def column(self) -> Column:
        c = F.col(self.name)
        return F.coalesce(c >= self.cut if self.above else c <= self.cut, F.lit(False))


def _all(tests: list[Test], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for t in tests:
        out &= t.holds(x)
    return out


def learn_rules(
    x: dict[str, np.ndarray], bad: np.ndarray, *, cuts: int = 48, most_tests: int = 3, most_rules: int = 16, least_bad: int = 4, purity: float = 0.95,
) -> list[list[Test]]:
    """Ordered rules for the rejected class by sequential covering: each rule grows test by test with the largest
    information gain on two thirds of the rows, is pruned from its end on the last third, and takes away the rows it
    covers. Each statistic starts one rule; of those of which ``purity`` of all they cover is bad, and at least
    ``least_bad`` rows are, the one that rejects most joins the list, which ends when there is none."""
    n = len(bad)
    grow_part = np.arange(n) % 3 != 2
    left, rules = np.ones(n, bool), []
    options = []
    for name, v in x.items():
        seen = np.unique(v[np.isfinite(v)])
        middle = (seen[1:] + seen[:-1]) / 2  # a cut lies between two values that occur
        for part in (v[bad], v[~bad]):
            part = part[np.isfinite(part)]
            if len(part) and len(middle):
                near = np.unique(np.searchsorted(seen, np.quantile(part, np.linspace(0, 1, cuts))))
                for cut in np.unique(middle[np.unique(np.clip(np.concatenate([near - 1, near]), 0, len(middle) - 1))]):
                    options += [Test(name, above, float(cut)) for above in (True, False)]
    def gains(inside: np.ndarray) -> list[tuple[float, Test]]:
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        out = []
        for t in options:
            hold = t.holds(x) & inside
            p, q = (hold & bad).sum(), (hold & ~bad).sum()
            if p and (g := p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0)))) > 1e-9:
                out.append((float(g), t))
        return out

    def worth(tests: list[Test]) -> float:
        hold = _all(tests, x) & left & ~grow_part
        return ((hold & bad).sum() - (hold & ~bad).sum()) / max(hold.sum(), 1)

    while len(rules) < most_rules and (left & grow_part & bad).any():
        first: dict[str, tuple[float, Test]] = {}
        for g, t in gains(left & grow_part):
            if t.name not in first or g > first[t.name][0]:
                first[t.name] = g, t
        best, most = None, 0
        for _, t in first.values():  # a rule from each statistic's best test; the one that rejects most is kept
            tests, inside = [t], left & grow_part & t.holds(x)
            while len(tests) < most_tests and (inside & ~bad).any() and (more := gains(inside)):
                tests.append(max(more, key=lambda m: m[0])[1])
                inside &= tests[-1].holds(x)
            tests = max((tests[:k] for k in range(1, len(tests) + 1)), key=lambda ts: (worth(ts), -len(ts)))
            covered = _all(tests, x) & left
            hits = int((covered & bad).sum())
            if hits >= least_bad and hits >= purity * covered.sum() and hits > most:
                best, most = tests, hits
        if best is None:
            break
        rules.append(best)
        left &= ~_all(best, x)
    return rules


def rule_column(rules: list[list[Test]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, tests in enumerate(rules, 1):
        cond = tests[0].column()
        for t in tests[1:]:
            cond &= t.column()
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit_quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = 3000,
) -> list[list[Test]]:
    """Learn rules from at most ``most_labelled`` labelled documents (those whose ids have the smallest hashes), the one
    bound in this module. Labels other than 0 and 1, null ids and ids without a document teach nothing; of rows that
    repeat an id the text with the smallest hash does."""
    sample = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__y"))
    sample = sample.orderBy(F.xxhash64("__id"), "__id").limit(most_labelled)
    few = docs.select(F.col(id_col).alias("__id"), F.col(text_col)).join(F.broadcast(sample), "__id").withColumnsRenamed({"__id": "id_", "__y": "y_"})
    few = few.groupBy("id_", "y_").agg(F.min_by(text_col, F.xxhash64(text_col)).alias("text_"))
    rows = ratios(text_statistics(few, "text_")).select("y_", F.xxhash64("id_").alias("o_"), *RATIOS).collect()
    rows.sort(key=lambda r: r["o_"])
    if not rows:
        return []
    x = {k: np.array([np.nan if r[k] is None else r[k] for r in rows], float) for k in RATIOS}
    with np.errstate(invalid="ignore"):
        return learn_rules(x, np.array([r["y_"] == 0 for r in rows]))


def apply_quality_rules(
    docs: DataFrame, rules: list[list[Test]], *, text_col: str = "text", least_words: int = 50, most_repeat: float = 0.5,
) -> DataFrame:
    """Adds the statistics, base_failed (fewer than ``least_words`` words, or a larger share of repeated words than
    ``most_repeat``), rule (0, or the learned rule that rejects the row) and kept. A null or empty text fails the base
    rules; rows that repeat are judged alike; an empty table stays empty; columns of these names are replaced."""
    df = ratios(text_statistics(docs, text_col))
    df = df.withColumn("base_failed", (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeat * F.col("n_words")))
    df = df.withColumn("rule", rule_column(rules))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
