"""Quality rules: base statistics of whole texts, and robust multivariate outliers per language and source.

Each document with words gets a vector of transformed statistics (see FEATURES). Per (language, source) the minimum
covariance determinant location and scatter are found over all rows that pass the base rule, by concentration steps from
three starts: medians with a common scatter, medians with the spread of the quartiles, and plain mean and covariance.
Each step measures all Mahalanobis distances, keeps the H_SHARE closest rows and estimates anew from them, until no
determinant changes any more (MAX_STEPS at most); the start that ends with the least determinant gives the estimate.
Distances are counted in bins of 1/32 of a power of two with the sums each bin needs, so a step is one aggregation over
(group, start, bin) that combines on the map side, exact up to the bin and the same for every partitioning. Squared
distances are scaled so that their median in a group is at most that of a normal one. A document is rejected when its
distance to its group is above CUTOFF.

Every group, whatever its size, has an estimate of its own. Center and scatter from n chosen rows are averaged with
those of the group's language as if these came from PRIOR_ROWS rows more, and a language's with those of all rows in the
same way, so the weight of the wider group fades smoothly as a group grows. Scatter is floored by the variances in FLOOR,
as most clean documents have no symbols and no repeats at all.

Estimates have one row a group and start and are broadcast while they are few (`few`); beyond, rows and estimates are
dealt by group and one of SALTS salts, so that no group is one task.

Cases: null or empty text has no words and fails the base rule; null language or source form a group of their own; a
group without a row that passes the base rule has no estimate and needs none; null ids are kept; repeated rows are judged
each; an empty table gives no rows; columns other than id, text, language and source are ignored, or travel along where
`carry` names them. A worker holds the words of one text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import SPACES, as_bytes, few, sliced, staged, with_text

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
H_SHARE = 0.75
MAX_STEPS = 10
SETTLED = 1e-6
SALTS = 64
#: Rows that the estimate of the wider group counts for.
PRIOR_ROWS = 10
#: Mean word length (log), and square roots of the shares of symbols, repeated lines and repeated words.
FEATURES = ("x0", "x1", "x2", "x3")
FLOOR = (0.05**2, 0.05**2, 0.10**2, 0.10**2)
START = (0.10**2, 0.10**2, 0.20**2, 0.20**2)
CUTOFF = 30.0
#: Median of the squared distances of a normal group: that of chi-squared with as many degrees as there are features.
NORMAL_MEDIAN = 3.3567
BINS_A_POWER = 32
#: The group of all rows.
ALL = "\x02"


def text_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    chars = len(raw.translate(None, SPACES).decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, dup_lines, repeated


def _counts(carry: tuple[str, ...]):
    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batch_iter):
            got = [text_counts(raw) for raw in as_bytes(b.column("text"))]
            names = ("doc_id", "lang", "source", *carry)
            counts = [pa.array([x[i] for x in got], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *counts], names=[*names, *COUNTS])

    return run


def text_statistics(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, lang, source, the columns in carry (text: null as empty, others as they are) and COUNTS."""
    more = (F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    rows = with_text(df, id_col, text_col, *more, *(c for c in carry if c != "text"))
    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(_counts(carry), f"doc_id long, lang string, source string{kept}, " + ", ".join(f"{c} long" for c in COUNTS))


def _features(stats: DataFrame) -> DataFrame:
    n, chars = F.col("n_words"), F.col("word_chars")
    values = (F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n))
    return stats.withColumns({c: F.when(n > 0, v) for c, v in zip(FEATURES, values, strict=True)})


def _distance() -> Column:
    """Squared Mahalanobis distance to the group's `center` under its `inverse`, both arrays on the row."""
    p = len(FEATURES)
    d = [F.col(c) - F.col("center")[i] for i, c in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col("inverse")[i * p + j] * (1.0 if i == j else 2.0)
    return total


def _shrunk(count: float, value: np.ndarray, wider: np.ndarray) -> np.ndarray:
    return (count * value + PRIOR_ROWS * wider) / (count + PRIOR_ROWS)


def _model_rows(rows: list[tuple], more: tuple[str, ...]) -> pa.RecordBatch:
    """(grp, start, center, inverse) and further numbers."""
    vector = pa.list_(pa.float64())
    fields = [("grp", pa.string()), ("start", pa.int32()), ("center", vector), ("inverse", vector), *((c, pa.float64()) for c in more)]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _estimates(chosen: DataFrame) -> DataFrame:
    """(grp, start, center, inverse, logdet, scale) from count and sums of the chosen rows of each group and of the groups
    above it."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    values = [c for c in chosen.columns if c not in ("grp", "parent", "start", "middle")]
    parent = chosen.select(F.col("grp").alias("parent"), "start", *[F.col(c).alias(f"p_{c}") for c in values])
    top = chosen.filter(F.col("grp") == ALL).select("start", *[F.col(c).alias(f"t_{c}") for c in values])

    def solve(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_iter:
            out = []
            for row in b.to_pylist():
                center = cov = None
                for level in ("t_", "p_", ""):
                    n = row[f"{level}n"]
                    if n is None:
                        continue  # all rows together have no wider group
                    mean = np.array([row[f"{level}s{i}"] for i in range(p)]) / n
                    own = np.zeros((p, p))
                    for i, j in pairs:
                        own[i, j] = own[j, i] = row[f"{level}s{i}{j}"] / n - mean[i] * mean[j]
                    center, cov = (mean, own) if center is None else (_shrunk(n, mean, center), _shrunk(n, own, cov))
                cov = cov + np.diag(FLOOR)
                scale = max(1.0, 2.0 ** ((row["middle"] + 0.5) / BINS_A_POWER) / NORMAL_MEDIAN)
                out.append((row["grp"], row["start"], center.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1]), scale))
            yield _model_rows(out, ("logdet", "scale"))

    every = chosen.join(parent, ["parent", "start"], "left").join(top, "start")
    return every.mapInArrow(solve, "grp string, start int, center array<double>, inverse array<double>, logdet double, scale double")


def _starts(member: DataFrame) -> DataFrame:
    """(grp, start, center, inverse): the three starts of each group, averaged with those of the wider groups."""
    p = len(FEATURES)
    values = {f"m{i}": F.avg(c) for i, c in enumerate(FEATURES)}
    values |= {f"q{i}": F.percentile(F.round(c, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for i, c in enumerate(FEATURES)}
    values |= {f"s{i}{j}": F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(p) for j in range(i, p)}
    own = staged(member.groupBy("grp", "parent").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in values.items()]), "quality-starts")
    parent = own.select(F.col("grp").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("n", *values)])
    top = own.filter(F.col("grp") == ALL).select(F.lit(1).alias("one"), *[F.col(c).alias(f"t_{c}") for c in ("n", *values)])

    def solve(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_iter:
            out = []
            for row in b.to_pylist():
                got = None
                for level in ("t_", "p_", ""):
                    n = row[f"{level}n"]
                    if n is None:
                        continue
                    quartiles = np.array([row[f"{level}q{i}"] for i in range(p)])
                    mean = np.array([row[f"{level}m{i}"] for i in range(p)])
                    cov = np.zeros((p, p))
                    for i in range(p):
                        for j in range(i, p):
                            cov[i, j] = cov[j, i] = row[f"{level}s{i}{j}"] - mean[i] * mean[j]
                    spread = ((quartiles[:, 2] - quartiles[:, 0]) / 1.349) ** 2
                    mine = [(quartiles[:, 1], np.diag(START)), (quartiles[:, 1], np.diag(spread)), (mean, cov)]
                    got = mine if got is None else [(_shrunk(n, c, wc), _shrunk(n, v, wv)) for (c, v), (wc, wv) in zip(mine, got, strict=True)]
                for start, (center, cov) in enumerate(got):
                    out.append((row["grp"], start, center.tolist(), np.linalg.inv(cov + np.diag(FLOOR)).ravel().tolist()))
            yield _model_rows(out, ())

    every = own.withColumn("one", F.lit(1)).join(parent, "parent", "left").join(top, "one")
    return staged(every.mapInArrow(solve, "grp string, start int, center array<double>, inverse array<double>"), "quality-model")


def _with_model(rows: DataFrame, model: DataFrame, models: int, how: str = "inner") -> DataFrame:
    """rows with their group's estimates; no group's rows are all sent to one task."""
    hinted = few(model, models)
    if hinted is not model:
        return rows.join(hinted, "grp", how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int"))
    return salted.join(model.withColumn("_salt", salts), ["grp", "_salt"], how).drop("_salt")


def judge(stats: DataFrame) -> DataFrame:
    """stats (a written table, which is read several times) plus distance, base_failed and kept."""
    p = len(FEATURES)
    lang, source = F.coalesce(F.col("lang"), F.lit("\x00")), F.coalesce(F.col("source"), F.lit("\x00"))
    pair = F.concat(lang, F.lit("\x01"), source)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = _features(stats).withColumn("grp", pair).withColumn("base_failed", failed)

    # A row counts for its own group, its language and all rows.
    levels = F.array(*[F.struct(g.alias("grp"), w.alias("parent")) for g, w in ((pair, lang), (lang, F.lit(ALL)), (F.lit(ALL), F.lit(None).cast("string")))])
    member = rows.filter("NOT base_failed").select(F.explode(levels).alias("g"), *FEATURES).select("g.*", *FEATURES)

    model = _starts(member).withColumns({"logdet": F.lit(float("inf")), "scale": F.lit(1.0)})
    models = model.count()
    step_bin = F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * BINS_A_POWER)
    sums = {f"s{i}": F.sum(c) for i, c in enumerate(FEATURES)}
    sums |= {f"s{i}{j}": F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(p) for j in range(i, p)}
    each = Window.partitionBy("grp", "start")
    closer = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for step in range(MAX_STEPS):
        binned = _with_model(member, model, models).withColumn("bin", step_bin)
        binned = binned.groupBy("grp", "parent", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])
        binned = binned.withColumn("before", F.coalesce(F.sum("n").over(closer), F.lit(0))).withColumn("all_n", F.sum("n").over(each))
        taken = F.col("before") < F.col("all_n") * H_SHARE
        middle = F.min(F.when(2 * (F.col("before") + F.col("n")) >= F.col("all_n"), F.col("bin"))).alias("middle")
        chosen = binned.groupBy("grp", "parent", "start").agg(middle, *[F.sum(F.when(taken, F.col(c))).alias(c) for c in ("n", *sums)])
        last, model = model, staged(_estimates(staged(chosen, f"quality-chosen{step}")), f"quality-model{step}")
        moved = model.join(last.select("grp", "start", F.col("logdet").alias("last")), ["grp", "start"])
        if step and (moved.agg(F.max(F.abs(F.col("logdet") - F.col("last")))).first()[0] or 0.0) < SETTLED:
            break
    best = model.groupBy("grp").agg(F.min_by(F.struct("center", "inverse", "scale"), F.struct("logdet", "start")).alias("m"))
    best = staged(best.select("grp", "m.*"), "quality-best")

    judged = _with_model(rows, best, models, "left").withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False))
    return judged.withColumn("kept", kept).drop("grp", "center", "inverse", "scale", *FEATURES)


def quality_rules(df: DataFrame, **columns: str) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    judged = judge(staged(text_statistics(df, **columns), "quality-stats"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "distance")
