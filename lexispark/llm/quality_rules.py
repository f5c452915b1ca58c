"""6. Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant (MCD).

Each document gets a vector of transformed statistics. For each language and source, MCD finds the location and scatter
of the half of its documents that lie closest together: from three deterministic robust starts, concentration steps (take the h
nearest by Mahalanobis distance, estimate anew from those) go on from the start whose scatter has the least determinant. The estimate is
made consistent and reweighted (see `mcd`). A document whose distance from its group's estimate is beyond the cutoff, a quantile of
chi-square that no label has a part in, is rejected.

Most texts have no symbols and no repeats, and such a statistic has no scatter in the nearest half. So to the scatter is added
the variance that one symbol, line, repeated passage or word more or less makes, its rounding: for estimates the group's median, for a
document that of its own text, which is little in a long one.

A concentration step is one aggregation over all documents: counts, sums and sums of products by bins of distance, with partial
sums in each task. The h nearest are read from the bins, of the last one the part that is needed, so no group is ever sorted or
collected, and one that holds a third of all rows costs no more than others.

Every group is estimated, and a group of n documents counts for n / (n + `prior`) of its estimate: the rest is its
language's, which leans on the whole table's in the same way. No size of a group changes the rule.

Defined results: a null text has no words and fails the base rules; null lang and source form groups of their own; equal
rows get equal verdicts; repeated rows each count; an empty table gives an empty table; other columns travel along and
columns named like ours are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm.common import IS_SPACE, Words, codes_of, pairs_coded, spans_array, text_slices, tidy
from lexispark.session import ready
from lexispark.storage import staged

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: More that the vectors use.
MORE = ("n_lines", "n_alpha", "n_distinct_words")
VERDICT = ("base_failed", "distance", "kept")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True


def _per_doc(mask_at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each document."""
    return np.diff(np.searchsorted(mask_at, offsets))


def _repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (doc, key), and which rows of that order equal the row before and the row after."""
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return order, np.append([False], same)[: len(order)], np.append(same, False)[: len(order)]


def slice_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All statistics of a slice of documents."""
    n = len(offsets) - 1
    out = {c: np.zeros(n, np.int64) for c in STATS + MORE}
    if not len(data):
        return out
    w = Words(data, offsets)
    counts = w.counts()
    out["n_words"] = counts
    lead = np.flatnonzero(~IS_SPACE[data] & ((data & 0xC0) != 0x80))
    out["word_chars"] = _per_doc(lead, offsets)
    out["n_symbols"] = _per_doc(np.flatnonzero(_SYMBOL[data]), offsets)
    out["n_alpha"] = _per_doc(np.flatnonzero(_ALPHA[data]), offsets)
    # lines: cut at \n and at document ends
    stops = np.flatnonzero(data == 10)
    doc_end = offsets[1:]
    line_end = np.sort(np.concatenate([stops, doc_end]), kind="stable")
    line_doc = np.searchsorted(doc_end, line_end, "left")
    # a \n at the first place of the next document has the same position as this one's end: ends come first
    at_edge = np.flatnonzero(np.isin(line_end, doc_end))
    if len(at_edge):
        ends = np.concatenate([doc_end, stops])
        of = np.concatenate([np.arange(n), np.searchsorted(doc_end, stops, "right")])
        order = np.lexsort((np.concatenate([np.ones(n), np.zeros(len(stops))]), ends, of))
        line_end, line_doc = ends[order], of[order]
    prev_end = np.r_[0, line_end[:-1]]
    line_start = np.where(np.r_[True, line_doc[1:] != line_doc[:-1]], offsets[line_doc], prev_end + 1)
    with_word = np.searchsorted(w.starts, line_end) > np.searchsorted(w.starts, line_start)
    line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    order, again, _ = _repeats(line_doc, codes_of(spans_array(data, line_start, line_end))[0])
    out["n_dup_lines"] = np.bincount(line_doc[order][again], minlength=n)
    if len(w.starts):
        words = w.codes().astype(np.int64)
        doc = np.repeat(np.arange(n), counts)
        order, again, _ = _repeats(doc, words)
        out["n_distinct_words"] = counts - np.bincount(doc[order][again], minlength=n)
        at = np.arange(max(0, len(words) - 2))
        at = at[at + 3 <= w.bounds[1:][doc[: len(at)]]]
        if words.max() < 1 << 21:
            grams = words[at] << 42 | words[at + 1] << 21 | words[at + 2]
        else:
            grams = pairs_coded(pairs_coded(words[at], words[at + 1]), words[at + 2])
        order, before, after = _repeats(doc[at], grams)
        twice = at[order][before | after]
        marked = np.zeros(len(doc), bool)
        for i in range(3):
            marked[twice + i] = True
        out["n_repeat_words"] = np.bincount(doc[marked], minlength=n)
    return out


X = ("x0", "x1", "x2", "x3", "x4")
ROUNDING = ("r0", "r1", "r2", "r3", "r4")


def vectors(stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(transformed statistics, rounding), a row for each document: shares of symbols, repeated lines, words in repeated passages and
    non-letters, and the length of words, as logarithms. Shares are of bounded range; a small constant keeps a single symbol or repeated
    line, which clean text has, from counting as far away. The rounding is what one symbol, repeated line, shortest repeated passage
    (six words), or word more or less changes."""
    n, chars, lines = (np.maximum(stats[c], 1).astype(np.float64) for c in ("n_words", "word_chars", "n_lines"))
    other = np.maximum(chars - stats["n_alpha"], 0)
    x = (0.02 + stats["n_symbols"] / n, 0.05 + stats["n_dup_lines"] / lines, 0.05 + stats["n_repeat_words"] / n, 0.05 + other / chars, chars / n)
    steps = (np.log1p(1 / n / 0.02), np.log1p(1 / lines / 0.05), np.log1p(6 / n / 0.05), np.log1p(1 / n / 0.05), 1 / n)
    return np.log(np.stack(x, 1)), np.stack(steps, 1)


def distances(x: np.ndarray, least: np.ndarray, estimate: pa.Array) -> pa.Array:
    """The distance of each document from its estimate (mu, cov), with the variance of the document's own rounding; null without one."""
    p, known = len(X), estimate.is_valid().to_numpy(zero_copy_only=False)
    out = np.full(len(x), np.nan)
    if known.any():
        mu, cov = (estimate.field(c).filter(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c, n in (("mu", p), ("cov", p * p)))
        off, var, i = x[known] - mu, cov.reshape(-1, p, p).copy(), np.arange(p)
        var[:, i, i] += least[known] ** 2
        out[known] = np.einsum("ij,ij->i", off, np.linalg.solve(var, off[..., None])[..., 0])
    return pa.array(out, mask=~known)


def statistics(docs: DataFrame, keep_text: bool = False, estimate: str | None = None) -> DataFrame:
    """`docs` (without columns named like ours), its statistics, their vectors and rounding; text travels only if asked for. With a
    column `estimate` (mu, cov) also the distance from it, instead of vectors and the estimate."""
    ready(docs.sparkSession)
    docs = docs.drop(*STATS, *MORE, *VERDICT, *X, *ROUNDING)
    rest = [c for c in docs.columns if c != estimate and (keep_text or c != "text")]
    more = ("distance",) if estimate else X + ROUNDING
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest] + [f"{c} long" for c in STATS + MORE] + [f"{c} double" for c in more]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slice_stats(data, offsets) for _, _, data, offsets in text_slices(batch.column("text"))]
            cols = {c: np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in STATS + MORE}
            x, r = vectors(cols)
            last = [distances(x, r, batch.column(estimate))] if estimate else [pa.array(c) for c in (*x.T, *r.T)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(c, pa.int64()) for c in cols.values()] + last, rest + [*STATS, *MORE, *more])

    return docs.mapInArrow(tidy(count), ", ".join(fields))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Spread that `mcd` allows for where the table has no rounding.
LEAST = 1e-3
#: Distances are counted in bins of an eighth of a doubling, between these.
BINS, LOWEST, HIGHEST = 8, -32, 64


def _columns(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(len(X))]


#: Pairs of statistics, each once.
PAIRS = [(i, j) for i in range(len(X)) for j in range(i, len(X))]
MU, INV = _columns("m"), [f"v{i}{j}" for i, j in PAIRS]
SUMS = ["n", *_columns("s"), *[f"q{i}{j}" for i, j in PAIRS]]


def _distance() -> Column:
    """Squared, by the columns of an estimate; flat columns keep this within generated code."""
    d = [F.col(x) - F.col(m) for x, m in zip(X, MU)]
    return reduce(lambda a, b: a + b, [(1 if i == j else 2) * d[i] * d[j] * F.col(v) for (i, j), v in zip(PAIRS, INV)])


def _bin(d2: Column) -> Column:
    """Distances from 2**-4 to 2**8 by eighths of a doubling; what is beyond goes to the last bin on its side."""
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.floor(F.log2(d2 + 1e-9) * BINS))).cast("int")


def lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    for n in range(1, 400):
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, dims: float) -> float:
    lo, hi = 0.0, 4 * dims + 60
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if lower_gamma(dims / 2, mid / 2) < p else (lo, mid)
    return hi


def _solved(row: dict, cov: np.ndarray) -> dict:
    """The inverse of the scatter with the rounding's variance, its log determinant, and how many dimensions are estimated and
    not rounding."""
    whole = cov + np.diag(np.array([row[c] for c in FLOOR]) ** 2)
    inv = np.linalg.inv(whole)
    return {v: float(inv[i, j]) for (i, j), v in zip(PAIRS, INV)} | {"det": float(np.linalg.slogdet(whole)[1]), "dims": float(np.trace(inv @ cov))}


def _moments(row: dict) -> tuple[np.ndarray, np.ndarray]:
    p, n = len(X), row["n"]
    mu, q = np.array([row[f"s{i}"] for i in range(p)]) / n, np.zeros((p, p))
    for i, j in PAIRS:
        q[i, j] = q[j, i] = row[f"q{i}{j}"] / n
    return mu, q - np.outer(mu, mu)


FLOOR = _columns("f")


def _solve(rows: DataFrame, keys: list[str], one: Callable[[dict], dict], out: dict[str, str]) -> DataFrame:
    """Each row's keys and what `one` makes of it: a few numbers a group, in NumPy."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | out
    names = [*keys, *out]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array([g[c] for g in got], pa.list_(pa.float64()) if out[c].startswith("array") else pa.float64()) for c in out]], names)

    return rows.mapInArrow(tidy(solve), ", ".join(f"{c} {kinds[c]}" for c in names))


def _joined(df: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    """Keys may be null: a null group is a group."""
    est = est.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in est.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(est, on, "left").drop(*[f"_{k}" for k in keys])


ESTIMATE = {c: "double" for c in [*FLOOR, *MU, *INV, "det", "dims"]}


def _starts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Three deterministic starts of each group: medians with the spreads alone, with the correlations of hyperbolic tangents of
    standardised values, and with those of spatial signs. An outlier moves none of them far."""
    median = lambda x: F.percentile_approx(x, F.lit(0.5), F.lit(2000))
    quartiles = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.75)), F.lit(2000)) for x in X]
    floors = [F.greatest(median(r), F.lit(LEAST)) if r in df.columns else F.lit(LEAST) for r in ROUNDING]
    robust = df.groupBy(*keys).agg(*[f.alias(c) for f, c in zip(floors, FLOOR)], *[median(x).alias(m) for x, m in zip(X, MU)], *[((q[1] - q[0]) / 1.349).alias(c) for q, c in zip(quartiles, _columns("d"))])
    robust = staged(robust, name)
    z = [(F.col(x) - F.col(m)) / F.sqrt(F.col(d) ** 2 + F.col(f) ** 2) for x, m, d, f in zip(X, MU, _columns("d"), FLOOR)]
    far = _joined(df, robust, keys).select(*keys, *[c.alias(n) for c, n in zip(z, _columns("z"))])
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.col(c) ** 2 for c in _columns("z")]) + 1e-12)
    kinds = {1: [F.tanh(c) for c in _columns("z")], 2: [F.col(c) / norm for c in _columns("z")]}
    sums = [F.sum(v[i] * v[j]).alias(f"t{k}{i}{j}") for k, v in kinds.items() for i, j in PAIRS]
    both = _joined(far.groupBy(*keys).agg(*sums), robust, keys).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))

    def one(row: dict) -> dict:
        sd, c = np.array([row[x] for x in _columns("d")]), np.eye(len(X))
        if row["start"]:
            for i, j in PAIRS:
                c[i, j] = c[j, i] = row[f"t{row['start']}{i}{j}"]
            scale = np.sqrt(np.maximum(np.diag(c), 1e-12))
            c = 0.99 * c / np.outer(scale, scale) + 0.01 * np.eye(len(X))
            np.fill_diagonal(c, 1.0)
        return {x: row[x] for x in [*FLOOR, *MU]} | _solved(row, c * np.outer(sd, sd))

    return staged(_solve(both, [*keys, "start"], one, ESTIMATE), name)


def _by_distance(df: DataFrame, est: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Counts, sums and sums of products by group (and start) and bin of distance, and how many are nearer: one pass over the
    documents, with partial sums in each task."""
    far = _joined(df, est.select(*by, *MU, *INV), keys).withColumn("bin", _bin(_distance()))
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS]]
    counted = far.groupBy(*by, "bin").agg(*sums)
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))


def _of_share(counted: DataFrame, by: list[str], share: float) -> DataFrame:
    """Sums over the nearest `share` of each group: whole bins, and of the last one the part that is needed."""
    h = F.floor(F.col("all") * share) + 1
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - F.col("upto") + F.col("n")) / F.col("n")))
    return counted.withColumn("part", part).groupBy(*by).agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in SUMS])


def _step(df: DataFrame, est: DataFrame, keys: list[str], by: list[str], share: float, name: str) -> DataFrame:
    """A concentration step: the estimate of those that are nearest by the last one."""
    near = _joined(_of_share(_by_distance(df, est, keys, by), by, share), est.select(*by, *FLOOR), by)

    def one(row: dict) -> dict:
        mu, cov = _moments(row)
        return dict(zip(MU, mu.tolist())) | {c: row[c] for c in FLOOR} | _solved(row, cov)

    return staged(_solve(near, by, one, ESTIMATE), name)


def mcd(df: DataFrame, keys: list[str], steps: int = 3, first: int = 2, share: float = 0.5, name: str = "mcd") -> DataFrame:
    """keys, n, mu and cov: reweighted MCD estimates of each group of `df` over the columns X.

    All starts take `first` concentration steps; the one with the least determinant takes `steps` more. Variances count with the group's
    median rounding, or statistics that most texts have none of would make every determinant 0. The raw scatter is scaled so that the
    median distance is a normal vector's, of as many dimensions as aren't rounding; documents within the 0.975 quantile then give
    the reweighted location and scatter, scaled for the cut. `cov` itself holds no rounding."""
    est = _starts(df, keys, name)
    by = [*keys, "start"]
    for _ in range(first):
        est = _step(df, est, keys, by, share, name)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("det", "start"))
    est = est.withColumn("best", best).where("best = 1").drop("best", "start")
    for _ in range(steps):
        est = _step(df, est, keys, keys, share, name)
    counted = staged(_by_distance(df, est, keys, keys), name)
    middle = counted.where(F.col("upto") >= F.floor(F.col("all") * share) + 1).groupBy(*keys).agg(F.min(F.struct("bin", ((F.floor(F.col("all") * share) + 1 - F.col("upto") + F.col("n")) / F.col("n")).alias("part"))).alias("c"))
    cut = _joined(est.select(*keys, "dims"), middle.select(*keys, F.pow(F.lit(2.0), (F.col("c.bin") + F.col("c.part")) / BINS).alias("median")), keys)

    def bounds(row: dict) -> dict:
        dims = max(0.5, row["dims"])
        scale = max(1.0, row["median"] / chi2_quantile(share, dims))
        edge = chi2_quantile(WITHIN, dims)
        return {"last": math.log2(edge * scale) * BINS, "scale": WITHIN / max(1e-9, lower_gamma(dims / 2 + 1, edge / 2))}

    cut = staged(_solve(cut, keys, bounds, {"last": "double", "scale": "double"}), name)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("last") - F.col("bin")))
    # one bin at least: the nearest
    part = F.when(F.col("upto") == F.col("n"), 1.0).otherwise(part)
    near = _joined(counted, cut, keys).withColumn("part", part).groupBy(*keys).agg(F.first("all").alias("all"), F.first("scale").alias("scale"), *[F.sum(F.col(c) * F.col("part")).alias(c) for c in SUMS])

    def last(row: dict) -> dict:
        mu, cov = _moments(row)
        return {"n": float(row["all"]), "mu": mu.tolist(), "cov": (cov * row["scale"]).ravel().tolist()}

    return staged(_solve(near, keys, last, {"n": "double", "mu": "array<double>", "cov": "array<double>"}), name)


#: The quantile within which documents count for the reweighted estimate.
WITHIN = 0.975
#: The 0.9999 quantile of chi-square with 5 degrees of freedom.
CUTOFF = 25.74


#: Documents of a group that count as much as its language's estimate.
PRIOR = 50


def _blended(part: DataFrame, whole: DataFrame, keys: list[str], prior: int) -> DataFrame:
    """Estimates of groups, leaning on those of `whole` by n against `prior`: location and scatter of the mixture."""
    p, w = len(X), F.col("n") / (F.col("n") + prior)
    both = _joined(part, whole.select(*keys, F.col("mu").alias("mu_"), F.col("cov").alias("cov_")), keys)
    apart = [F.col("mu")[i] - F.col("mu_")[i] for i in range(p)]
    mu = F.array(*[w * F.col("mu")[i] + (1 - w) * F.col("mu_")[i] for i in range(p)])
    cov = F.array(*[w * F.col("cov")[i * p + j] + (1 - w) * F.col("cov_")[i * p + j] + w * (1 - w) * apart[i] * apart[j] for i in range(p) for j in range(p)])
    return both.select(*part.columns[:-2], mu.alias("mu"), cov.alias("cov"))


def judge(docs: DataFrame, cutoff: float = CUTOFF, prior: int = PRIOR, steps: int = 3, keep_text: bool = False) -> DataFrame:
    """`docs`, its statistics, base_failed, distance (squared, robust) and kept. Text stays only if asked for, and then
    its statistics are counted again, so that it need not be staged."""
    docs = docs.drop(*STATS, *MORE, *VERDICT, *X, *ROUNDING)
    stats = staged(statistics(docs).withColumn("base_failed", base_failed()), "stats")
    level = lambda n, lang, source: F.struct(F.lit(n).alias("level"), lang.alias("lang"), source.alias("source"))
    lang, source, none = F.col("lang"), F.col("source"), F.lit(None).cast("string")
    fit = stats.where(~F.col("base_failed")).select(F.explode(F.array(level(0, none, none), level(1, lang, none), level(2, lang, source))).alias("g"), *X, *ROUNDING).select("g.*", *X, *ROUNDING)
    found = mcd(fit, ["level", "lang", "source"], steps)
    at = lambda n: found.where(F.col("level") == n).withColumn("level", F.lit(0))
    langs = staged(_blended(at(1), at(0), ["level"], prior), "mcd-langs")
    sources = staged(_blended(at(2), langs, ["lang"], prior), "mcd-sources")
    of = lambda est, keys, c: est.select(*keys, F.struct("mu", "cov").alias(c))
    x = docs if keep_text else stats
    x = _joined(x, of(sources, ["lang", "source"], "e1"), ["lang", "source"])
    x = _joined(x, of(langs, ["lang"], "e2"), ["lang"])
    x = _joined(x.withColumn("level", F.lit(0)), of(at(0), ["level"], "e3"), ["level"])
    x = x.withColumn("e", F.coalesce("e1", "e2", "e3")).drop("e1", "e2", "e3", "level")
    if keep_text:
        x = statistics(x, True, "e").withColumn("base_failed", base_failed())
    else:
        x = x.withColumn("distance", F.arrow_udf(_from_estimate, "double")(F.array(*X), F.array(*ROUNDING), F.col("e"))).drop("e", *X, *ROUNDING)
    return x.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False)))


def _from_estimate(x: pa.Array, least: pa.Array, estimate: pa.Array) -> pa.Array:
    return distances(*(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(X)) for c in (x, least)), estimate)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every whole text of documents."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *STATS, "base_failed", "kept", "distance")
