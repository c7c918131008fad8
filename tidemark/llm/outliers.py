"""Quality rules: base rules on word statistics, then robust multivariate outliers per language and source.

Each group's centre and covariance are minimum-covariance-determinant estimates: of the halves of the group's documents,
the one whose covariance has the least determinant. As in the deterministic algorithm (Hubert, Rousseeuw, Verdonck
2012), several starts that need no random subsets (median deviations alone, and four robust correlations) are refined by
concentration steps: refit mean and covariance to the half with the least Mahalanobis distances. After SHORT steps the
KEPT starts of least determinant go on until no determinant falls, and the least one wins. Reweighting steps then refit
to all documents but far ones. A step is two aggregations over all documents, added up in each task first. Quantiles
come from histograms of fixed bins, and features lie on a grid of binary fractions, whose sums are exact as long as they
stay under 2^53 grid squares: results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ship import ship
from .common import WordHashes, bound_batches, cut, lean, small_side, table, to_arrow

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"

#: Statistics of a document, transformed to be roughly normal in clean text, in steps of 1 / GRID.
FEATURES = ("f_length", "f_word", "f_symbols", "f_lines", "f_repeats")
GRID = 1024
#: Least standard deviation of each, in place of a group's own where that is less: length and word length scatter in
#: any group; the others are mostly zero and constant in some, where a trifle must not reject.
LEAST = (0.05, 0.01, 0.25, 0.5, 0.65)
#: Small deviations whose squares are added to the diagonal, so that any covariance has an inverse.
FLOOR = (0.01,) * 5
#: Groups of fewer documents take the estimates of all documents together.
MIN_GROUP = 50
#: Concentration steps of all starts, starts that go on, and steps that these take at most (they end by themselves long before).
SHORT, KEPT, MOST_STEPS = 2, 2, 100
STARTS = 5
#: A step that lowers no logarithm of a determinant by more than this is the last.
CONVERGED = 1e-3
#: Rows of one file of features: steps read these files over and over, and a row takes some 50 bytes.
FILE_ROWS = 50_000
#: Reweighting steps, and the squared distance of what they leave out: the 0.9999 quantile of chi-squared with five degrees.
REWEIGHTS, FAR = 2, 25.745
#: Squared distance from which a document is rejected. Clean text has longer tails than chi-squared: calibrated on labelled
#: clean documents, of which at most one in a thousand is lost (README).
CUTOFF = 35.0
#: Factor that makes the covariance of the central half consistent at the normal distribution, five dimensions:
#: 0.5 / P(chi2 with 7 degrees < its median with 5 degrees).
CONSISTENCY = 0.5 / 0.2616
#: Bins of quantiles: of features and their deviations, and of log(1 + squared distance).
BIN, DISTANCE_BIN = 1 / 128, 1 / 256
#: Group of all documents together; groups' own numbers are odd.
POOLED = 0

K = len(FEATURES)
STATS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"
STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _statistics(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    repeats = 0
    if n >= 4:
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        x = (h[:-2] * a + h[1:-1]) * b
        x ^= x >> np.uint64(31)
        x = (x + h[2:]) * a
        _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeats = int(covered.sum())
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(_SPACE):
                seen.add(line)
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats


def statistics(spark: SparkSession, text: str | Column) -> Column:
    """STATS of each whole text (null: none). Words are runs of characters but space and U+0009 to U+000D."""
    ship(spark)
    bound_batches(spark)

    @F.arrow_udf(STATS)
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()

        def run(batches):
            for batch in batches:
                stats = np.array([_statistics(t, hashes) for t in batch.to_pylist()], np.int64).reshape(-1, 5)
                yield pa.StructArray.from_arrays([pa.array(stats[:, i]) for i in range(5)], list(STAT_NAMES))

        yield from lean(run)(texts)

    return of(text)


def with_features(stats: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1)).cast("double")
    values = (F.log(n), F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p("n_dup_lines"), F.log1p(100 * F.col("n_repeat_words") / n))
    return stats.select("*", *((F.round(v * GRID) / GRID).alias(f) for f, v in zip(FEATURES, values)), ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))


# ---- steps over all rows: each task adds up in numpy what is then summed by group ----


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(name)
    return np.asarray(column.flatten()).reshape(len(column), width)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(f)) for f in FEATURES], 1)


def _distances(batch: pa.RecordBatch) -> np.ndarray:
    """Squared Mahalanobis distances of the rows from the estimates beside them."""
    away = _features(batch) - _matrix(batch, "m", K)
    return np.einsum("ni,nij,nj->n", away, _matrix(batch, "inv", K * K).reshape(-1, K, K), away)


def _grouped(keys: dict[str, np.ndarray], sums: dict[str, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    t = pa.table(keys | sums).group_by(list(keys)).aggregate([(s, "sum") for s in sums])
    return pa.RecordBatch.from_arrays([t.column(f.name if f.name in keys else f"{f.name}_sum").combine_chunks().cast(f.type) for f in schema], schema=schema)


def _summed(rows: DataFrame, keys: str, names: list[str], make) -> DataFrame:
    """Sums by ``keys`` of what ``make(batch)`` gives: a dict of keys' arrays and one of the arrays to add up."""
    ship(rows.sparkSession)
    schema = ", ".join([keys, *(f"{n} {'long' if n == 'n' else 'double'}" for n in names)])
    arrow = to_arrow(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _grouped(*make(batch), arrow)

    by = [k.split()[0] for k in keys.split(", ")]
    return rows.mapInArrow(run, schema).groupBy(*by).agg(*(F.sum(n).alias(n) for n in names))


def _quantiles(bins: DataFrame, share: float, width: float) -> DataFrame:
    """(g, k, q): of counts n by (g, k, bin) the upper edge of the first bin that reaches ``share``. What a window orders are bins, not rows."""
    whole = W.partitionBy("g", "k")
    reached = bins.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("all", F.sum("n").over(whole)).where(F.col("upto") >= F.ceil(F.col("all") * share))
    return reached.groupBy("g", "k").agg(((F.min("bin") + 1) * width).alias("q"))


MOMENTS = ["n", *(f"s{i}" for i in range(K)), *(f"s{i}_{j}" for i in range(K) for j in range(i, K))]


def _moments_of(x: np.ndarray) -> dict[str, np.ndarray]:
    return {"n": np.ones(len(x), np.int64)} | {f"s{i}": x[:, i] for i in range(K)} | {f"s{i}_{j}": x[:, i] * x[:, j] for i in range(K) for j in range(i, K)}


def _covariances(t: dict[str, list], r: int) -> tuple[np.ndarray, np.ndarray]:
    n = t["n"][r]
    mean = np.array([t[f"s{i}"][r] for i in range(K)]) / n
    cov = np.zeros((K, K))
    for i in range(K):
        for j in range(i, K):
            cov[i, j] = cov[j, i] = t[f"s{i}_{j}"][r] / n - mean[i] * mean[j]
    return mean, cov


ESTIMATE = "g long, k int, n long, m array<double>, inv array<double>, logdet double"


def _fitted(moments: DataFrame, fit, extra: tuple[str, ...] = ()) -> DataFrame:
    """ESTIMATE from rows of moments; ``fit`` gives a row's mean and covariance. A variance under LEAST's is raised to it, then the floor added."""
    ship(moments.sparkSession)

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            m, inv, logdet = [], [], []
            for r in range(batch.num_rows):
                mean, cov = fit(t, r)
                cov = cov + np.diag(np.maximum(np.square(LEAST) - np.diag(cov), 0) + np.square(FLOOR))
                m.append(mean.tolist())
                inv.append(np.linalg.inv(cov).reshape(-1).tolist())
                logdet.append(float(np.linalg.slogdet(cov)[1]))
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(t["g"], pa.int64()), pa.array(t["k"], pa.int32()), pa.array(t["n"], pa.int64()), pa.array(m, doubles), pa.array(inv, doubles), pa.array(logdet, pa.float64())], ["g", "k", "n", "m", "inv", "logdet"])

    return moments.select("g", "k", *MOMENTS, *extra).mapInArrow(run, ESTIMATE)


def _starts(rows: DataFrame, n_groups: int) -> DataFrame:
    """STARTS estimates of each group: medians, and covariances by median deviations and correlations of deviations z as they
    are (0: none), under tanh (1), as spatial signs (2), clipped at 1.5 (3), and clipped at 3 (4)."""
    every = np.arange(K, dtype=np.int32)

    def counted(batch: pa.RecordBatch) -> tuple[dict, dict]:
        x = _features(batch)
        return {"g": np.repeat(np.asarray(batch.column("g")), K), "k": np.tile(every, len(x)), "bin": np.floor(x / BIN).astype(np.int64).reshape(-1)}, {"n": np.ones(x.size, np.int64)}

    def middle(values: np.ndarray, n: np.ndarray) -> float:
        """The median of values that occur n times."""
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(n[order])
        return float(values[order][np.searchsorted(upto, -(-upto[-1] // 2))])

    def spread_of(bins: pa.Table) -> pa.Table:
        """A group's medians and deviations, from its bins: at most as many as the features have steps of BIN."""
        k, at, n = (np.asarray(bins.column(c)) for c in ("k", "bin", "n"))
        med = [middle((at[k == i] + 0.5) * BIN, n[k == i]) for i in range(K)]
        mad = [middle(np.abs((at[k == i] + 0.5) * BIN - med[i]), n[k == i]) for i in range(K)]
        doubles = pa.list_(pa.float64())
        return pa.table({"g": pa.array([bins.column("g")[0].as_py()], pa.int64()), "med": pa.array([med], doubles), "scale": pa.array([np.maximum(1.4826 * np.array(mad), LEAST).tolist()], doubles)})

    spread = cut(_summed(rows, "g long, k int, bin long", ["n"], counted).groupBy("g").applyInArrow(spread_of, "g long, med array<double>, scale array<double>"), "spread")

    def transformed(batch: pa.RecordBatch) -> tuple[dict, dict]:
        z = (_features(batch) - _matrix(batch, "med", K)) / _matrix(batch, "scale", K)
        size = np.sqrt((z * z).sum(1, keepdims=True))
        # On the grid again, so that sums are exact.
        ways = [np.round(w * GRID) / GRID for w in (np.tanh(z), np.divide(z, size, out=np.zeros_like(z), where=size > 0), np.clip(z, -1.5, 1.5), np.clip(z, -3, 3))]
        x = np.concatenate([np.zeros_like(z[:1]).repeat(len(z), 0), *ways])
        return {"g": np.tile(np.asarray(batch.column("g")), STARTS), "k": np.repeat(np.arange(STARTS, dtype=np.int32), len(z))}, _moments_of(x)

    sums = _summed(rows.join(small_side(spread, 200, n_groups), "g"), "g long, k int", MOMENTS, transformed)

    def fit(t: dict[str, list], r: int) -> tuple[np.ndarray, np.ndarray]:
        _, cov = _covariances(t, r)
        own = np.sqrt(np.maximum(np.diag(cov), 0))
        corr = np.divide(cov, np.outer(own, own), out=np.eye(K), where=np.outer(own, own) > 1e-12)
        corr = 0.99 * corr + 0.01 * np.eye(K)
        np.fill_diagonal(corr, 1.0)
        return np.array(t["med"][r]), corr * np.outer(t["scale"][r], t["scale"][r])

    return _fitted(sums.join(small_side(spread, 200, n_groups), "g"), fit, ("med", "scale"))


def _refit(rows: DataFrame, est: DataFrame, n: int, limit: float | None) -> DataFrame:
    """Estimates from the rows whose squared distance is at most ``limit`` (None: the median of their group's)."""
    joined = rows.join(small_side(est.select("g", "k", "m", "inv"), 400, n), "g")
    scale = 1.0
    if limit is None:
        scale = CONSISTENCY

        def counted(batch: pa.RecordBatch) -> tuple[dict, dict]:
            bins = np.floor(np.log1p(_distances(batch)) / DISTANCE_BIN).astype(np.int64)
            return {"g": np.asarray(batch.column("g")), "k": np.asarray(batch.column("k")), "bin": bins}, {"n": np.ones(len(bins), np.int64)}

        half = _quantiles(_summed(joined, "g long, k int, bin long", ["n"], counted), 0.5, DISTANCE_BIN)
        bounded = est.select("g", "k", "m", "inv").join(small_side(half, 60, n), ["g", "k"])
        joined = rows.join(small_side(bounded, 460, n), "g")
    else:
        joined = joined.withColumn("q", F.lit(float(np.log1p(limit))))

    def moments(batch: pa.RecordBatch) -> tuple[dict, dict]:
        near = np.floor(np.log1p(_distances(batch)) / DISTANCE_BIN) < np.asarray(batch.column("q")) / DISTANCE_BIN - 0.5 if limit is None else np.log1p(_distances(batch)) <= np.asarray(batch.column("q"))
        return {"g": np.asarray(batch.column("g"))[near], "k": np.asarray(batch.column("k"))[near]}, _moments_of(_features(batch)[near])

    def fit(t: dict[str, list], r: int) -> tuple[np.ndarray, np.ndarray]:
        mean, cov = _covariances(t, r)
        return mean, cov * scale

    return _fitted(_summed(joined, "g long, k int", MOMENTS, moments), fit)


def mcd(rows: DataFrame, raw: bool = False) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group of ``rows`` (g, FEATURES), reweighted unless ``raw``: ESTIMATE."""
    n = rows.select("g").distinct().count()
    est = cut(_starts(rows, n), "estimates")
    for _ in range(SHORT):
        est = cut(_refit(rows, est, n * STARTS, None), "estimates")
    rank = W.partitionBy("g").orderBy("logdet", "k")  # STARTS rows a group
    est = est.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= KEPT).drop("rank").withColumn("open", F.lit(True))
    est = cut(est, "estimates")
    for _ in range(MOST_STEPS):
        still = est.where("open")
        if still.isEmpty():
            break
        new = _refit(rows, still, n * KEPT, None).select("g", "k", F.struct("n", "m", "inv", "logdet").alias("new"))
        better = F.col("new.logdet") < F.col("logdet") - CONVERGED  # no step raises the determinant
        take = [F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("n", "m", "inv", "logdet")]
        est = cut(est.join(small_side(new, 400, n * KEPT), ["g", "k"], "left").select("g", "k", *take, F.coalesce(better, F.lit(False)).alias("open")), "estimates")
    est = cut(est.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank", "open"), "estimates")
    for _ in range(0 if raw else REWEIGHTS):
        est = cut(_refit(rows, est, n, FAR), "estimates")
    return est


def _distance() -> Column:
    """Squared Mahalanobis distance by the group's inverse covariance, a flat array."""
    d = [F.col(f) - F.col("m")[i] for i, f in enumerate(FEATURES)]
    return sum((d[i] * d[j] * F.col("inv")[i * K + j] for i in range(K) for j in range(K)), F.lit(0.0))


def _judged(spark: SparkSession, docs: DataFrame, row: list[Column]) -> DataFrame:
    own = F.xxhash64(F.col("lang").isNull(), F.col("source").isNull(), "lang", "source").bitwiseOR(F.lit(1).cast("long"))
    counted = docs.select(*row, own.alias("own"), statistics(spark, "text").alias("stats"))
    stats = cut(with_features(counted.select(*(c for c in counted.columns if c != "stats"), "stats.*")), "statistics")
    sizes = cut(stats.where("NOT base_failed").groupBy("own").agg(F.count(F.lit(1)).alias("size")), "groups")
    n, n_small, passed = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("size") < MIN_GROUP).cast("int")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    large = F.col("size") >= MIN_GROUP
    sized = stats.join(small_side(sizes, 40, n), "own", "left")
    # Where all groups are large, nothing asks for the estimates of all documents together.
    groups = F.when(large, F.array("own", F.lit(POOLED).cast("long")) if n_small else F.array("own")).otherwise(F.array(F.lit(POOLED).cast("long")))
    files = max(2 * spark.sparkContext.defaultParallelism, -(-passed // FILE_ROWS))
    rows = cut(sized.where("NOT base_failed").select(F.explode(groups).alias("g"), *FEATURES).coalesce(files), "features")
    est = mcd(rows)
    away = sized.withColumn("g", F.when(large, F.col("own")).otherwise(F.lit(POOLED).cast("long"))).join(small_side(est.select("g", "m", "inv"), 400, n + 1), "g", "left")
    distance = F.when(~F.col("base_failed"), F.round(_distance(), 6))
    return away.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance and kept of every row.

    kept is false if the base rules fail, else whether the squared robust distance from the document's group is at most
    CUTOFF; distance is null where the base rules fail. Estimates come from the documents that pass them. A null language
    or source is a value of its own, unlike the empty string; a group of under MIN_GROUP such documents takes the
    estimates of all documents. Null and empty texts fail the base rules. Repeated rows get the same result each; other
    columns are ignored; an empty table gives no rows.
    """
    rows = _judged(docs.sparkSession, docs, [F.col("doc_id").cast("long").alias("doc_id")])
    return rows.select("doc_id", *STAT_NAMES, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns, whatever these are called. Each row goes by its own verdict."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return _judged(docs.sparkSession, docs, [row]).where("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
