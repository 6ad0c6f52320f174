"""Quality rules and robust multivariate outliers, in DataFrame operations alone.

Base statistics are taken from each whole text. A document that fails a base rule is rejected. The others are judged by four transformed
statistics (word length, symbol density, share of repeated lines, share of repeated windows) against the minimum-covariance-determinant
estimate of their language and source. From two starts, concentration steps take the mean and covariance of exactly the H_SHARE of the group's
documents that lie nearest under the last estimate, so the determinant never rises; they go on until it settles, and the start with the least
determinant counts. A document is rejected where its squared Mahalanobis distance exceeds CUTOFF.

The covariance of the nearest documents is made consistent for normal data, and a variance under its floor (FLOORS, squared) is raised to it:
a group whose documents agree exactly doesn't reject those that differ a little. Where a statistic spreads less than its floor, as symbols and
repeats do in clean prose, the floor decides. Groups under MIN_GROUP documents are judged together with the other small groups of their
language, and where those are too few as well, with all such of the other languages, however many they are.

Null and empty texts have no words and fail. Null language or source counts as empty. Repeated rows, ties and null ids give a row each; of ties at
the edge of the nearest documents, those with the smaller statistics count. Very long texts are taken whole, by Spark's own functions. Empty
tables give no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize

MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
H_SHARE, STEPS, MIN_GROUP = 0.75, 20, 50
#: A fall of the determinant's logarithm that ends the steps, what is added to each variance in them, and rows of a table that is broadcast.
SETTLED, RIDGE, FEW = 1e-3, 1e-8, 50_000
GROUP = ["g_lang", "g_source"]
#: The 1 - 1e-6 quantile of chi-square with 4 degrees of freedom, and what makes the covariance of the nearest 75 % consistent for normal data.
CUTOFF, CONSISTENCY = 33.4, 1.485
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats")
FLOORS = {"f_length": 0.12, "f_symbols": 0.35, "f_lines": 0.15, "f_repeats": 0.15}
SPACE = r"[\x20\x09-\x0D]"


def _rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def _but_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def _joined(a: Column, by: int) -> Column:
    """Hashes of twice the words: element i with element i + by."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), lambda x, y: F.xxhash64(x, y))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Per row: id, the two grouping columns and the base statistics. 8-word windows are compared by hashes built in three doublings."""
    q = lambda c: F.col(f"`{c}`")
    d = docs.select(q(id_col).alias("doc_id"), F.coalesce(q(text_col), F.lit("")).alias("text"), *(F.coalesce(q(c), F.lit("")).alias(n) for c, n in zip(by, ("lang", "source"), strict=True)))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE + "+"), ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    for by_ in (1, 2, 4):
        d = d.withColumn("h", _joined(F.col("h"), by_))
    # only texts with a repeated window sort their windows; equal neighbours in that order are the repeated ones
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(repeated, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    nothing = F.lit(None).cast("struct<h: bigint, i: int>")
    d = d.withColumn("same", F.zip_with("s", F.concat(F.array(nothing), _but_last(F.col("s"))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    d = d.withColumn("either", F.zip_with("same", F.concat(_rest(F.col("same")), F.array(F.lit(False))), lambda a, b: a | b)).drop("same")
    d = d.withColumn("at", F.array_sort(F.filter(F.zip_with("s", "either", lambda s, e: F.when(e, s["i"])), lambda x: x.isNotNull()))).drop("s", "either")
    ends = F.concat(_rest(F.col("at")), F.array(F.element_at("at", -1) + REPEAT_WINDOW))
    covered = F.aggregate(F.zip_with("at", ends, lambda a, b: F.least(F.lit(REPEAT_WINDOW), b - a)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0)).cast("long")).drop("at")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def with_features(stats: DataFrame) -> DataFrame:
    share = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))
    return stats.withColumns({
        "f_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "f_symbols": F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f_lines": share("n_dup_lines", "n_lines"), "f_repeats": share("n_repeat_words", "n_words"),
    })


def _quantile(rows: DataFrame, keys: list[str], bin_col: str, levels: dict[str, float]) -> DataFrame:
    """For each key, the least bin at which the share of rows reaches each level. Only counts per bin are shuffled and ordered."""
    bins = rows.groupBy(*keys, bin_col).agg(F.sum("n").alias("n"))
    whole, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    share = bins.withColumn("share", F.sum("n").over(so_far) / F.sum("n").over(whole))
    return share.groupBy(*keys).agg(*(F.min(F.when(F.col("share") >= q, F.col(bin_col))).alias(name) for name, q in levels.items()))


def _factor(est: DataFrame, *keys: str) -> DataFrame:
    """The estimate with the Cholesky factor of its covariance, c_ij to l_ij, and the logarithm of its determinant."""
    n = len(FEATURES)
    for i in range(n):
        for j in range(i + 1):
            s = F.col(f"c_{i}{j}") - sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
            est = est.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-18))) if i == j else s / F.col(f"l_{j}{j}"))
    det = sum((2 * F.log(f"l_{i}{i}") for i in range(n)), F.lit(0.0))
    return est.select(*keys, *(f"m_{i}" for i in range(n)), *(f"l_{i}{j}" for i in range(n) for j in range(i + 1)), *(f"c_{i}{j}" for i in range(n) for j in range(i + 1)), det.alias("logdet"))


def _squared(rows: DataFrame) -> DataFrame:
    """d2, the squared distance of rows that have an estimate beside them: forward substitution through the factor."""
    for i, f in enumerate(FEATURES):
        rows = rows.withColumn(f"y_{i}", (F.col(f) - F.col(f"m_{i}") - sum((F.col(f"l_{i}{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l_{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(FEATURES))), F.lit(0.0)))


def _distance(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows with d2, their squared distance."""
    return _squared(_lookup(rows, est, GROUP, est.count())).select(*rows.columns, "d2")


def _lookup(rows: DataFrame, table: DataFrame, keys: list[str], size: int) -> DataFrame:
    """rows with the columns of a table of `size` rows, one per key. It is broadcast where it is small, so that a large group's rows stay in
    the tasks that they are in."""
    return rows.join(F.broadcast(table) if size <= FEW else table, keys)


def _sums(rows: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """Per key: the weight, and the weighted sums of the centred features and of their products."""
    x = [F.col(f) - F.col(f"m_{i}") for i, f in enumerate(FEATURES)]
    of = lambda v, name: F.sum(weight * v).alias(name)
    return rows.groupBy(*keys).agg(F.sum(weight).alias("w"), *(of(v, f"s_{i}") for i, v in enumerate(x)), *(of(x[i] * x[j], f"s_{i}{j}") for i in range(len(x)) for j in range(i + 1)))


def _concentrated(vectors: DataFrame, est: DataFrame, size: int) -> DataFrame:
    """Sums over exactly the `need` nearest rows of each estimate, ties in order of their features.

    Rows are counted and summed per bin of their distance; of the bin that holds the last of them per finer bin; and only the rows of that finer
    bin are put in order. So no group is ordered as a whole."""
    keys = [*GROUP, "start"]
    near = _squared(_lookup(vectors, est, GROUP, size)).withColumn("place", F.log(F.col("d2") + 1e-12) * 50).withColumn("bin", F.floor("place"))
    over = Window.partitionBy(*keys).orderBy("bin")
    parts = []
    for level in range(2):
        bins = _sums(near, F.col("n"), *keys, "need", "bin")
        bins = materialize(bins.withColumn("before", F.sum("w").over(over.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, "before").where("before < need"), f"mcd-bins-{level}")
        parts.append(bins.where("before + w <= need").drop("need", "bin", "before"))
        edge = bins.where("before + w > need").select(*keys, F.col("bin").alias("edge"), (F.col("need") - F.col("before")).alias("rest"))
        near = _lookup(near, edge, keys, size).where("bin = edge").withColumn("need", F.col("rest")).withColumn("bin", F.floor((F.col("place") - F.col("edge")) * 10_000)).drop("edge", "rest")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("d2", *FEATURES).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = near.withColumn("own", F.least(F.col("n"), F.greatest(F.col("need") - before, F.lit(0))))
    parts.append(_sums(last, F.col("own"), *keys))
    names = [c for c in parts[0].columns if c not in keys]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in names))


def _moments(sums: DataFrame, *keys: str) -> DataFrame:
    """Mean and covariance from sums around m_i, with RIDGE on the diagonal."""
    n = len(FEATURES)
    mean = [F.col(f"s_{i}") / F.col("w") for i in range(n)]
    cov = {(i, j): F.col(f"s_{i}{j}") / F.col("w") - mean[i] * mean[j] + (RIDGE if i == j else 0.0) for i in range(n) for j in range(i + 1)}
    return sums.select(*keys, *((F.col(f"m_{i}") + mean[i]).alias(f"m_{i}") for i in range(n)), *(v.alias(f"c_{i}{j}") for (i, j), v in cov.items()))


def _starts(vectors: DataFrame) -> DataFrame:
    """Two first estimates of each group: its medians and quartiles, and its mean and covariance."""
    n = len(FEATURES)
    long = vectors.select(*GROUP, "n", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.floor(F.col(f) * 200).alias("bin")) for i, f in enumerate(FEATURES)))).alias("x")).select(*GROUP, "n", "x.f", "x.bin")
    q = _quantile(long, [*GROUP, "f"], "bin", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    pick = lambda i, c: F.max(F.when(F.col("f") == i, c))
    spread = F.pow((F.col("q3") - F.col("q1") + 1) / 200 / 1.349, 2)
    robust = q.groupBy(*GROUP).agg(*(pick(i, (F.col("q2") + 0.5) / 200).alias(f"m_{i}") for i in range(n)), *(pick(i, spread).alias(f"c_{i}{i}") for i in range(n)))
    robust = robust.withColumns({f"c_{i}{j}": F.lit(0.0) for i in range(n) for j in range(i)} | {"start": F.lit(0)})
    zero = vectors.withColumns({f"m_{i}": F.lit(0.0) for i in range(n)})
    plain = _moments(_sums(zero, F.col("n"), *GROUP).withColumns({f"m_{i}": F.lit(0.0) for i in range(n)}), *GROUP).withColumn("start", F.lit(1))
    return _factor(robust.unionByName(plain), *GROUP, "start")


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Location and Cholesky factor per (g_lang, g_source): a row per group, of the start that ends with the least determinant.

    Equal rows are one vector with a count, so a group of copies costs as much as one of them. Steps end where no determinant falls by more
    than SETTLED, or after `steps`."""
    n, keys = len(FEATURES), [*GROUP, "start"]
    vectors = materialize(rows.groupBy(*GROUP, *FEATURES).agg(F.count(F.lit(1)).alias("n")), "quality-vectors")
    need = vectors.groupBy(*GROUP).agg(F.ceil(F.sum("n") * H_SHARE).alias("need"))
    est = materialize(_starts(vectors).join(need, GROUP), "mcd-start")
    size = est.count()
    for step in range(steps):
        sums = _concentrated(vectors, est, size).join(est.select(*keys, "need", *(f"m_{i}" for i in range(n))), keys)
        new = materialize(_factor(_moments(sums, *keys, "need"), *keys, "need"), f"mcd-{step + 1}")
        fall = est.select(*keys, F.col("logdet").alias("before")).join(new, keys).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        est = new
        if step and (fall is None or fall <= SETTLED):
            break
    best = est.groupBy(*GROUP).agg(F.min_by(F.struct(*(c for c in est.columns if c not in (*keys, "need"))), F.struct("logdet", "start")).alias("e")).select(*GROUP, "e.*")
    wide = {f"c_{i}{j}": CONSISTENCY * F.col(f"c_{i}{j}") for i in range(n) for j in range(i)} | {f"c_{i}{i}": F.greatest(CONSISTENCY * F.col(f"c_{i}{i}"), F.lit(FLOORS[f] ** 2)) for i, f in enumerate(FEATURES)}
    return materialize(_factor(best.drop("logdet", *(c for c in best.columns if c.startswith("l_"))).withColumns(wide), *GROUP).drop("logdet", *wide), "mcd")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source"), min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """Base statistics, `distance2` (null where the base failed) and `kept`."""
    stats = materialize(with_features(base_statistics(docs, id_col, text_col, by)), "quality")
    good = stats.where("not base_failed")
    sizes = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= min_group
    groups = sizes.select("lang", "source", "n", F.when(own, F.concat(F.lit("="), "source")).otherwise("*").alias("g_source"))
    groups = groups.withColumn("alike", F.col("lang")).withColumn("total", F.sum("n").over(Window.partitionBy("lang", "g_source")))
    pooled = (F.col("g_source") == "*") & (F.col("total") < min_group)
    groups = materialize(groups.select("lang", "source", F.when(pooled, "*").otherwise(F.concat(F.lit("="), "alike")).alias("g_lang"), "g_source"), "quality-groups")
    size = groups.count()
    est = robust_estimates(_lookup(good, groups, ["lang", "source"], size).select(*GROUP, *FEATURES))
    per_group = materialize(groups.join(est, GROUP), "quality-estimates")
    d = _squared(stats.join(F.broadcast(per_group) if size <= FEW else per_group, ["lang", "source"], "left"))
    d = d.withColumn("distance2", F.when(~F.col("base_failed"), F.col("d2")))
    return d.select(*stats.columns, "distance2", (~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))).alias("kept"))


def query(spark, sf: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 6).alias("distance2"))
