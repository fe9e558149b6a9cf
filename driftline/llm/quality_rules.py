"""Quality rules: fixed base rules, then robust multivariate outliers. DataFrame functions only.

Each document becomes a vector of transformed statistics. For each language and source the minimum
covariance determinant (MCD) estimate of location and scatter is sought as usual: from several
starts, two concentration steps (keep the three quarters of the group nearest by Mahalanobis distance,
re-estimate from those); the start whose scatter has the least determinant goes on until its
determinant falls no more. The starts are deterministic: coordinatewise medians and deviations, and the
scatter of the hyperbolic tangents and of the spatial signs of the vectors so scaled. Scatters
are regularised by fixed floors, so that constant statistics leave them regular. Documents far from
their group by the final distance are rejected.

The text is read once. The steps work on one narrow row for each document; they are grouped
counts, sums and quantile sketches, all with map-side partials, so a group with a third of all rows
costs no more than another. Estimates are one row for each group and return by a join on the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm import common
from driftline.llm.common import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Fixed values of the base rules: symbols, least words, window, and the most repeated words in percent.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
FEATURES = ["words", "word_length", "variety", "symbols", "lines", "repeats"]
#: Least standard deviation of each feature, so that a statistic that is constant in a group does not reject noise.
FLOORS = [1.0, 0.08, 0.25, 0.3, 0.2, 0.1]
#: Median of chi-square with as many degrees of freedom as features, to which distances are scaled.
CHI2_MEDIAN = 5.348
SUBSET = 0.75
#: Squared distance beyond which a document is rejected; far out in the tail of chi-square (10 or so is common).
CUTOFF = 60.0
#: Sources with fewer documents are pooled with other such sources of the same language.
LEAST_GROUP = 100
#: Concentration steps of every start, before the best goes on alone.
FIRST_STEPS = 2
#: A fall of the logarithm of the determinant by less ends the steps; quantile sketches are no finer.
SETTLED = 1e-3
#: Estimates of at most so many groups are broadcast; more are joined by a shuffle and the rows dealt out evenly again.
BROADCAST_GROUPS = 10_000


def fingerprint(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> Column:
    """128 bits of all that a verdict depends on."""
    parts = [docs[c].cast("string") for c in (text_col, lang_col, source_col)]
    nulls = F.concat(*[p.isNull().cast("string") for p in parts])
    return F.struct(F.xxhash64(nulls, *parts).alias("a"), F.xxhash64(F.lit(1), *parts[::-1], nulls).alias("b"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, fingerprint, the base rules' counts, distinct words and lines, language and source of every row.

    Null texts are empty.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), fingerprint(docs, text_col, lang_col, source_col).alias("print"), text.alias("t"), *[F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("")).alias(g) for c, g in ((lang_col, "g_lang"), (source_col, "g_source"))])
    base = ["doc_id", "print", "g_lang", "g_source"]
    d = d.select(
        *base,
        F.transform(F.filter(F.split("t", SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("line"),
    )
    n = F.size("h")
    k = REPEAT_WINDOW
    d = d.select(
        *base, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        F.size("line").cast("long").alias("n_lines"),
        (F.size("line") - F.size(F.array_distinct("line"))).cast("long").alias("n_dup_lines"),
        F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("h", i, k)))).alias("w"),
    )
    # only texts in which some window comes twice are sorted
    again = F.size(F.array_distinct("w")) < F.size("w")
    d = d.withColumn("s", F.when(again, F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("w")
    twice = F.filter("s", lambda e, i: e["x"].eqNullSafe(F.get("s", i - 1)["x"]) | e["x"].eqNullSafe(F.get("s", i + 1)["x"]))
    d = d.withColumn("p", F.array_sort(F.transform(twice, lambda e: e["i"]))).drop("s")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    step = lambda a, i: F.struct((a["n"] + k - F.greatest(a["end"] - i, F.lit(0))).cast("long").alias("n"), (i + k).cast("int").alias("end"))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate("p", start, step, lambda a: a["n"]), F.lit(0).cast("long"))).drop("p")


def features() -> list[Column]:
    """The transformed statistics, in the order of FEATURES."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log(c / n),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / F.pow(n, F.lit(0.75))),
        F.log1p(100 * F.col("n_symbols") / c),
        F.col("n_dup_lines") / (F.col("n_lines") + 1.0),
        F.col("n_repeat_words") / n,
    ]


def _cholesky(cov: list[list[Column]], names: str) -> tuple[list[list[str]], list[list[tuple[str, Column]]]]:
    """Names of the factor's entries, and the projections (in order) that compute them."""
    p = len(cov)
    name = [[f"{names}{i}_{j}" for j in range(p)] for i in range(p)]
    stages = []
    for j in range(p):
        rest = cov[j][j] - sum((F.col(name[j][k]) * F.col(name[j][k]) for k in range(j)), F.lit(0.0))
        stages.append([(name[j][j], F.sqrt(F.greatest(rest, F.lit(1e-12))))])
        stages.append([(name[i][j], (cov[i][j] - sum((F.col(name[i][k]) * F.col(name[j][k]) for k in range(j)), F.lit(0.0))) / F.col(name[j][j])) for i in range(j + 1, p)])
    return name, [s for s in stages if s]


KEY = ["g_lang", "g_source"]
STARTED = [*KEY, "start"]
#: Source of the pooled rows; others are empty (null) or begin with another character.
POOLED = "*"


def _by_group(rows: DataFrame, estimates: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The rows with their group's estimates; ``estimates`` has been computed and has a row for each group."""
    if estimates.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(estimates), keys)
    return rows.join(estimates, keys).hint("rebalance")


def _moments(rows: DataFrame, keys: list[str], vector: str, floors: list[float]) -> DataFrame:
    """Location m, Cholesky factor of the scatter and its log determinant of each group's rows, one row for each group."""
    p = len(FEATURES)
    z = [F.col(vector)[i] for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(z[i]).alias(f"s{i}") for i in range(p)], *[F.sum(z[i] * z[j]).alias(f"q{i}_{j}") for i, j in pairs])
    n = F.col("n")
    cov = [[F.lit(0.0)] * p for _ in range(p)]
    for i, j in pairs:
        cov[i][j] = F.col(f"q{i}_{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n + (floors[i] ** 2 if i == j else 0.0)
    name, stages = _cholesky(cov, "l")
    out = sums
    for s in stages:
        out = out.withColumns(dict(s))
    determinant = 2 * reduce(lambda a, b: a + b, [F.log(name[i][i]) for i in range(p)])
    return out.select(*keys, determinant.alias("logdet"), F.array(*[F.col(f"s{i}") / n for i in range(p)]).alias("m"), *[name[i][j] for i, j in pairs])


def _with_distance(rows: DataFrame, estimates: DataFrame, keys: list[str] = KEY, vector: str = "z") -> DataFrame:
    """Adds the squared Mahalanobis distance: forward substitution with the factor, a column for each step."""
    p = len(FEATURES)
    out = _by_group(rows, estimates, keys)
    for i in range(p):
        rest = sum((F.col(f"l{i}_{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y{i}", (F.col(vector)[i] - F.col("m")[i] - rest) / F.col(f"l{i}_{i}"))
    return out.select(*rows.columns, reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(p)]).alias("d"))


def _concentrated(d: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One concentration step: estimates from each group's rows of least distance."""
    bound = cut_lineage(d.groupBy(*keys).agg(F.percentile_approx("d", SUBSET, 2000).alias("bound")))
    return cut_lineage(_moments(_by_group(d, bound, keys).where("d <= bound"), keys, "z", FLOORS))


def _starts(rows: DataFrame) -> DataFrame:
    """Each group's starting scatters of u, its location being the median (zero in u)."""
    p = len(FEATURES)
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    bounded = F.array(F.transform("u", lambda x: F.tanh(x)), F.transform("u", lambda x: x / F.greatest(length, F.lit(1e-9))))
    spread = _moments(rows.select(*KEY, F.posexplode(bounded).alias("start", "v")), STARTED, "v", [0.1] * p)
    zero = F.array(*[F.lit(0.0)] * p)
    spread = spread.withColumns({"start": F.col("start") + 1, "m": zero})
    plain = rows.select(*KEY).distinct().select(*KEY, F.lit(0).alias("start"), F.lit(0.0).alias("logdet"), zero.alias("m"), *[F.lit(float(i == j)).alias(f"l{i}_{j}") for i in range(p) for j in range(i + 1)])
    return cut_lineage(plain.unionByName(spread))


def _least(estimates: DataFrame) -> DataFrame:
    """Of each group's estimates the one of least determinant (ties: the earlier)."""
    rest = [c for c in estimates.columns if c not in STARTED]
    best = estimates.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.struct("logdet", "start")).alias("e"))
    return cut_lineage(best.select(*KEY, *[F.col("e")[c].alias(c) for c in rest]))


def determinant_estimates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The estimates of least determinant found for each group of ``rows`` (z, u), and all starts' after their first steps.

    Each round lowers some group's determinant, which the floors bound from below, so the rounds end.
    """
    each = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    d = _with_distance(each, _starts(rows), STARTED, "u")
    for k in range(FIRST_STEPS):
        tried = _concentrated(d, STARTED)
        if k < FIRST_STEPS - 1:
            d = _with_distance(each, tried, STARTED)
    best = _least(tried)
    while True:
        new = _concentrated(_with_distance(rows, best))
        fall = best.select(*KEY, F.col("logdet").alias("was")).join(new, KEY).agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        best = _least(best.withColumn("start", F.lit(0)).unionByName(new.withColumn("start", F.lit(1))))
        if fall is None or fall < SETTLED:
            return best, tried


def _scaled(stats: DataFrame) -> DataFrame:
    """The rows with z, the transformed statistics, and u, those from the group's medians in its robust deviations."""
    p = len(FEATURES)
    stats = cut_lineage(stats.withColumn("z", F.array(*features())))
    middle = stats.groupBy(*KEY).agg(*[F.percentile_approx(F.col("z")[i], 0.5, 2000).alias(f"m{i}") for i in range(p)])
    middle = cut_lineage(middle.select(*KEY, F.array(*[f"m{i}" for i in range(p)]).alias("m")))
    away = _by_group(stats, middle)
    spread = away.groupBy(*KEY).agg(*[F.percentile_approx(F.abs(F.col("z")[i] - F.col("m")[i]), 0.5, 2000).alias(f"a{i}") for i in range(p)])
    first = cut_lineage(middle.join(spread, KEY))
    u = [(F.col("z")[i] - F.col("m")[i]) / F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + FLOORS[i] ** 2) for i in range(p)]
    return cut_lineage(_by_group(stats, first).select(*stats.columns, F.array(*u).alias("u")))


def outlier_distances(stats: DataFrame) -> DataFrame:
    """The rows with ``d``: squared robust distance from their group, scaled so that its median is chi-square's.

    Sources of fewer than LEAST_GROUP rows are pooled within their language, never over languages; where that pool is as
    small, six variances and their correlations cannot be told from so few rows, and d is null.
    """
    sizes = cut_lineage(stats.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")))
    small = F.col("rows") < LEAST_GROUP
    pools = cut_lineage(sizes.withColumn("pool", F.sum(F.when(small, F.col("rows"))).over(Window.partitionBy("g_lang"))))
    stats = _by_group(stats, pools).withColumns({"g_source": F.when(small, F.lit(POOLED)).otherwise(F.col("g_source")), "few": small & (F.col("pool") < LEAST_GROUP)}).drop("rows", "pool")
    stats = cut_lineage(stats)
    rows = _scaled(stats.where("not few").drop("few"))
    best, _ = determinant_estimates(rows)
    d = _with_distance(rows, best).drop("u")
    scale = cut_lineage(d.groupBy(*KEY).agg(F.percentile_approx("d", 0.5, 2000).alias("half")))
    far = _by_group(d, scale).withColumn("d", F.col("d") * CHI2_MEDIAN / F.greatest(F.col("half"), F.lit(CHI2_MEDIAN / 4))).drop("half", "z")
    return far.unionByName(stats.where("few").drop("few").withColumn("d", F.lit(None).cast("double")))


def judged(docs: DataFrame, cutoff: float = CUTOFF, **columns) -> DataFrame:
    """Fingerprint, counts, base_failed, distance and kept of every row, without the texts.

    Documents that fail the base rules are rejected and take no part in the estimates. Null and
    empty texts fail them. Null languages and sources are groups of their own; sources of fewer than
    LEAST_GROUP passing documents are pooled within their language, and where such a pool has fewer itself its
    documents are kept, without a distance. Repeated rows and null ids are judged like others.
    An empty table gives no rows; other columns are ignored.
    """
    stats = statistics(docs, **columns)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = cut_lineage(stats.withColumn("base_failed", failed))
    far = outlier_distances(stats.where("not base_failed"))
    names = [c for c in stats.columns if c not in KEY]
    passing = far.select(*names, F.col("d").alias("distance"), F.coalesce(F.col("d") <= cutoff, F.lit(True)).alias("kept"))
    failing = stats.where("base_failed").select(*names, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return passing.unionByName(failing)


def verdicts(docs: DataFrame, cutoff: float = CUTOFF, **columns) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    return judged(docs, cutoff, **columns).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def passing(docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that ``judged`` keeps, all their columns as they are.

    Rows alike in id, text, language and source have one verdict, so verdicts return by those (the last three as a fingerprint), null ids too. Only
    the rejected take part in that join. Nulls, repeats and empty tables as in judged.
    """
    columns = {"id_col": id_col, "text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    id_, print_ = common.fresh(docs, "_id"), common.fresh(docs, "_print")
    gone = judged(docs, cutoff, **columns).where("not kept").select(F.col("doc_id").alias(f"{id_}r"), F.col("print").alias(f"{print_}r")).distinct()
    tagged = docs.withColumns({id_: docs[id_col].cast("long"), print_: fingerprint(docs, text_col, lang_col, source_col)})
    return tagged.join(gone, F.col(id_).eqNullSafe(F.col(f"{id_}r")) & (F.col(print_) == F.col(f"{print_}r")), "left_anti").select(*docs.columns)
