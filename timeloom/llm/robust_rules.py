"""Quality rules: base counts, then robust multivariate outliers for each language and source.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm.support import clean_text, cut, join_checked, written

#: The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Words of the windows whose repetition counts.
WINDOW = 5

#: The statistic vector. Each entry is held in units of 1 / UNIT, so sums are exact.
VECTOR = ["q_length", "q_symbols", "q_lines", "q_repeats"]
UNIT = 256
#: Standard deviations below which an entry's spread is not taken to be.
FLOORS = [0.15, 0.40, 0.45, 0.50]
#: Words added to a document's own when shares are taken, so that one mark in a short text is no outlier.
PRIOR_WORDS = 20
PRIOR_CHARS = 6.0

#: Part of a group that the covariance is fitted to, and the factor that makes it consistent
#: for a normal law of four entries: SUBSET over the chi-square law of six at its own quantile.
SUBSET, CONSISTENCY = 0.6, 1.82
#: Quantiles of the entries at which the searches of a group start.
STARTS = [0.25, 0.5, 0.75]
#: Classes of a factor of two in squared distance; rows of one class enter a subset together.
CLASSES = 1024
#: Rows that a language lends to each of its sources, and the table to each language.
LENT = 100
#: Rounds of concentration at most; each settles long before.
MAX_ROUNDS = 60
#: The squared distance of an outlier: the 0.9999 quantile of the chi-square law of four entries.
CUT = 23.51


def base_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts.

    A text's windows are hashed; only if two hashes are equal are they sorted with their
    positions, so that equal ones stand together. A null text has no words.
    """
    text = documents.select("doc_id", "lang", "source", clean_text(F.col("text")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = text.select("doc_id", "lang", "source", F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("words"))
    n = F.size("words")
    grams = F.when(
        n > WINDOW,
        F.transform(F.slice("words", 1, n - (WINDOW - 1)), lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, WINDOW)))),
    )
    counted = held.select(
        "doc_id", "lang", "source", "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("grams"),
    )
    placed = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    ordered = counted.withColumn("placed", placed)

    def twin(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("placed", i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("placed", i + 1)["g"] == x["g"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("placed", twin), lambda x: x["i"]))
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate(starts, begin, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")))["total"]
    return ordered.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def statistic_vector(counts: DataFrame) -> DataFrame:
    """The counts with the vector's entries: mean word length and shares of words, on log scales."""
    words = F.col("n_words") + PRIOR_WORDS

    def held(x: Column) -> Column:
        return F.round(x * UNIT).cast("long")

    return counts.withColumns({
        "q_length": held(F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_CHARS) / words)),
        "q_symbols": held(F.log1p(100 * F.col("n_symbols") / words)),
        "q_lines": held(F.log1p(100 * F.col("n_dup_lines") / words)),
        "q_repeats": held(F.log1p(100 * F.col("n_repeat_words") / words)),
    })


_PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]


_MEANS = [f"m{i}" for i in range(len(VECTOR))]
_COVARIANCES = [f"c{i}_{j}" for i, j in _PAIRS]
_SUMS = ["n", *(f"s{i}" for i in range(len(VECTOR))), *(f"s{i}_{j}" for i, j in _PAIRS)]


def _estimated(moments: DataFrame, *keys: str) -> DataFrame:
    """Means, and covariances with their floors, from exact sums."""
    n = F.col("n").cast("double")
    out = moments.withColumns({m: F.col(f"s{i}") / n / UNIT for i, m in enumerate(_MEANS)})
    for i, j in _PAIRS:
        value = (F.col(f"s{i}_{j}") / n / UNIT / UNIT - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
        out = out.withColumn(f"c{i}_{j}", F.greatest(value, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else value)
    return out.select(*keys, *_MEANS, *_COVARIANCES)


def _factored(estimate: DataFrame) -> DataFrame:
    """The estimates with their Cholesky factors, and ``det``, the determinant."""
    out = estimate
    for i, j in _PAIRS:
        value = F.col(f"c{i}_{j}")
        for k in range(j):
            value = value - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 4))) if i == j else value / F.col(f"l{j}_{j}"))
    det = F.lit(1.0)
    for i in range(len(VECTOR)):
        det = det * F.col(f"l{i}_{i}") * F.col(f"l{i}_{i}")
    return out.withColumn("det", det)


def _squared_distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` by forward substitution with the group's factor."""
    out, total = rows, F.lit(0.0)
    for i, q in enumerate(VECTOR):
        y = F.col(q) / UNIT - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}_{k}") * F.col(f"_y{k}")
        out = out.withColumn(f"_y{i}", y / F.col(f"l{i}_{i}"))
        total = total + F.col(f"_y{i}") * F.col(f"_y{i}")
    return out.withColumn("d2", total).drop(*(f"_y{i}" for i in range(len(VECTOR))))


def _moments(cells: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(F.col(q) * F.col("n")).alias(f"s{i}") for i, q in enumerate(VECTOR)]
    cross = [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j]) * F.col("n")).alias(f"s{i}_{j}") for i, j in _PAIRS]
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), *sums, *cross)


def minimum_covariance(cells: DataFrame) -> DataFrame:
    """(grp, size, means, covariances) of the minimum-covariance-determinant estimate of each ``grp``.

    ``cells`` are distinct vectors of a group and the number ``n`` of their rows. A round of
    concentration ranks a group's rows by their distance to the present estimate, takes the
    nearest ``SUBSET`` of them and fits the next estimate to these. The covariance is that of
    the subset, made consistent, plus the floors: a fixed multiple and a fixed target, for which
    such rounds never raise the determinant (minimum regularized covariance determinant). They
    go on until no group's subset changes (an error after ``MAX_ROUNDS``), from each of the ``STARTS`` (the entries' quantiles,
    with the floors as spread), and the least determinant of the three is kept.

    Ranks come from counts by distance class, 1024 to a factor of two, so no task holds a
    group's rows; rows of the class that fills the subset enter together. Sums are exact
    integers, so the outcome does not depend on partitioning.
    """
    sizes = cut(cells.groupBy("grp").agg(F.sum("n").alias("size"), *(F.percentile(q, F.array(*map(F.lit, STARTS)), F.col("n")).alias(q) for q in VECTOR)))
    begin = sizes.select("grp", F.explode(F.sequence(F.lit(0), F.lit(len(STARTS) - 1))).alias("start"), *VECTOR)
    spread = {f"c{i}_{j}": F.lit(FLOORS[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}
    estimate = begin.select("grp", "start", *((F.get(q, F.col("start")) / UNIT).alias(m) for q, m in zip(VECTOR, _MEANS, strict=True)), *(v.alias(k) for k, v in spread.items()))
    cells = cells.join(sizes.select("grp", "size"), "grp")
    mark = None
    for _ in range(MAX_ROUNDS):
        placed = _squared_distance(join_checked(cells, _factored(estimate), ["grp"], "inner"))
        sums = _moments(placed.withColumn("_class", F.floor(F.log2(F.col("d2") + 0.001) * CLASSES)), "grp", "start", "size", "_class")
        upto = Window.partitionBy("grp", "start").orderBy("_class")
        inside = sums.withColumn("_before", F.sum("n").over(upto) - F.col("n")).where(F.col("_before") < SUBSET * F.col("size"))
        totals = cut(inside.groupBy("grp", "start").agg(*(F.sum(c).alias(c) for c in _SUMS)))
        new = totals.agg(F.bit_xor(F.xxhash64(*totals.columns))).first()[0]
        estimate = _estimated(totals, "grp", "start")
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"some subset still changes after {MAX_ROUNDS} rounds")
    best = _factored(estimate).groupBy("grp").agg(*(F.min_by(c, F.struct("det", "start")).alias(c) for c in (*_MEANS, *_COVARIANCES)))
    return best.join(sizes.select("grp", "size"), "grp")


def _lent(estimate: DataFrame, parents: DataFrame) -> DataFrame:
    """Estimates mixed with ``LENT`` rows of their parent's: the fewer rows, the more the parent counts."""
    names = [*_MEANS, *_COVARIANCES]
    both = join_checked(estimate, parents.select(F.col("grp").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in names)), ["parent"], "left")
    own = F.col("size") / (F.col("size") + LENT)

    def mixed(c: str, between: Column | float = 0.0) -> Column:
        return F.when(F.col(f"p_{c}").isNull(), F.col(c)).otherwise(own * F.col(c) + (1 - own) * F.col(f"p_{c}") + between)

    apart = [F.col(m) - F.col(f"p_{m}") for m in _MEANS]
    return both.select("grp", "size", *(mixed(m).alias(m) for m in _MEANS), *(mixed(f"c{i}_{j}", own * (1 - own) * apart[i] * apart[j]).alias(f"c{i}_{j}") for i, j in _PAIRS))


def robust_verdicts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    Texts of fewer than ten words, or with more than a fifth of their words in repeated
    windows, fail the base rules. The others are held against the robust estimate of their
    language and source (made from those alone), and go if their squared Mahalanobis distance
    exceeds ``CUT``. Every language and source has its own estimate, however few rows it has; it
    is mixed with ``LENT`` rows of its language's, and that with as many of the whole table's,
    whose weight fades as the rows of its own grow. So every row has a distance. A null language
    or source is one apart from an empty one. Rows are as many as the documents.

    Estimates are made from distinct vectors and their counts, which are far fewer than rows and
    do not grow in proportion: entries are held in steps of 1 / ``UNIT``.
    """
    counts = written(statistic_vector(base_counts(documents)).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))))
    fine, lang, table = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("[]")
    judged = counts.where("not base_failed").withColumn("grp", fine)
    cells = cut(judged.groupBy("lang", "grp", *VECTOR).agg(F.count(F.lit(1)).alias("n")))
    pools = cells.select(F.explode(F.array("grp", lang, table)).alias("grp"), *VECTOR, "n").groupBy("grp", *VECTOR).agg(F.sum("n").alias("n"))
    estimate = cut(minimum_covariance(cut(pools)))
    parent = cut(cells.select("grp", lang.alias("parent")).distinct())
    langs = _lent(estimate.join(parent.select(F.col("parent").alias("grp")).distinct(), "grp").withColumn("parent", table), estimate)
    final = _factored(_lent(estimate.join(parent, "grp"), langs)).drop("size", "det", *_COVARIANCES)
    measured = _squared_distance(join_checked(judged, final, ["grp"], "left"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = measured.select(*columns, (F.col("d2") <= CUT).alias("kept"), F.sqrt("d2").alias("distance"))
    failed = counts.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return passed.unionAll(failed)
