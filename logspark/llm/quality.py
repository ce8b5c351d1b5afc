"""Quality rules: fixed limits, and robust multivariate outliers per language and source.

For each (language, source) group, each language and all rows, a minimum-covariance-determinant
estimate is fitted to transformed statistics. Deterministic starts (spreads alone, plain moments,
moments of squashed values and of directions) each take concentration steps, which refit mean and
covariance on the share of rows that lie nearest; the start that reaches the least determinant is
kept and refined, and scaled so that the median of the distances is at most the chi-square median. A group's
estimate is shrunk towards its language's, and that towards the one of all rows. A fit of n rows weighs n² against
PRIOR² of the wider one, at all sizes: that of a few rows can't leave its own outliers out. A row is rejected when its Mahalanobis distance to its
group's shrunk estimate is beyond the chi-square quantile of the tail probability.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ids_are_keys, materialize, release, text_of

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Share of a group that a fit keeps, concentration steps of every start and of the best one, and the rows at which a fit weighs as much as the wider one: five a feature.
KEEP_SHARE, STEPS, MORE_STEPS, PRIOR = 0.75, 2, 2, 20
STARTS = 4
#: Tail probability of the chi-square distribution beyond which a row is an outlier. It is this small as text statistics have heavier tails than a normal distribution.
TAIL = 1e-20


def chi2_quantile(tail: float) -> float:
    """The value that a chi-square variable of four degrees of freedom exceeds with this probability: (1 + x / 2) exp(-x / 2) = tail."""
    low, high = 0.0, 2000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if math.log1p(mid / 2) - mid / 2 > math.log(tail) else (low, mid)
    return low


CUTOFF = chi2_quantile(TAIL)
#: Smallest standard deviation of each feature, so that constant statistics keep the covariance regular.
FEATURES = {"f_words": 0.1, "f_length": 0.1, "f_symbols": 0.05, "f_lines": 0.05}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The contract's counts beside the columns in keep; a null text has no words."""
    text = text_of()
    rows = docs.select(*keep, text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    rows = rows.select(
        *keep,
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.instr("t", "\n") > 0, lines).otherwise(F.array().cast("array<string>")).alias("lines"),
        words_of(F.col("t")).alias("words"),
    )
    n = F.size("words")
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    rows = rows.select(
        *keep, "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("h"),
    )
    # windows found twice or more, by position: neighbours in the sorted list of (hash, position)
    twice = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(twice, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s, last = F.col("s"), F.size("s") - 1
    same = lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"])) | ((j < last) & (s[F.least(j + 1, last)]["h"] == s[j]["h"]))
    at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda j: s[j]["i"]))
    rows = rows.withColumn("p", F.when(s.isNotNull(), at))
    p = F.col("p")
    gaps = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW), lambda a, j: a + F.least(F.lit(WINDOW), p[j] - p[j - 1]))
    repeat = F.when(p.isNotNull(), gaps).otherwise(0).cast("long")
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"))


def features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words").alias("f_words"),
        F.log(1 + F.col("word_chars") / n).alias("f_length"),
        F.sqrt(F.col("n_symbols") / n).alias("f_symbols"),
        F.sqrt(F.col("n_dup_lines") / (1 + n / 10)).alias("f_lines"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance, by forward substitution with the group's Cholesky factor."""
    solved: list[Column] = []
    for i, name in enumerate(names):
        value = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * solved[j]
        solved.append(value / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for value in solved:
        total = total + value * value
    return total


def _factor(params: DataFrame, key: list[str], floors: list[Column]) -> DataFrame:
    """From columns m{i} and c{i}{j} (lower triangle) of a mean and covariance: m{i}, l{i}{j} of the Cholesky factor, and log_det. Variances get their floor added."""
    k = len(floors)
    for i in range(k):
        for j in range(i + 1):
            value = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0))
            for n in range(j):
                value = value - F.col(f"l{i}{n}") * F.col(f"l{j}{n}")
            if i == j:
                value = F.sqrt(F.greatest(value, F.lit(0.0)) + floors[i] * floors[i])
            else:
                value = value / F.col(f"l{j}{j}")
            params = params.withColumn(f"l{i}{j}", value)
    log_det = sum((F.log(F.col(f"l{i}{i}")) for i in range(k)), F.lit(0.0))
    return params.select(*key, *[f"m{i}" for i in range(k)], *[f"l{i}{j}" for i in range(k) for j in range(i + 1)], log_det.alias("log_det"))


def _moments(names: list[str]) -> list[Column]:
    k = len(names)
    return [F.avg(n).alias(f"m{i}") for i, n in enumerate(names)] + [F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i in range(k) for j in range(i + 1)]


def _starts(rows: DataFrame, gkey: list[str], names: list[str]) -> DataFrame:
    """(gkey, start, m{i}, c{i}{j}): the moments from which each start begins, of values scaled by median and spread."""
    z = [F.col(n) for n in names]
    norm = F.sqrt(sum((x * x for x in z), F.lit(1e-12)))
    each = [z, [F.tanh(x) for x in z], [x / norm for x in z]]
    kinds = F.array(*[F.struct(F.lit(k + 1).alias("start"), *[x.alias(f"t{i}") for i, x in enumerate(values)]) for k, values in enumerate(each)])
    shapes = rows.select(*gkey, F.explode(kinds).alias("s")).select(*gkey, "s.*").groupBy(*gkey, "start").agg(*_moments([f"t{i}" for i in range(len(z))]))
    # squashed values and directions give a shape about the median; spreads alone are one more start
    about = {f"m{i}": F.when(F.col("start") > 1, F.lit(0.0)).otherwise(F.col(f"m{i}")) for i in range(len(z))}
    plain = {f"m{i}": F.lit(0.0) for i in range(len(z))} | {f"c{i}{j}": F.lit(float(i == j)) for i in range(len(z)) for j in range(i + 1)}
    shapes = materialize(shapes.withColumns(about), "shapes")  # read twice
    return shapes.unionByName(shapes.filter("start = 1").withColumn("start", F.lit(0)).withColumns(plain))


def outliers(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """stats (columns group_lang, group_source and FEATURES) with d2, the scaled squared distance to the row's group.

    stats should be a written table: it is read once for each step. Every row counts in three fits, of
    its group, its language and all rows.
    """
    names, floors, key = list(FEATURES), list(FEATURES.values()), ["group_lang", "group_source"]
    # tables of parameters have a row for each fit and start; a group has three fits at most
    few = stats.select(*key).distinct().limit(BROADCAST_ROWS // (3 * STARTS) + 1).count() <= BROADCAST_ROWS // (3 * STARTS)
    near_by = F.broadcast if few else (lambda table: table)
    rows = stats.select(*key, *names).withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.withColumn("group_source", F.when(F.col("kind") == 0, F.col("group_source")).otherwise(""))
    rows = rows.withColumn("group_lang", F.when(F.col("kind") <= 1, F.col("group_lang")).otherwise(""))
    gkey, index = ["kind", *key], range(len(names))
    quartiles = [F.percentile_approx(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i, n in enumerate(names)]
    scale = rows.groupBy(*gkey).agg(*quartiles, F.count(F.lit(1)).alias("n"))
    spread = lambda i: F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + floors[i] ** 2)
    scale = materialize(scale.select(*gkey, "n", *[F.col(f"q{i}")[1].alias(f"mid{i}") for i in index], *[spread(i).alias(f"s{i}") for i in index], *[(floors[i] / spread(i)).alias(f"f{i}") for i in index]), "scale")
    scaled = [((F.col(n) - F.col(f"mid{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, n in enumerate(names)]
    z = rows.join(near_by(scale), gkey).select(*gkey, *scaled)
    zs, skey = [f"z{i}" for i in index], [*gkey, "start"]
    floor = [F.col(f"f{i}") for i in index]
    factor = lambda params: materialize(_factor(params.join(near_by(scale), gkey), skey, floor), "factor")

    def step(params: DataFrame) -> DataFrame:
        """Mean and covariance of the rows nearest to each start's present estimate."""
        scored = z.select(*gkey, *zs).join(near_by(params), gkey).select(*skey, *zs, _distance(zs).alias("d2"))
        near = scored.groupBy(*skey).agg(F.percentile_approx("d2", F.lit(KEEP_SHARE), 1000).alias("near"))
        out = factor(scored.join(near_by(near), skey).filter(F.col("d2") <= F.col("near")).groupBy(*skey).agg(*_moments(zs)))
        release(params)
        return out

    params = factor(_starts(z, gkey, zs))
    for _ in range(STEPS):
        params = step(params)
    least = params.groupBy(*gkey).agg(F.min(F.struct("log_det", "start")).alias("least")).select(*gkey, F.col("least.start").alias("start"))
    params = materialize(params.join(near_by(least), skey), "best")
    for _ in range(MORE_STEPS):
        params = step(params)
    scored = z.join(near_by(params), gkey).select(*gkey, _distance(zs).alias("d2"))
    middle = scored.groupBy(*gkey).agg(F.percentile_approx("d2", F.lit(0.5), 1000).alias("mid"))
    # groups that are closer than the distribution's middle to their floors are not stretched
    stretch = F.greatest(F.col("mid") / chi2_quantile(0.5), F.lit(1.0))
    known = params.join(near_by(scale), gkey).join(near_by(middle), gkey)
    mean = [(F.col(f"mid{i}") + F.col(f"s{i}") * F.col(f"m{i}")).alias(f"m{i}") for i in index]
    product = lambda i, j: sum((F.col(f"l{i}{t}") * F.col(f"l{j}{t}") for t in range(j + 1)), F.lit(0.0))
    spreads = [(F.col(f"s{i}") * F.col(f"s{j}") * product(i, j) * stretch).alias(f"c{i}{j}") for i in index for j in range(i + 1)]
    fits = materialize(known.select(*gkey, "n", *mean, *spreads), "fits")
    release(params, scale)
    everything = fits.filter("kind = 2").select("n", *[c for c in fits.columns if c[0] in "mc"])
    langs = _shrunk(fits.filter("kind = 1").drop("kind", "group_source").withColumn("any", F.lit(1)), everything.withColumn("any", F.lit(1)), ["any"]).drop("any")
    own = _shrunk(fits.filter("kind = 0").drop("kind"), langs, ["group_lang"])
    final = materialize(_factor(own, key, [F.lit(1e-9)] * len(names)), "shrunk")
    return stats.join(near_by(final), key).select(*stats.columns, _distance(names).alias("d2"))


def _shrunk(fits: DataFrame, wider: DataFrame, key: list[str]) -> DataFrame:
    """fits (n, m{i}, c{i}{j}) drawn towards the wider fit of their key."""
    values = [c for c in fits.columns if c[0] in "mc" and c[1:].isdigit()]
    share = F.col("n") * F.col("n") / (F.col("n") * F.col("n") + PRIOR**2)
    joined = fits.join(F.broadcast(wider.select(*key, *[F.col(c).alias(f"w_{c}") for c in values])) if key == ["any"] else wider.select(*key, *[F.col(c).alias(f"w_{c}") for c in values]), key)
    return joined.select(*[c for c in fits.columns if c not in values], *[(share * F.col(c) + (1 - share) * F.col(f"w_{c}")).alias(c) for c in values])


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2.

    A null or empty text has no words and fails the base rules. Null languages and sources form
    groups of their own. Rows that fail the base rules take no part in the fits. Repeated rows are
    judged apart and alike. Other columns are ignored.
    """
    return _verdicts(docs, cutoff)


def _groups() -> list[Column]:
    return [F.coalesce("lang", F.lit("\x00")).alias("group_lang"), F.coalesce("source", F.lit("\x00")).alias("group_source")]


def _verdicts(docs: DataFrame, cutoff: float, extra: list[Column] | None = None, names: list[str] | None = None) -> DataFrame:
    """The columns of quality_verdicts, then those of extra, called names."""
    names = names or []
    keep = ["group_lang", "group_source"]
    named = docs.select("doc_id", *_groups(), *(extra or []), "text")
    stats = statistics(named, list(dict.fromkeys(["doc_id", *keep, *names]))).withColumn("base_failed", base_failed())
    stats = materialize(stats.select("*", *features()), "statistics")
    judged = outliers(stats.filter("NOT base_failed"), cutoff)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = judged.select(*columns, (F.col("d2") <= cutoff).alias("kept"), F.col("d2").alias("distance2"), *names)
    bad = stats.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2"), *names)
    return good.unionByName(bad)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs without the rows that quality_verdicts rejects; columns as they were.

    Where doc_ids repeat or are missing, rows are told apart by doc_id, text, language and source:
    rows alike in all of them have one verdict.
    """
    if ids_are_keys(docs):
        rejected = materialize(quality_verdicts(docs, cutoff).filter("NOT kept").select("doc_id"), "rejected")
        return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"), F.sha2(text_of(), 256).alias("__digest"), *[g.alias(f"__group{i}") for i, g in enumerate(_groups())]]
    names = ["__id", "__digest", "__group0", "__group1"]
    rejected = materialize(_verdicts(docs, cutoff, key, names).filter("NOT kept").select(*names), "rejected").distinct()
    return docs.select("*", *key).join(rejected, names, "left_anti").select(*docs.columns)
