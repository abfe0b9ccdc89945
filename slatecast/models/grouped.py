"""Least squares of several terms for each of many groups, summed and solved in executors.

One pass adds up the products of all columns by group; every model over these columns is then read off the sums. The normal equations
of a group are eliminated, with the largest pivot first, by array functions in its row, so thousands of groups are
solved where they are and nothing but the group's sums is ever held. Columns are shifted by their means over all rows
before they are multiplied, which keeps the digits of columns that are far from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let, two_sided_p

#: A pivot of the correlation matrix under this makes a group's terms dependent.
DEPENDENT = 1e-10


def cross_moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, n, shift, s_ (sums) and q_ (sums of products, the upper triangle by rows) of ``columns``; rows with a null are passed over."""
    rows = df.dropna(subset=list(columns)).select(*keys, *(F.col(c).cast("double").alias(f"c{k}_") for k, c in enumerate(columns)))
    centre = rows.agg(*(F.coalesce(F.avg(f"c{k}_"), F.lit(0.0)).alias(f"m{k}_") for k in range(len(columns)))).first()
    x = [F.col(f"c{k}_") - F.lit(centre[k]) for k in range(len(columns))]
    sums = F.array(*(F.sum(v) for v in x)).alias("s_")
    products = F.array(*(F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x)))).alias("q_")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*map(F.lit, centre)).alias("shift"), sums, products)


def _eliminated(rows: Column, size: int) -> Column:
    """Gauss and Jordan on ``size`` rows that are longer than ``size``; null where a pivot is too small."""

    def step(a: Column, k: Column) -> Column:
        tried = F.transform(F.sequence(k, F.lit(size - 1)), lambda i: F.struct(F.abs(a[i][k]).alias("v"), (-i).alias("i")))

        def with_pivot(best: Column) -> Column:
            at = -best["i"]

            def cleared(pivot: Column) -> Column:
                swapped = F.transform(a, lambda row, i: F.when(i == k, pivot).when(i == at, a[k]).otherwise(row))
                return F.transform(swapped, lambda row, i: F.when(i == k, row).otherwise(F.zip_with(row, pivot, lambda x, y: x - row[k] * y)))

            return F.when(best["v"] > DEPENDENT, let(F.transform(a[at], lambda x: x / a[at][k]), cleared))

        return let(F.array_max(tried), with_pivot)

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), rows, step)


def fits(sums: DataFrame, columns: Sequence[str], terms: Sequence[str], target: str) -> DataFrame:
    """keys, n, r2, sse, terms, beta and se (arrays, the intercept first) of the model of ``target`` on ``terms`` in each group.

    ``sums`` are the cross moments of ``columns``. Groups whose terms depend on each other, or that have no more rows than
    coefficients, have null beta, se, r2 and sse; where the target doesn't vary, r2 is 0.
    """
    p, width = len(terms), len(columns)
    at = F.array(*(F.lit(columns.index(t)) for t in terms))
    y = columns.index(target)
    n = F.col("n").cast("double")

    def mean(i: Column) -> Column:
        return F.col("s_")[i] / n

    def spread(i: Column, j: Column) -> Column:
        a, b = F.least(i, j), F.greatest(i, j)
        return F.col("q_")[(a * (2 * width - a - 1) / 2 + b).cast("int")] / n - mean(i) * mean(j)

    yy = spread(F.lit(y), F.lit(y))
    out = sums.withColumn("sd_", F.transform(at, lambda i: F.sqrt(F.greatest(spread(i, i), F.lit(0.0))))).withColumn("yy_", F.greatest(yy, F.lit(0.0)))
    # standardised rows: correlations, correlation with the target, and a row of the identity
    scale = F.col("sd_")
    corr = lambda i: F.transform(at, lambda j, k: F.try_divide(spread(at[i], j), scale[i] * scale[k]))
    own = lambda i: F.array(F.try_divide(spread(at[i], F.lit(y)), scale[i]))
    unit = lambda i: F.transform(at, lambda _, k: F.when(k == i, 1.0).otherwise(0.0))
    augmented = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.concat(corr(i), own(i), unit(i)))
    square = lambda i: spread(i, i) + mean(i) * mean(i)
    varies = F.forall(at, lambda i: spread(i, i) > DEPENDENT * square(i)) & (F.col("n") > p + 1)
    out = out.withColumn("a_", F.when(varies, _eliminated(augmented, p)))
    slopes = F.transform("a_", lambda row, i: row[p] / scale[i])
    out = out.withColumn("b_", slopes)
    explained = F.aggregate(F.transform("a_", lambda row, i: row[p] * spread(at[i], F.lit(y)) / scale[i]), F.lit(0.0), lambda t, v: t + v)
    out = out.withColumn("sse", F.when(F.col("a_").isNotNull(), F.greatest(n * (F.col("yy_") - explained), F.lit(0.0))))
    out = out.withColumn("r2", F.when(F.col("yy_") > 0, 1 - F.col("sse") / (n * F.col("yy_"))).when(F.col("a_").isNotNull(), 0.0))
    noise = F.col("sse") / (n - p - 1)
    whole = F.transform(at, lambda i, _: F.col("shift")[i] + mean(i))
    out = out.withColumn("m_", whole)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
    intercept = F.col("shift")[y] + mean(F.lit(y)) - dot(F.col("b_"), F.col("m_"))
    # m' S^-1 m with S^-1 = D^-1 R^-1 D^-1
    lean = F.transform("m_", lambda m, i: m / scale[i])
    pull = dot(lean, F.transform("a_", lambda row, i: dot(F.slice(row, F.lit(p + 2), F.lit(p)), lean)))
    se = F.transform("a_", lambda row, i: F.sqrt(noise * row[F.lit(p + 1) + i] / n) / scale[i])
    solved = F.col("a_").isNotNull()
    return out.select(
        *(c for c in sums.columns if c not in ("n", "shift", "s_", "q_")), "n", "r2", "sse", F.array(F.lit("intercept"), *map(F.lit, terms)).alias("terms"),
        F.when(solved, F.concat(F.array(intercept), "b_")).alias("beta"), F.when(solved, F.concat(F.array(F.sqrt(noise * (1 + pull) / n)), se)).alias("se"),
    )


def coefficient_rows(fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, term, beta, se, t and the two-sided p by the normal distribution; t and p are null without an error."""
    rows = fitted.where("beta IS NOT NULL").select(*keys, "n", F.explode(F.arrays_zip("terms", "beta", "se")).alias("c")).select(*keys, "n", F.col("c.terms").alias("term"), "c.beta", "c.se")
    t = F.when(F.col("se") > 0, F.col("beta") / F.col("se"))
    return rows.withColumn("t", t).withColumn("p", two_sided_p(F.col("t")))


def predicted(df: DataFrame, fitted: DataFrame, keys: Sequence[str], terms: Sequence[str], name: str = "predicted") -> DataFrame:
    """Adds the prediction of each row's group; null where the group has no fit. Keys that are null meet each other."""
    side = fitted.select(*(F.col(k).alias(f"{k}_f_") for k in keys), F.col("beta").alias("beta_f_"))
    out = df.join(side, [df[k].eqNullSafe(side[f"{k}_f_"]) for k in keys], "left") if keys else df.crossJoin(F.broadcast(side))  # one row
    said = F.col("beta_f_")[0]
    for k, t in enumerate(terms, 1):
        said = said + F.col("beta_f_")[k] * F.col(t)
    return out.withColumn(name, said).drop("beta_f_", *(f"{k}_f_" for k in keys))


def judged(rows: DataFrame, keys: Sequence[str], target: str, before: str | None = None, name: str = "predicted") -> DataFrame:
    """keys, test_n, rmse, mae, r2 and, with a column of values before, directional: the share of rows whose change has the predicted sign."""
    seen = rows.where(F.col(name).isNotNull() & F.col(target).isNotNull())
    e = F.col(target) - F.col(name)
    total = F.var_pop(target) * F.count("*")
    measures = [F.count("*").alias("test_n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(total > 0, 1 - F.sum(e * e) / total).otherwise(0.0).alias("test_r2")]
    if before:
        measures.append(F.avg((F.signum(F.col(target) - F.col(before)) == F.signum(F.col(name) - F.col(before))).cast("double")).alias("directional"))
    return seen.groupBy(*keys).agg(*measures)


def bundle(fitted: dict[str, DataFrame]) -> DataFrame:
    """(model, priority, terms, beta) of fits without keys, in order of preference; models without a solution are left out."""
    out = None
    for k, (name, one) in enumerate(fitted.items()):
        row = one.where("beta IS NOT NULL").select(F.lit(name).alias("model"), F.lit(k).alias("priority"), "terms", "beta")
        out = row if out is None else out.unionByName(row)
    return out


def served(df: DataFrame, models: DataFrame, features: Sequence[str], name: str = "predicted") -> DataFrame:
    """Adds ``model`` and ``name``: each row's prediction by the first model of a bundle whose terms the row all has; both null where there is none."""
    held = models.agg(F.sort_array(F.collect_list(F.struct("priority", "model", "terms", "beta"))).alias("models_"))  # one row, some models
    has = F.create_map(*(v for f in features for v in (F.lit(f), F.col(f).cast("double"))))
    slopes = lambda m: F.slice(m["terms"], F.lit(2), F.size(m["terms"]))
    fits_row = F.filter("models_", lambda m: F.forall(slopes(m), lambda t: has[t].isNotNull()))

    def said(m: Column) -> Column:
        parts = F.zip_with(slopes(m), F.slice(m["beta"], F.lit(2), F.size(m["beta"])), lambda t, b: has[t] * b)
        return F.struct(m["model"].alias("model"), (F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) + m["beta"][0]).alias("said"))

    out = df.crossJoin(F.broadcast(held)).withColumn("said_", let(F.get(fits_row, F.lit(0)), said))
    return out.select(*df.columns, F.col("said_.model").alias("model"), F.col("said_.said").alias(name))
