"""Entity matching: by keys and years, by similarity with a margin, and by the cascade of rules for forecasts.

Candidates are summed by their keys before items meet them, so a common title costs an item one row, not one for
each entity that bears it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import written
from .similarity import letter_bags, similar_pairs


def match_title_year(items: DataFrame, names: DataFrame) -> DataFrame:
    """(item, status, method, entity): one entity of an equal key with a year at most one off (or unknown) is a match, several are ambiguous.

    ``items`` are (item, keys, year), ``names`` (entity, key, year), with a row for every name of an entity.
    """
    known = names.groupBy("key", F.col("year").alias("known")).agg(F.min("entity").alias("a_"), F.max("entity").alias("b_"))
    asked = items.select("item", "year", F.explode("keys").alias("key"))
    near = F.abs(F.col("known") - F.col("year")) <= 1
    found = asked.join(known, "key").where(F.coalesce(near, F.lit(True)))
    exact = F.coalesce(F.col("known") == F.col("year"), F.lit(False))
    best = found.groupBy("item").agg(F.min("a_").alias("a_"), F.max("b_").alias("b_"), F.bool_or(exact).alias("exact_"))
    one = F.col("a_") == F.col("b_")
    out = items.select("item").join(best, "item", "left")
    status = F.when(F.col("a_").isNull(), "not_found").when(one, "matched").otherwise("ambiguous")
    method = F.when(one & F.col("exact_"), "title_year_exact").when(one, "title_year_near_or_missing").otherwise("title_year")
    return out.select("item", status.alias("status"), method.alias("method"), F.when(one, F.col("a_")).alias("entity"))


def match_pages(pages: DataFrame, movies: DataFrame) -> DataFrame:
    """(page, movie, status, method, score): whether a candidate page is the movie that it was fetched for.

    ``pages`` are (page, movie, page_id, page_key, page_year), ``movies`` (movie, known_id, key, year). Equal ids decide; else equal titles
    with years at most one off or unknown do, with a score of 1 for equal years (or none on either side) and 0.75 otherwise. Pages of
    unknown movies are not found.
    """
    joined = pages.join(movies.withColumn("there_", F.lit(True)), "movie", "left")
    same_id = F.coalesce((F.col("page_id") == F.col("known_id")) & (F.col("page_id") != ""), F.lit(False))
    near = F.coalesce(F.abs(F.col("page_year") - F.col("year")) <= 1, F.lit(True))
    same_title = F.coalesce((F.col("page_key") == F.col("key")) & (F.col("page_key") != ""), F.lit(False)) & near
    found = F.col("there_").isNotNull() & (same_id | same_title)
    method = F.when(found & same_id, "id").when(found, "title_year").otherwise("rejected")
    score = F.when(found & same_id, 1.0).when(found, F.when(F.col("page_year").eqNullSafe(F.col("year")), 1.0).otherwise(0.75))
    return joined.select("page", "movie", F.when(found, "matched").otherwise("not_found").alias("status"), method.alias("method"), score.alias("score"))


#: Points for years that are so far apart; others count -30, which no title makes up for.
YEAR_POINTS = (30.0, 20.0, 10.0)
UNKNOWN_YEAR, KNOWN_ID = 5.0, 10.0
#: Points between two levels down to which pairs are looked for.
STEP = 12.0


def match_scored(items: DataFrame, records: DataFrame, least: float = 100.0, sure: float = 130.0, margin: float = 8.0, **bounds: int) -> DataFrame:
    """(item, entity, score, status): the best record by similarity of titles, nearness of years and known ids.

    ``items`` are (item, key, year), ``records`` (entity, key, year, has_id). The score is 100 times the ratio of matching blocks, and
    points for years and a known id. What points leave open to ``least`` is the least ratio of titles, so titles meet by
    year and by ``similar_pairs``. Equal titles meet once, however many bear them. A best
    score under ``sure``, or one less than ``margin`` ahead of the next, is ambiguous; of equal scores the smallest
    entity is named. ``least`` has to be over 80, what an equal title with a wrong year and an id can reach.

    Pairs are looked for down to ``sure - margin`` first: a best score from ``sure`` has every next one that counts there, and a lower one is
    ambiguous whatever comes next. Only titles without any go on to the levels below, down to ``least``, so no result depends on the levels.
    """
    if least <= 100 - 30 + KNOWN_ID:
        raise ValueError("least has to be over 80")
    known_id = [(F.lit(i), i * KNOWN_ID) for i in (0, 1)]

    def cell(year: Column, step: int | None, with_id: Column, points: Column | float) -> Column:
        where = F.concat_ws("|", year.cast("string"), F.lit("?" if step is None else str(step)), with_id.cast("string"))
        return F.struct(where.alias("cell"), F.lit(points).alias("points") if isinstance(points, float) else points.alias("points"))

    asked, year = items.select("key", "year").distinct(), F.col("year")
    near = [cell(year + d, abs(d), i, p + more) for d in range(-2, 3) for p in [YEAR_POINTS[abs(d)]] for i, more in known_id]
    dated = [cell(F.lit("none"), None, i, UNKNOWN_YEAR + more) for i, more in known_id]
    undated = [cell(F.lit("any"), None, i, UNKNOWN_YEAR + more) for i, more in known_id]
    asked = asked.where("key <> ''").withColumn("at", F.explode(F.when(year.isNull(), F.array(*undated)).otherwise(F.array(*near, *dated)))).select("key", "year", "at.*")

    known = records.groupBy("key", "year", F.coalesce("has_id", F.lit(False)).cast("int").alias("id_")).agg(F.min("entity").alias("entity"), F.count("*").alias("n_"))
    more = F.col("id_") * KNOWN_ID
    own = [cell(year, step, F.col("id_"), F.lit(p) + more) for step, p in enumerate(YEAR_POINTS)]
    any_ = cell(F.lit("any"), None, F.col("id_"), F.lit(UNKNOWN_YEAR) + more)
    none = cell(F.lit("none"), None, F.col("id_"), F.lit(UNKNOWN_YEAR) + more)
    known = known.withColumn("at", F.explode(F.when(year.isNull(), F.array(any_, none)).otherwise(F.array(any_, *own))))
    known = known.where("key <> ''").groupBy("key", "at").agg(F.min("entity").alias("entity"), F.sum("n_").alias("n_")).select("key", "at.*", "entity", "n_")
    asked, known = written(asked, "asked"), written(known, "known")
    bags, found, level = letter_bags(asked.select("key").union(known.select("key"))), None, max(least, sure - margin)
    while True:
        sides = [df.select(F.col("key").alias("id"), "key", "cell", ((F.lit(level) - F.col("points")) / 100).alias("least")).distinct() for df in (asked, known)]
        pairs = similar_pairs(*sides, **bounds, bags=bags)
        some = asked.join(pairs, (F.col("key") == F.col("left")) & (asked["cell"] == pairs["cell"])).select("key", "year", "right", pairs["cell"], (100 * F.col("ratio") + F.col("points")).alias("score"))
        some = written(some.join(known.select(F.col("key").alias("right"), "cell", "entity", "n_"), ["right", "cell"]).where(F.col("score") >= level), "scored")
        found = some if found is None else found.unionByName(some)
        if level <= least:
            break
        done = some.select(F.col("key").alias("key_"), F.col("year").alias("year_")).distinct()
        asked = written(asked.join(done, (F.col("key") == F.col("key_")) & F.col("year").eqNullSafe(F.col("year_")), "left_anti"), "asked")
        level = max(least, level - STEP)
    w = Window.partitionBy("key", "year").orderBy(F.desc("score"), "entity")
    best = found.withColumn("p_", F.row_number().over(w)).where("p_ <= 2").groupBy("key", "year")
    first = lambda c: F.max(F.when(F.col("p_") == 1, F.col(c)))
    next_ = F.when(first("n_") > 1, first("score")).otherwise(F.max(F.when(F.col("p_") == 2, F.col("score"))))
    best = best.agg(first("entity").alias("entity"), first("score").alias("score"), next_.alias("next_")).withColumnsRenamed({"key": "key_", "year": "year_"})
    out = items.join(best, (F.col("key") == F.col("key_")) & F.col("year").eqNullSafe(F.col("year_")))
    status = F.when(F.col("score") < sure, "ambiguous").when(F.col("score") - F.col("next_") < margin, "ambiguous").otherwise("matched")
    return out.select("item", "entity", "score", status.alias("status"))


def match_forecasts(forecasts: DataFrame, movies: DataFrame, overrides: DataFrame, source_ids: DataFrame) -> DataFrame:
    """(forecast, status, method, movie): override, equal title and release date, the only equal title, the nearest year, source id, a provisional movie, ambiguous.

    ``forecasts`` are (forecast, key, target, opening, source_id), ``movies`` (movie, key, released, listed),
    ``overrides`` (key, movie) and ``source_ids`` (source_id, movie). Movies that aren't listed are provisional. A
    forecast with a key but no candidate provisions one, shared by all forecasts of its source id or key.
    """
    first = lambda: F.min(F.struct((~F.col("listed")).cast("int").alias("u_"), F.col("movie").alias("m_")))
    dated = movies.where("released IS NOT NULL").groupBy("key", F.col("released").alias("target")).agg(first().alias("dated_"))
    single = movies.groupBy("key").agg(F.count("*").alias("n_"), first().alias("only_"))
    years = movies.groupBy("key", F.year("released").alias("y_")).agg(F.count("*").alias("ny_"), F.count_if("listed").alias("nl_"), first().alias("first_"))
    out = forecasts.join(overrides.groupBy("key").agg(F.min("movie").alias("over_")), "key", "left")
    out = out.join(dated, ["key", "target"], "left").join(single, "key", "left")
    out = out.join(source_ids.groupBy("source_id").agg(F.min("movie").alias("sourced_")), "source_id", "left")
    off = F.abs(F.coalesce(F.col("y_"), F.year("target")) - F.year("target"))
    near = forecasts.select("forecast", "key", "target").join(years, "key").withColumn("off_", off)
    least = near.withColumn("least_", F.min("off_").over(Window.partitionBy("forecast"))).where("off_ = least_")
    least = least.groupBy("forecast").agg(F.sum("ny_").alias("ny_"), F.sum("nl_").alias("nl_"), F.min("first_").alias("near_"))
    out = out.join(least, "forecast", "left")
    by_year = (F.col("nl_") == 1) | (F.col("ny_") == 1)
    steps = [
        (F.col("over_").isNotNull(), "override", F.struct(F.lit(0).alias("u_"), F.col("over_").alias("m_"))),
        (F.col("opening") & F.col("dated_").isNotNull(), "normalized_exact_release_date", F.col("dated_")),
        (F.col("n_") == 1, "normalized_exact", F.col("only_")),
        ((F.col("n_") > 1) & by_year, "normalized_exact_release_year", F.col("near_")),
        (F.col("sourced_").isNotNull(), "source_id", F.struct(F.lit(0).alias("u_"), F.col("sourced_").alias("m_"))),
    ]
    chosen, method = F.lit(None).cast("struct<u_:int,m_:bigint>"), F.lit(None).cast("string")
    for rule, name, value in reversed(steps):
        chosen, method = F.when(rule, value.cast("struct<u_:int,m_:bigint>")).otherwise(chosen), F.when(rule, name).otherwise(method)
    provision = method.isNull() & F.col("n_").isNull() & F.col("key").isNotNull()
    status = F.when(provision, "provisional").when(method.isNull(), "ambiguous").when(chosen["u_"] == 1, "provisional").otherwise("matched")
    made = F.xxhash64(F.coalesce(F.concat(F.lit("id:"), F.col("source_id")), F.concat(F.lit("key:"), F.col("key"))))
    return out.select("forecast", status.alias("status"), F.when(provision, "provisioned").otherwise(method).alias("method"), F.when(provision, made).otherwise(chosen["m_"]).alias("movie"))
