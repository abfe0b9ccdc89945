"""Every query of the plans against its SQL on the smallest tables."""

import hashlib
import math
import re
import unicodedata
import zlib
from datetime import date, datetime
from decimal import Decimal
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest

import __spark_entry__
from slatecast.plans import catalog
from slatecast.plans.evaluation import _LAG_MODELS, _NESTED, lag_models_frame
from slatecast.plans.forecasts import _PAIRS, RIDGE_ALPHAS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "null" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, bool) or not isinstance(v, int):
        return v.isoformat()[:19] if isinstance(v, datetime) else v.isoformat() if isinstance(v, date) else "null" if v is None else str(v)
    return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cur = duck.cursor().execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, cur.fetchall())


@pytest.fixture(scope="module")
def log_pairs(duck):
    return duck.execute(f"WITH {_PAIRS} SELECT o_custkey, year(day) AS yr, isodow(day) - 1 AS weekday, predicted, actual, ln(predicted) AS x, ln(actual) AS y FROM pairs WHERE actual > 0 AND predicted > 0").df()


def test_bootstrap_calibration(spark, log_pairs):
    got = catalog.QUERIES["bootstrap_calibration"](spark, SF).first()
    slope = np.polyfit(log_pairs.predicted, log_pairs.actual, 1)[0]
    assert got["repetitions"] == 80 and got["low"] < slope < got["high"] and abs(got["mean"] - slope) < 3 * got["se"]


def test_ridge_with_calendar(spark, log_pairs):
    got = catalog.QUERIES["ridge_with_calendar"](spark, SF).first()
    d = log_pairs.copy()
    early = d.yr < 2000
    d["z"] = (d.x - d.x[early].mean()) / d.x[early].std(ddof=0)
    x = np.column_stack([np.ones(len(d)), d.z, *((d.weekday == k).astype(float) for k in range(6))])
    a, y = x[early], d.y[early].to_numpy()
    best = None
    for alpha in RIDGE_ALPHAS:
        inverse = np.linalg.inv(a.T @ a + alpha * np.diag([0] + [1] * 7))
        e = (y - a @ inverse @ a.T @ y) / (1 - np.einsum("ij,jk,ik->i", a, inverse, a))
        best = min(best or (np.inf,), ((e**2).mean(), alpha, inverse @ a.T @ y), key=lambda f: f[0])
    e = x[~early] @ best[2] - d.y[~early].to_numpy()
    assert (got["alpha"], got["n"]) == (best[1], len(e))
    assert [got["rmse"], got["mae"], got["smearing"]] == pytest.approx([np.sqrt((e**2).mean()), np.abs(e).mean(), np.exp(-e).mean()], abs=1e-5)


def test_certainty_sample(spark, duck):
    got = catalog.QUERIES["certainty_sample"](spark, SF).toPandas()
    all_ = duck.execute("SELECT c_custkey, c_nationkey, c_acctbal FROM customer").df()
    top = all_.sort_values(["c_acctbal", "c_custkey"], ascending=[False, True]).head(30)
    rest = all_[~all_.c_custkey.isin(top.c_custkey)]
    assert set(got.c_custkey[got.is_certain]) == set(top.c_custkey) and (got.weight[got.is_certain] == 1).all()
    drawn = got[~got.is_certain]
    assert len(drawn) == min(145, len(rest)) and drawn.weight.sum() == pytest.approx(len(rest))
    for nation, part in drawn.groupby("c_nationkey"):
        pool = sorted(rest.c_custkey[rest.c_nationkey == nation], key=lambda k: hashlib.sha256(f"s2:{k}".encode()).hexdigest())
        assert set(part.c_custkey) == set(pool[: len(part)])


def test_nested_lag_models_and_bootstrap(spark):
    d = lag_models_frame(spark, SF).toPandas()
    got = catalog.QUERIES["nested_lag_models"](spark, SF).toPandas().set_index(["model", "term"])
    for model, terms in _NESTED.items():
        x = np.column_stack([np.ones(len(d)), *(d[t].astype(float) for t in terms)])
        beta, rss = np.linalg.lstsq(x, d.log_gross, rcond=None)[:2]
        se = np.sqrt(rss[0] / (len(d) - x.shape[1]) * np.diag(np.linalg.inv(x.T @ x)))
        mine = got.loc[model]
        assert mine.beta[["intercept", *terms]].to_numpy() == pytest.approx(beta, rel=1e-5)
        assert mine.se[["intercept", *terms]].to_numpy() == pytest.approx(se, rel=1e-4)
        assert mine.p[terms[0]] == pytest.approx(math.erfc(abs(beta[1] / se[1]) / math.sqrt(2)), rel=1e-3, abs=1e-12)
    b = catalog.QUERIES["alternating_bootstrap"](spark, SF).first()
    slope = np.polyfit(d.log_rivals_total, d.log_gross, 1)[0]
    assert b["repetitions"] == 80 and b["low"] < slope < b["high"]


def test_lag_hypotheses(spark):
    rows = lag_models_frame(spark, SF).toPandas()
    rows = rows.astype({t: float for t in _LAG_MODELS["amplified"]}).dropna(subset=[*_LAG_MODELS["amplified"], "log_gross"])
    days = np.array([d.toordinal() for d in rows.day])
    early = days <= np.floor(np.quantile(np.unique(days), 0.8))
    rmse, t, beta = {}, {}, {}
    for name, terms in _LAG_MODELS.items():
        x = np.column_stack([np.ones(len(rows)), rows[terms]])
        b, rss = np.linalg.lstsq(x[early], rows.log_gross[early], rcond=None)[:2]
        se = np.sqrt(rss[0] / (early.sum() - len(b)) * np.diag(np.linalg.inv(x[early].T @ x[early])))
        rmse[name] = np.sqrt(((rows.log_gross - x @ b)[~early] ** 2).mean())
        t[name], beta[name] = dict(zip(terms, (b / se)[1:], strict=True)), dict(zip(terms, b[1:], strict=True))
    got = {r["hypothesis"][:2]: r for r in catalog.QUERIES["lag_hypotheses"](spark, SF).collect()}
    p = lambda v: pytest.approx(math.erfc(abs(v) / math.sqrt(2)), rel=1e-4)
    assert got["H1"]["value"] == pytest.approx(rmse["lifecycle"] - rmse["demand"], abs=1e-7) and got["H2"]["value"] == pytest.approx(rmse["demand"] - rmse["competition"], abs=1e-7)
    assert (got["H3"]["beta"], got["H3"]["p"]) == (pytest.approx(beta["competition"]["log_rivals_total"], rel=1e-5), p(t["competition"]["log_rivals_total"]))
    assert (got["H4"]["beta"], got["H4"]["p"]) == (pytest.approx(beta["amplified"]["rivals_x_weekday"], rel=1e-5), p(t["amplified"]["rivals_x_weekday"]))
    assert got["H5"]["value"] == pytest.approx(abs(t["competition"]["log_rivals_top1"]) - abs(t["competition"]["rivals"]), rel=1e-4)


def test_fuzzy_match_margin(spark):
    """Every item against every record."""
    got = {r["item"]: (r["entity"], r["score"], r["status"]) for r in catalog.QUERIES["fuzzy_match_margin"](spark, SF).collect()}
    items, records = [], []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        i, title = r["doc_id"], " ".join(re.findall(r"[^\W\d_]+", r["text"])[:4])
        key = "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.combining(c)).lower()
        key = " ".join(re.sub("[^a-z0-9]+", " ", key).split())
        at = i % len(key)
        typo = key[:at] + key[at + 1 :] if i % 2 == 0 else key
        hashed = zlib.crc32(key.encode()) % 97 + 1920
        items.append((i, typo, hashed + (i % 5 == 0) if i % 23 else None))
        records.append((i, key, hashed if i % 19 else None, i % 3 > 0))
    ambiguous = 0
    for item, key, year in items:
        scored = []
        for entity, label, known, has_id in records:
            off = 5 if year is None or known is None else {0: 30, 1: 20, 2: 10}.get(abs(known - year), -30)
            if off > 0:
                scored.append((-(100 * SequenceMatcher(None, key, label).ratio() + off + 10 * has_id), entity))
        scored = sorted(s for s in scored if -s[0] >= 100 - 1e-9)
        if not scored:
            assert item not in got
            continue
        status = "matched" if -scored[0][0] >= 130 and (len(scored) < 2 or scored[1][0] - scored[0][0] >= 8) else "ambiguous"
        ambiguous += status == "ambiguous"
        assert got[item] == (scored[0][1], pytest.approx(-scored[0][0], abs=1e-5), status), (item, key)
    assert len(got) > ambiguous > 10


def made(at, lines):
    """Folder and connection of made tables: 6 parts, each of a brand, and ``lines``, SQL of (part, supplier, day, price)."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS p_partkey, 'Brand#' || (i + 1) AS p_brand FROM range(6) t(i)) TO '{at}/part.parquet'")
    con.execute(f"COPY (SELECT CAST(part AS BIGINT) AS l_partkey, CAST(supplier AS BIGINT) AS l_suppkey, CAST(day AS TIMESTAMP) AS l_shipdate, CAST(price AS DOUBLE) AS l_extendedprice FROM ({lines})) TO '{at}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return con


@pytest.mark.parametrize("outlets", ["4", "2", "CASE WHEN part = 0 AND week = 3 THEN 4 ELSE 2 END", "1 + (part + week) % 4", "0"])
def test_pooled_interactions_of_one_width(spark, tmp_path, outlets):
    con = made(tmp_path, f"SELECT part, supplier, DATE '1998-01-05' + CAST(7 * week AS INTEGER) AS day, 100 + (37 * part + 11 * week) % 50 AS price FROM range(6) p(part), range(8) w(week), range(4) s(supplier) WHERE supplier < {outlets}")
    got, cur = catalog.QUERIES["pooled_interactions"](spark, str(tmp_path)), con.execute(catalog.SQL["pooled_interactions"])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_nested_logit_of_nearly_full_quarters(spark, tmp_path):
    """Only three days are missing, so days and the others' days say nearly the same."""
    day = "DATE '1998-01-01' + CAST(d AS INTEGER)"
    con = made(tmp_path, f"SELECT part, (part + d + s) % 7 AS supplier, {day} AS day, 100 + (37 * part + 11 * d + 5 * part * (d // 90)) % 50 AS price FROM range(6) p(part), range(730) t(d), range(3) r(s) WHERE s <= (part + d // 60) % 3 AND (part, d) NOT IN ((1, 5), (2, 320), (4, 500))")
    got, cur = catalog.QUERIES["nested_logit"](spark, str(tmp_path)), con.execute(catalog.SQL["nested_logit"])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("missing", ["FALSE", "part = 2 AND d BETWEEN 10 AND 15"])
def test_instruments_that_do_not_vary(spark, tmp_path, missing):
    """Every brand sells on every day, which leaves nothing of days; with some days out, SQL has a value."""
    con = made(tmp_path, f"SELECT part, (part + d + s) % 7 AS supplier, DATE '1998-01-01' + CAST(d AS INTEGER) AS day, 100 + (37 * part + 11 * d + 5 * part * (d // 90)) % 50 AS price FROM range(6) p(part), range(400) t(d), range(3) r(s) WHERE s <= (part + d // 60) % 3 AND NOT ({missing})")
    got = catalog.QUERIES["two_way_instruments"](spark, str(tmp_path)).first()
    beta, n, ols_beta = con.execute(catalog.SQL["two_way_instruments"]).fetchone()[1:]
    assert (got["n"], plain(got["ols_beta"])) == (n, plain(ols_beta)) and math.isnan(got["beta"]) == (missing == "FALSE")
    if missing != "FALSE":  # else what SQL has is 0 / 0, or the quotient of two rounding errors, which differ from run to run
        assert plain(got["beta"]) == plain(beta)


def test_every_query_without_sql_is_tested():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"bootstrap_calibration", "ridge_with_calendar", "certainty_sample", "nested_lag_models", "alternating_bootstrap", "fuzzy_match_margin", "lag_hypotheses"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
