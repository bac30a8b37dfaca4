"""Vector searches, the URL filter and the pipeline against brute force and SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from attestry.llm import impacts, urls, vamana
from attestry_queries import harness
from test_texts import brute_components, brute_passages, WORD

SF = "/root/testdata/sf0.001"


def vectors(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(n, dims)).astype(np.float32))]
    rows += [(n + k, rows[3][1]) for k in range(copies)]
    odd = [(10_000, None), (10_050, [1.0, None] + [0.0] * (dims - 2)), (10_100, [float("nan")] * dims), (10_150, [float("inf")] * dims), (10_200, [0.0] * dims), (10_250, [])]
    return rows, odd


def test_top_k_is_exact(spark):
    rows, odd = vectors(300, 16, 1, copies=90)
    rows += [(50, rows[50][1])]  # a repeated row
    frame = spark.createDataFrame([(k, v, "x") for k, v in rows + odd], "vec_id bigint, embedding array<float>, score string")
    got = {}
    for r in impacts.top_vectors(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = rows + [(10_200, [0.0] * 16)]
    whole = {k: np.floor(256 * np.array(v, dtype=np.float64)).astype(int) for k, v in usable}
    want = {}
    for q in (k for k in whole if k % 50 == 0):
        best = sorted((-int(whole[q] @ whole[k]), k) for k, _ in usable if k != q)[:5]
        want[q] = [(i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_small_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert impacts.top_vectors(spark.createDataFrame([], kind)).count() == 0
    rows = impacts.top_vectors(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0]), (None, [1.0, 1.0]), (2, [1.0])], kind)).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 1, None), (0, 2, 1)]


def test_top_k_leaves_out_the_own_row_of_long_vectors(spark):
    frame = spark.createDataFrame([(0, [100.0, 200.0]), (1, [50.0, -100.0]), (50, [300.0, 1.0])], "vec_id bigint, embedding array<float>")
    rows = impacts.top_vectors(frame).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]


def test_graph_recall(spark):
    rows, odd = vectors(2500, 24, 2, copies=200)
    frame = spark.createDataFrame([(k, v, 1) for k, v in rows + odd], "vec_id bigint, embedding array<float>, rank int")
    got = {}
    for r in vamana.nearest(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, points = np.array([k for k, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    assert set(got) == {k for k in ids.tolist() if k % 20 == 0}
    recall = []
    for q, found in got.items():
        scores = points @ points[np.flatnonzero(ids == q)[0]]
        best = [k for k in ids[np.lexsort((ids, -scores))] if k != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(s - points[k] @ points[q]) < 1e-9 for _, k, s in found) if q < 2500 else True
        recall.append(len(set(best) & {f[1] for f in found}) / 20)
    assert np.mean(recall) >= 0.9
    assert vamana.nearest(frame.where("false")).count() == 0
    assert len(vamana.nearest(frame.where("vec_id < 3")).collect()) == 2


@pytest.mark.parametrize("length", [1e4, 1e6])
def test_graph_recall_with_one_long_vector(spark, length):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(2000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[777] *= length
    points = points.astype(np.float32)
    frame = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(points)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in vamana.nearest(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, 2000, 20))
    recall, exact = [], points.astype(np.float64)
    for q, found in got.items():
        best = [k for k in np.argsort(-(exact @ exact[q]), kind="stable").tolist() if k != q][:20]
        assert (777 in found) == (777 in best)
        recall.append(len(found & set(best)) / 20)
    assert np.mean(recall) >= 0.9


def test_urls(spark):
    rows = [(1, "https://WWW.A.example.net/en/x?q#f"), (2, "http://b.example.net"), (3, "http://example.com/de/"), (4, "http://x.example.com/de"), (5, "http://notexample.com/de/"),
            (6, "ftp://q.org/fr/y"), (7, None), (8, "no scheme"), (9, "http://adult-x.example.org/a?ref=1&b=2&a=1"), (10, "http://ADULT-x.example.org:80/a?a=1&utm_source=z&b=2"),
            (11, "http://clean.example.org/a?a=1"), (12, "://"), (13, "http://Ä.NET/"), (9, "http://adult-x.example.org/a?ref=1&b=2&a=1"), (14, ""), (15, "http://net/"), (16, "http://y/http://adult-x.example.org/a")]
    pages = spark.createDataFrame([(k, u, "h") for k, u in rows], "page_id bigint, url string, path string")
    got = urls.verdicts(pages).toPandas()
    con = duckdb.connect()
    pages = pages.toPandas()  # noqa: F841  read by the SQL
    con.register("pages", pages)
    want = con.execute(urls.VERDICTS_SQL.replace("FROM fits WHERE place = 1", "FROM fits WHERE place = 1")).fetchdf()
    assert set(harness.canonical(got)) == set(harness.canonical(want)) and len(got) == len(rows)
    told = {r.page_id: (r.rule, r.verdict) for r in got.itertuples()}
    assert told[1] == ("example.net/en/", "allow") and told[2] == (None, "allow") and told[3] == ("example.com/de/", "block")
    assert told[9][1] == told[10][1] == "block" and told[11] == (None, "allow") and told[15] == ("net/", "block")


def test_url_filter_has_no_false_negatives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("http://l.example.org/"), F.col("id").cast("string")).alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.l.example.org/"), F.col("id").cast("string"), F.lit("?utm_x=1")).alias("url"))
    got = urls.judge(pages, listed, []).groupBy("verdict", F.expr("page_id < 2000").alias("listed")).count().collect()
    assert {(r.verdict, r.listed): r["count"] for r in got} == {("block", True): 2000, ("allow", False): 4000}
    assert urls.judge(pages.where("false"), listed.where("false"), []).count() == 0
    assert urls.judge(pages, listed.where("false"), []).where("verdict = 'block'").count() == 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_queries(spark, name):
    con = harness.duck(SF)
    ok, note = harness.check(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_pipeline_stages(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(4)
    text = lambda n: [f"the{rng.randrange(5000)}" for _ in range(n)]
    passage, base = text(80), text(90)
    near = [w if i != 5 else "other" for i, w in enumerate(base)]
    planted = [(90_000, text(60) + passage), (90_001, passage + text(60)), (90_002, base), (90_003, near), (90_004, base), (90_005, text(20) + ["idiot", "moron", "scum"] + text(20)), (90_006, ["idiot"] * 60), (90_007, text(70))]
    more = spark.createDataFrame([(k, " ".join(w) + ".", "en", "src1", 0) for k, w in planted] + [(90_008, None, None, None, None), (90_009, "", None, None, None)], docs.schema)
    before = docs.unionByName(more).repartition(4)
    after = dict(zip([n for n, _ in corpus_pipeline.STAGES], [None] * 5))
    for name, stage in corpus_pipeline.STAGES:
        from attestry.llm.shared import stored

        result = stored(stage(spark, before, SF), "test-stage")
        if name != "packing":
            assert result.columns == docs.columns
        after[name] = {r.doc_id: r.text if "text" in result.columns else r for r in result.collect()}
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = brute_components(rows, 5, 80)
            assert set(after[name]) == {d for d, (n, c) in want.items() if c == d}
        if name == "repeated passages":
            rows = {r.doc_id: r.text for r in before.collect()}
            gone = brute_passages(list(rows.items()))
            for d, kept in after[name].items():
                cut = {i for a, b in gone.get(d, []) for i in range(a, b)}
                assert WORD.findall(kept or "") == [w for i, w in enumerate(WORD.findall(rows[d] or "")) if i not in cut]
        before = result
    assert not {90_005, 90_006} & set(after["toxicity"]) and {90_000, 90_007, 90_008, 90_009} <= set(after["toxicity"])
    assert set(after["near duplicates"]) <= set(after["quality"]) <= set(after["toxicity"]) and labels.count()
    assert set(after["packing"]) == set(after["repeated passages"])
    assert corpus_pipeline.run(spark, SF).count() > 0
