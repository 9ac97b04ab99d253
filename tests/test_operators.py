"""Traps of ranks, profiles, metrics, encoders, thresholds, joins, caches and streams on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import enrich, features, metrics, ordinal, profile, ranking
from folioscope.sources import cache


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("a", None), (None, 7.0)], "g string, x double")
    got = sorted((r.x or -1, r.pct) for r in ranking.percentile_rank(df, "x", ["g"], "pct").filter("g = 'a'").collect())
    assert got == [(-1, None), (1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (5.0, 1.0)]
    assert ranking.percentile_rank(df, "x", ["g"], "pct").filter("g is null").first().pct == 1.0
    every = {r.x: r.pct for r in ranking.global_percentile_rank(df, "x", "pct").collect()}
    assert every[7.0] == 1.0 and every[2.0] == pytest.approx(0.5) and every[None] is None
    ids = spark.range(500).withColumn("g", F.col("id") % 3)
    plain = ids.withColumn("d", F.md5(F.col("id").cast("string"))).toPandas().sort_values("d")
    want = dict(zip(plain["id"], plain.groupby("g").cumcount() + 1))
    assert {r.id: r["rank"] for r in ranking.hashed_rank(ids, ["g"], F.md5(F.col("id").cast("string"))).collect()} == want


def test_keep_last_and_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seq int, v string")
    new = spark.createDataFrame([(1, 2, None), (3, 1, "c")], "k int, seq int, v string")
    assert sorted(map(tuple, enrich.upsert(old, new, ["k"], ["seq"]).collect())) == [(1, 2, None), (2, 1, "b"), (3, 1, "c")]
    assert [r.k for r in enrich.remaining(new, old, ["k"]).collect()] == [3]


def test_found_row_with_null_value(spark):
    value, source = enrich.found_first([("a", F.col("fa"), F.col("a")), ("b", F.col("fb"), F.col("b"))])
    df = spark.createDataFrame([(True, None, True, 2), (False, 1, True, 2), (None, 1, False, 2)], "fa boolean, a int, fb boolean, b int")
    assert [tuple(r) for r in df.select(value, source).collect()] == [(None, "a"), (2, "b"), (None, "none")]


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, i int")
    assert sorted(r.n for r in enrich.joined_null_safe(a, a.groupBy("k").agg(F.count("*").alias("n")), ["k"]).collect()) == [1, 1]


def test_metrics(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(1, 6, 300), rng.integers(1, 4, 300)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p int")
    w = (np.arange(1, 6)[:, None] - np.arange(1, 6)[None, :]) ** 2
    seen = np.zeros((5, 5))
    np.add.at(seen, (y - 1, p - 1), 1)
    want = 1 - (w * seen).sum() / (w * np.outer(seen.sum(1), seen.sum(0)) / 300).sum()
    assert df.agg(metrics.qwk("y", "p")).first()[0] == pytest.approx(want)
    f1 = [2 * seen[k, k] / (seen[k].sum() + seen[:, k].sum()) if seen[k].sum() + seen[:, k].sum() else 0 for k in range(5)]
    assert metrics.macro_f1(df, "y", "p").first()[0] == pytest.approx(np.mean(f1))
    one = spark.createDataFrame([(3, 3)], "y int, p int")
    assert one.agg(metrics.qwk("y", "p")).first()[0] is None


def test_cuts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "s double")
    assert [r[0] for r in df.select(metrics.label_by_cuts("s", [2.0, 2.5])).collect()] == [1, 2, 3, None]


def test_threshold_search_beats_fixed_cuts(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(1, 6, 3000)
    s = np.clip(y * 0.5 + 1.4 + rng.normal(0, 0.3, 3000), 1, 5)
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "label int, s double")
    cuts = ordinal.search_cuts(ordinal.score_histogram(df, "s", "label"))
    assert cuts == sorted(cuts)
    sets = spark.createDataFrame([("found", cuts), ("fixed", [1.5, 2.5, 3.5, 4.5])], "name string, cuts array<double>")
    got = {r.name: r.qwk for r in ordinal.evaluate_cut_sets(df, "s", "label", sets).collect()}
    assert got["found"] > got["fixed"] + 0.05


def test_stackers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = 0.7 * x[:, 0] + 0.3 * x[:, 1]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    w = ordinal.convex_weights(df, ["a", "b", "c"], "y")
    assert sum(w.values()) == pytest.approx(1) and w["a"] == pytest.approx(0.7, abs=1e-3)
    coef, free = ordinal.ridge_weights(df, ["a", "b", "c"], "y", 2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc)
    assert np.allclose(coef, want) and free == pytest.approx(y.mean() - x.mean(0) @ want)


def test_target_encoding_sees_other_folds_only(spark):
    df = spark.createDataFrame([(1, "a", 0, 5.0), (2, "a", 1, 1.0), (3, None, 0, 3.0)], "id int, k string, fold int, y double")
    got = {r.id: r.encoded for r in features.target_encoding(df, "k", "y", "fold", 2.0).collect()}
    assert got == {1: pytest.approx((1 + 3 * 2) / 3), 2: pytest.approx((5 + 3 * 2) / 3), 3: pytest.approx(3.0)}


def test_tfidf_term_in_every_row(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "red dog"), (3, None)], "id int, t string")
    rows = features.tfidf(df, "id", features.word_grams(F.col("t"))).collect()
    assert all(r.weight > 0 for r in rows) and {r.id for r in rows} == {1, 2}
    assert sum(r.weight**2 for r in rows if r.id == 1) == pytest.approx(1)


def test_profiles(spark):
    df = spark.createDataFrame([(1, "x", 2.5), (5, " ", 1.0), (5, None, None)], "label int, t string, v double")
    assert {r.label: r.share for r in profile.domain_distribution(df, "label").collect()}[3] == 0.0
    row = profile.missing_profile(df, ["t"]).first()
    assert (row.missing, row.blank) == (1, 2)
    assert profile.group_stats(df, ["label"], "v").filter("label = 1").first()["std"] is None
    assert [r.n for r in profile.histogram(df, "v", [0.0, 1.0, 3.0]).orderBy("bucket").collect()] == [0, 2]
    assert profile.value_counts(df.limit(0), "t").count() == 0


def test_cache_fetches_only_what_is_new(spark):
    known = spark.createDataFrame([("a", 1, None)], "key string, seq int, error string")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    got = enrich_rows = cache.enriched(wanted, known, "key", lambda keys: [{"key": k, "seq": 2, "error": None} for k in keys], ["seq"])
    assert sorted((r.key, r.seq) for r in got.collect()) == [("a", 1), ("b", 2)]
    assert enrich_rows.columns == ["key", "seq", "error"]

    calls = []

    def broken(keys):
        calls.append(1)
        raise OSError("down")

    assert cache.with_retries(broken, 3, 0.0)(["q"]) == [{"key": "q", "error": "down"}] and len(calls) == 3


def test_stream_keeps_what_the_batch_keeps(spark, tmp_path):
    from folioscope.streaming.upsert import keep_last_stream

    rows = spark.createDataFrame([(i % 7, i, float(i)) for i in range(60)], "k int, seq int, v double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    keep_last_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["seq"]).awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[2:]))
    want = sorted(map(tuple, ranking.keep_last(rows, ["k"], ["seq"]).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(last)).collect())) == want


def test_title_match_needs_one_shared_run(spark, tmp_path):
    from folioscope.plans import registry

    schema = "id long, title string, year int"
    train = [(1, "Datalog", 2020), (2, "Lazy hex solving", 2020), (3, "exact counting of metric aggregates in tramways", 2020), (4, "", 2020), (5, None, 2020)]
    spark.createDataFrame(train, schema).write.parquet(f"{tmp_path}/train.parquet")
    tests = [(1, "datalog", 2020), (2, "lazy hex solving", 2020), (3, "exact counting of metric aggregates in tramways".replace("metric", "metrics"), 2020), (4, "", 2020), (5, None, 2020)]
    spark.createDataFrame(tests, schema).write.parquet(f"{tmp_path}/public_test.parquet")
    got = {r.id: (r.train_id, r.found) for r in registry.queries()["x1_x3_title_match"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True)}


def test_title_search_does_not_meet_every_title_of_a_frequent_word(spark):
    import random
    import time

    from folioscope.plans import family_queries as fq

    rng = random.Random(8)
    words = ["plans", "logic", "sets"]
    rows = [(i, " ".join(rng.sample(words, rng.randint(1, 3)) + rng.choice([[], ["plans"], ["odd" + str(rng.randint(0, 9))]]))) for i in range(40_000)]
    df = spark.createDataFrame(rows, "id long, title string").repartition(8)
    began = time.time()
    got: dict = {}
    for r in fq.search(df, df).collect():
        got.setdefault(r.id, []).append((-r.score, r.train_id))
    assert time.time() - began < 60  # pairs by words would be over two billion
    bags = {i: set(x.split()) for i, x in rows}
    n: dict = {}
    for bag in bags.values():
        for w in bag:
            n[w] = n.get(w, 0) + 1
    for i in rng.sample(range(40_000), 12):
        rare = sorted(bags[i], key=lambda w: (n[w], w))[:3]
        want = sorted((-round(sum(1 / n[w] for w in rare if w in bag), 9), j) for j, bag in bags.items() if bag & set(rare))[:5]
        assert [(round(a, 6), j) for a, j in want] == sorted(got[i], key=lambda x: want.index(next(y for y in want if y[1] == x[1])))


def test_title_match_of_titles_of_frequent_words(spark, tmp_path):
    import time

    from folioscope.plans import registry

    rows = spark.range(40_000).selectExpr("id", "concat_ws(' ', 'plans of logic', if(id % 2 = 0, 'sets', null), if(id = 39999, 'oddity', null)) as title", "2020 as year")
    for name in ("train", "public_test"):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    began = time.time()
    got = {r.id: (r.train_id, r.found) for r in registry.queries()["x1_x3_title_match"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 60 and len(got) == 40_000
    assert got[0] == got[2] == (0, True) and got[39999] == (39999, True) and got[1] == (1, True)


def test_edit_distances_of_many_pairs_at_once(spark):
    import random

    from folioscope.operators.edits import edit_distances, edits

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    draw, pairs = random.Random(4), [("", ""), ("", "abc"), ("abc", "")]
    for n in [1, 2, 63, 64, 65, 127, 128, 129, 193] * 20:
        a = "".join(draw.choice("ab c9") for _ in range(n))
        b = list(a)
        for _ in range(draw.randint(0, 9)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "a", " b"])
        pairs.append((a, "".join(b) if draw.random() < 0.7 else "".join(draw.choice("ab c9z") for _ in range(draw.randint(0, 200)))))
    want = [distance(a, b) for a, b in pairs]
    assert edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want and not len(edit_distances([], []))
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    assert [r.d for r in df.select(edits("a", "b").alias("d")).collect()] == want


def test_title_search_lets_few_titles_of_a_set_of_words_go_on():
    import numpy as np

    from folioscope.operators.marks import First

    draw = np.random.default_rng(6)
    first, every, left = First(5), [], []
    for _ in range(40):
        keys = np.concatenate([draw.choice([3, 3 + First.SLOTS, -7], 900), draw.integers(-(1 << 62), 1 << 62, 100), np.zeros(5, int)])
        numbers = draw.permutation(1 << 20)[: len(keys)]
        at = first.may_stay(keys, numbers)
        assert (np.diff(at) > 0).all()
        every += zip(keys.tolist(), numbers.tolist())
        left += zip(keys[at].tolist(), numbers[at].tolist())
    smallest = lambda rows: {k: sorted(n for x, n in rows if x == k)[:5] for k in (3, 3 + First.SLOTS, -7, 0)}
    assert smallest(every) == smallest(left) and len(left) < 40 * 115 and not len(first.may_stay(keys[:0], numbers[:0]))
    assert {k for k, _ in every} == {k for k, _ in left}


def test_title_search_with_every_title_on_one_side_frequent(spark):
    from folioscope.plans import family_queries as fq

    rows = spark.range(60_000, numPartitions=2).selectExpr("59999 - id as id", "concat('plans of logic', if(id % 3 = 0, ' sets', ''), if(id % 7 = 0, ' and agents', '')) as title")
    asked = spark.createDataFrame([(1, "Logic of sets"), (2, "agents"), (3, "plans")], "id long, title string")
    got: dict = {}
    for r in fq.search(asked, rows).collect():
        got.setdefault(r.id, []).append(r.train_id)
    held = {i: set(f"plans of logic{' sets' * ((59999 - i) % 3 == 0)}{' and agents' * ((59999 - i) % 7 == 0)}".split()) for i in range(200)}
    smallest = lambda *words: [i for i in held if set(words) <= held[i]][:5]
    assert {k: sorted(v) for k, v in got.items()} == {1: smallest("logic", "of", "sets"), 2: smallest("agents"), 3: smallest("plans")}


def test_quantiles_and_ranks_against_brute_force(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 30)), rng.random()])) for _ in range(700)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for g, q, m in ranking.quantiles(df, "v", {"q": 0.2, "m": 0.5}, ["g"]).collect():
        own = [v for x, v in rows if x == g and v is not None]
        assert abs(q - np.quantile(own, 0.2)) < 1e-9 and abs(m - np.median(own)) < 1e-9
    for g, v, pct in ranking.percentile_rank(df, "v", ["g"], "pct").collect():
        own = [x for y, x in rows if y == g and x is not None]
        want = None if v is None else (sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2) / len(own)
        assert (pct is None) == (want is None) and (pct is None or abs(pct - want) < 1e-9)
    assert ranking.quantiles(df.limit(0), "v", {"m": 0.5}, ["g"]).count() == 0
    placed = ranking.report_position(spark.range(500).selectExpr("id", "id % 7 as k"), [F.desc("k"), F.col("id")]).collect()
    assert [r.id for r in sorted(placed, key=lambda r: r.position)] == [i for _, i in sorted((-(i % 7), i) for i in range(500))]


def test_files_and_score_families(spark, tmp_path):
    import numpy as np
    import pytest

    from folioscope.sources import cache

    np.save(tmp_path / "m.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    got = {r.row: list(r.embedding) for r in cache.read_npy(spark, str(tmp_path), 3).collect()}
    assert got == {i: [3.0 * i, 3.0 * i + 1, 3.0 * i + 2] for i in range(4)}
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "id long, score double")
    assert cache.score_family(df.filter("id = 1"), "id", ["oof", "score"], "s").collect()[0].s == 0.5
    with pytest.raises(Exception, match="NaN"):
        cache.score_family(df, "id", ["oof", "score"], "s").collect()
    with pytest.raises(ValueError, match="none of the columns"):
        cache.resolved(df, ["oof"])
    for label in (1, 2):
        cache.replace_csv(spark.createDataFrame([(label,)], "label int"), str(tmp_path / "t"))
    assert [r.label for r in cache.read_csv(spark, str(tmp_path / "t"), spark.createDataFrame([], "label int").schema).collect()] == [2]
    cache.write_report(df.select("id"), str(tmp_path / "r"), "Ids", "json")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"id":1}', '{"id":2}']
