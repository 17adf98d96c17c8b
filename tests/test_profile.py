import re
from fractions import Fraction

from genoloom.operators import profile as P
from genoloom.plans.quality import DOMAINS

LOADS = "load_id int, study_id string, release_no int, load_no int, maf string"
ROWS = "load_id int, maf double, pval double, se double, n double, load_no string"


def found(spark, rows, loads):
    t = P.profile(spark.createDataFrame(rows, ROWS), spark.createDataFrame(loads, LOADS), DOMAINS)
    return {tuple(r) for r in P.issues(t.table).collect()}


def test_issues_of_a_load_against_the_one_before(spark):
    first = [(1, 0.01 * k + 0.1, 0.01 * k, 0.1 + k, 100.0 + k, None) for k in range(20)]
    second = [(2, 0.3, 0.01 * k, 0.1 + k, 100.5, None) for k in range(20)] + [(2, None, 1.5, 0.0, None, None)] * 5
    got = found(spark, first + second, [(1, "S", 1, 1, None), (2, "S", 1, 2, None)])
    assert got == {(2, "maf", "nulls"), (2, "maf", "distinct"), (2, "maf", "shift"), (2, "pval", "range"), (2, "se", "range"), (2, "n", "nulls"), (2, "n", "pattern"), (2, "n", "shift")}


def test_limits_are_exact_and_first_loads_have_no_comparison(spark):
    a = [(1, 0.1 if k < 10 else 0.2, 0.5, 1.0, 1.0, None) for k in range(10)]
    b = [(2, 0.1 if k < 7 else 0.05, 0.5, 1.0, 1.0, None) for k in range(9)] + [(2, None, 0.5, 1.0, 1.0, None)]
    got = found(spark, a + b, [(1, "S", 1, 1, None), (2, "S", 1, 2, None)])
    assert not any(i in ("nulls", "shift") for _, _, i in got)  # 2 of 9 and exactly a tenth are within the limits
    assert found(spark, a + b, [(2, "S", 1, 2, None)]) == got


def test_nan_nulls_empty_and_unlisted(spark):
    rows = [(None, float("nan"), None, None, None, "x"), (5, float("nan"), None, None, None, "x"), (5, None, None, None, None, None)]
    assert found(spark, rows, [(None, None, None, None, None)]) == {(5, "maf", "range")}
    assert found(spark, [], []) == set()


def test_shift_is_found_inside_a_narrow_bin(spark):
    base = 1000.0
    rows = [(1, base + k * 1e-6) for k in range(50)] + [(2, base + 20e-6 + k * 1e-6) for k in range(50)]
    v = P.cut(P.distinct_table(spark.createDataFrame(rows, "load_id int, x double"), "load_id", ["x"]), "t")
    pairs = spark.createDataFrame([(2, 1)], "load_id int, prev_id int")
    assert P.shifted(v, pairs, Fraction("0.39")).count() == 1
    assert P.shifted(v, pairs, Fraction("0.4")).count() == 0


def test_ordered_bins_keep_the_order(spark):
    xs = [float("-inf"), -1e300, -2.5, -2.0, -1e-310, 0.0, 5e-324, 0.1, 0.30000000000000004, 1.0, 1.5, 2.0, 1023.9999999, 1024.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    for bits in P.LEVELS[:-1]:
        keys = [r.b for r in df.select("k", P._ordered(df.x, bits).alias("b")).orderBy("k").collect()]
        assert keys == sorted(keys)
        assert len(set(keys)) >= len(keys) - 2


def member(shape, n, lengths):
    return {"shape": shape, "n": n, "lengths": lengths}


def test_induced_expressions_cover_by_least_description():
    whole = [member("D.Z", 5000, [(6, 2000), (7, 3000)]), member("-D.Z", 2, [(4, 2)]), member("D.D", 40, [(6, 20), (8, 20)])]
    got = P.induce(whole, 5042)
    assert {(P._regex(k), len(own), kept) for k, own, kept in got} == {(r"-?[0-9]+\.0+", 2, True), (r"-?[0-9]+\.[0-9]+" if any(k == "~D.D" for k, _, _ in got) else r"[0-9]+\.[0-9]+", 1, True)}
    assert re.fullmatch(r"-?[0-9]+\.0+", "-8406.0") and not re.fullmatch(r"-?[0-9]+\.0+", "8406.5")
    assert [kept for *_, kept in P.induce([member("U-l", 1, [(9, 1)])], 5042)] == [False]


def test_issue_of_pattern_follows_the_expressions(spark, monkeypatch):
    rows = [(1, 0.1, 0.5, 1.0, 100.0 + k, None) for k in range(60)] + [(1, 0.1, 0.5, 1.0, x, None) for x in (-9.0, 0.0, 2e7, 1e22)] + [(2, 0.1, 0.5, 1.0, 7.25, None)]
    loads = [(1, "S", 1, 1, None), (2, "S", 1, 2, None)]
    own = lambda: {r[:1] for r in found(spark, rows, loads) if r[1:] == ("n", "pattern")}
    assert own() == {(2,)}
    kept = P.expressions
    monkeypatch.setattr(P, "expressions", lambda values: kept(values).where("false"))
    assert own() == set()


def test_columns_of_texts(spark):
    texts = [(1, f"rs{k}") for k in range(50)] + [(1, None), (2, "7"), (2, "x y"), (2, "rs5"), (2, "RS05"), (2, "x y")]
    df = spark.createDataFrame(texts, "load_id int, snp string")
    p = P.profile(df, spark.createDataFrame([(1, "S", 1, 1, None), (2, "S", 1, 2, None)], LOADS), {"snp": P.Domain(strict=True)})
    got = {r.load_id: r for r in p.table.collect()}
    assert got[1].expression == "[a-z]+[0-9]+" and (got[1].rows, got[1].nulls, got[1].nonconforming, got[1].is_pattern) == (51, 1, 0, False)
    assert (got[2].distinct_values, got[2].nonconforming, got[2].uncovered, got[2].is_pattern) == (4, 4, 4, True)
    assert abs(got[2].coverage_change + 0.8) < 1e-12


def test_long_texts_of_many_runs_are_described_in_full(spark):
    long = ["a1B2c3D4e5F6g7H8 " * 20 + str(k) for k in range(30)] + ["A1b2C3d4E5f6G7h8 " * 20 + str(k) for k in range(30)]
    values = P.cut(P.distinct_table(spark.createDataFrame([(1, t) for t in long], "load_id int, x string"), "load_id", ["x"]), "t")
    rows = P.expressions(values).collect()
    assert len(rows) == 2 + (len({r.shape for r in rows}) - 2) and all(re.fullmatch(r.regex, r.example) for r in rows)


def test_texts_of_numbers(spark):
    xs = [1e7, 12345678.5, -3e22, 9999999.0, 1e-4, float("nan"), float("inf"), 0.0, 1.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(P.value_text(P.F.col("x"))).collect()]
    assert got == ["10000000.0", "12345678.5", "-30000000000000000000000.0", "9999999.0", "1.0E-4", None, None, "0.0", "1.5"]
