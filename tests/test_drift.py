from dataclasses import replace

from genoloom.operators.drift import Flooding, correspondences, file_columns, reconcile, reference_profiles, with_profiles
from genoloom.plans.feeds import _SQL_NAMES, CASTS, TARGETS, reference
from genoloom.plans.tables import table

F = Flooding(TARGETS)


def run(spark, records, files):
    return reconcile(spark.createDataFrame(records, "record_id bigint, file_id int, payload string, feed string"), spark.createDataFrame(files, "file_id int, feed string, seq_no int, payload string"), F, CASTS)


def test_changes_along_a_feed(spark):
    a = ['{"P": 0.%d, "BP": %d, "N": %d, "Z": -1.%d, "HWE_P": 0.4}' % (k + 1, 5_000_000 + k, 1000 + k, k) for k in range(8)]
    b = ['{"p_value": "0.%d", "BP": %d.0, "OBS_CT": null, "P_HET": 0.2}' % (k + 1, 5_000_000 + k) for k in range(8)]
    records = [(k, 1, p, None) for k, p in enumerate(a)] + [(10 + k, 2, p, None) for k, p in enumerate(b)] + [(20, 2, b[0], None), (21, 2, "no json", None), (22, None, None, None), (23, 2, "[1]", None)]
    d = run(spark, records, [(2, "f", 2, None), (1, "f", 1, None), (None, None, None, None)])
    assert {tuple(r) for r in d.changes.collect()} == {(2, "PVAL", "renamed"), (2, "PVAL", "retyped"), (2, "POS", "retyped"), (2, "N", "renamed"), (2, "Z", "removed")}
    rows = {r.record_id: r for r in d.table.collect()}
    assert len(rows) == 20 and rows[10].pval == 0.1 and rows[10].pos == 5_000_000 and rows[0].z == -1.0 and rows[21].pval is None


def profile(log_mean, negative=0.0, whole=0.0, unit=0.0):
    return [1.0, negative, whole, unit, log_mean, 0.4, 0.0, 0.0]


UNSEEN = [("PValLinear", "float", profile(-0.5, unit=1.0)), ("HWE_P", "float", profile(-0.4, unit=1.0)), ("chrom_coord", "integer", profile(7.7, whole=1.0)), ("HowManyPeople", "string", profile(4.5, whole=1.0)), ("tail", "float", profile(-0.2, negative=0.5, unit=0.3)), ("CM_POS", "float", profile(1.9)), ("Z_REF_FREQ", "float", profile(-0.5, unit=1.0))]
KNOWN = {"CHR": profile(0.8, whole=1.0), "PVAL": profile(-0.5, unit=1.0), "POS": profile(7.7, whole=1.0), "N": profile(4.5, whole=1.0), "Z": profile(-0.2, negative=0.5, unit=0.3)}


def matched(flooding):
    return {k: v[0] for k, v in flooding.match(UNSEEN).items() if k in CASTS}


def test_unseen_names_are_told_by_propagation_over_values_and_types():
    full = replace(F, profiles={k: (tuple(v), (0.0,) * 8) for k, v in KNOWN.items()})
    want = {"PVAL": "PValLinear", "POS": "chrom_coord", "N": "HowManyPeople", "Z": "tail"}
    assert matched(full) == want
    assert matched(replace(full, rounds=0)) != want and matched(F) != want
    assert F.match([]) == {}


def test_columns_of_one_object_support_each_other():
    flat = [("CHR", "integer", None), ("Allele", "string", None)]
    deep = [(f"stats/{n}", t, None) for n, t in (("P", "float"), ("SE", "float"))] + [("note/P", "string", None)]
    got = F.match(flat + deep)
    assert got["PVAL"][0] == "stats/P" and got["SE"][0] == "stats/SE"


def test_feeds_need_the_propagation(spark):
    """Over the test tables, the same matching without any round finds fewer changes that are right."""
    folder = "/root/testdata/sf0.1"
    columns = file_columns(table(spark, folder, "feed_records"))
    full = with_profiles(columns, F, reference(spark, folder))
    pairs = lambda f: {tuple(r) for r in correspondences(columns, f).select("file_id", "field_name", "name").collect()}
    listed = {(r.file_id, f, r.name) for r in columns.collect() for f, names in _SQL_NAMES.items() if r.name in names}
    assert pairs(full) == listed
    assert len(pairs(replace(full, rounds=0)) & listed) < len(listed)


def test_nested_keys_and_numbers_in_texts(spark):
    records = [(k, 1, '{"stats": {"P": 0.%d, "N": "n=%d"}, "BP": "5,000,0%d"}' % (k + 1, 1000 + k, 10 + k), None) for k in range(5)]
    d = run(spark, records, [(1, "f", 1, None)])
    names = {r.field_name: r.name for r in d.matched.collect()}
    assert names == {"PVAL": "stats/P", "N": "stats/N", "POS": "BP"}
    assert d.changes.count() == 0 and d.table.where("pos = 5000010 AND pval = 0.1 AND n = 1000").count() == 1


def test_reference_takes_all_rows_of_all_loads(spark):
    loads = spark.range(60_000).selectExpr("CAST(id DIV 50000 AS INT) AS load_id", "CASE WHEN id < 50000 THEN 0.1D WHEN id = 59999 THEN DOUBLE('inf') WHEN id < 59998 THEN 100D END AS z", "CAST(NULL AS INT) AS n")
    got = [(r.target, [round(x, 6) for x in r.profile]) for r in reference_profiles(loads, "load_id", {"Z": "z", "N": "n"}).collect()]
    assert sorted(got) == [("Z", [1, 0, 0, 1, -1, 0, 0, 0]), ("Z", [1, 0, 1, 0, 2, 0, 0, 0])]


def test_empty_tables(spark):
    d = run(spark, [], [])
    assert d.changes.count() == 0 and d.table.count() == 0


def test_deep_keys_and_keys_with_points_and_slashes(spark):
    deep = "".join('{"k%d": ' % k for k in range(9))
    records = [(k, 1, '{"stats": {"p.value": 0.%d, "it\'s": 1}, "a/b": {"N": %d}, "deep": %s{"BP": %d}%s}' % (k + 1, 1000 + k, deep, 5_000_000 + k, "}" * 9), None) for k in range(5)]
    d = run(spark, records, [(1, "f", 1, None)])
    names = {r.field_name: r.name for r in d.matched.collect()}
    assert names == {"PVAL": "stats/p.value", "N": "a~1b/N", "POS": "deep/" + "".join(f"k{k}/" for k in range(9)) + "BP"}
    assert {(r.pval, r.n, r.pos) for r in d.table.collect()} == {(round(0.1 * (k + 1), 1), 1000.0 + k, 5_000_000 + k) for k in range(5)}
