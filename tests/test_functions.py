import datetime
import math
import os
import pathlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import arrays, moments, paths, scalars, units
from brindle.operators import keyed, merge
from brindle.operators.pathset import PathSet, ext, matches
from brindle.sources import documents as D

PATHS = ["", ".", "/", "a", "a/b", "/a/b.txt", "a//b/", "./a/./b", "../x.tar.gz", ".bashrc", "a/.hidden.txt", "/x/y.tar.gz", "name.", "a b/c d.txt", "é/ü.yaml", "..", "/..", "a/b/c/d.e.f", "..a"]


def test_path_parts_are_pathlibs(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string")
    out = rows.select("p", *(getattr(paths, n)("p").alias(n) for n in ("name", "stem", "suffix", "suffixes", "parts", "parent", "parents", "is_absolute", "uri"))).collect()
    for r in out:
        q = pathlib.PurePosixPath(r.p)
        for n in ("name", "stem", "suffix", "suffixes"):
            assert getattr(r, n) == getattr(q, n), (r.p, n)
        assert tuple(r.parts) == q.parts and r.parent == str(q.parent) and r.parents == [str(x) for x in q.parents], r.p
        assert r.is_absolute == q.is_absolute()
        assert r.uri == (q.as_uri() if q.is_absolute() else None), r.p


def test_building_paths(spark):
    r = spark.createDataFrame([("/a/b.txt",)], "p string").select(
        paths.joinpath("p", "c", "d.e").alias("j"), paths.joinpath("p", "/z").alias("z"), paths.with_name("p", "n").alias("n"), paths.with_stem("p", "s").alias("s"),
        paths.with_suffix("p", ".gz").alias("x"), paths.with_suffix("p", "").alias("no"), paths.absolute(F.lit("q/r"), "/root").alias("abs"),
    ).first()
    assert tuple(r) == ("/a/b.txt/c/d.e", "/z", "/a/n", "/a/s.txt", "/a/b.gz", "/a/b", "/root/q/r")


@pytest.mark.parametrize("pattern, text, whole, segment", [("*", "abc", True, True), ("*.yaml", "x.yaml", True, True), ("a?c", "abc", True, True), ("a?c", "ac", False, False), ("a*c*e", "abcde", True, True), ("*.*", "ab", False, False), ("", "", False, True), ("**", "x", True, True), ("*b", "*ab", True, True), ("a*", "a/b", True, False), ("a.c", "abc", False, False)])
def test_globs(spark, pattern, text, whole, segment):
    r = spark.range(1).select(paths.match_pattern(pattern, F.lit(text)), paths.match_segment(pattern, F.lit(text))).first()
    assert tuple(r) == (whole, segment)


def test_path_sets(spark, tmp_path):
    for n in ("readme.txt", "readme.rst", "AUTHORS.rst"):
        (tmp_path / n).write_text(n)
    s = PathSet.listing(spark, str(tmp_path))
    assert len(s) == 3 and str(tmp_path / "readme.rst") in s
    assert [os.path.basename(p) for p in (s & ext(".rst"))] == ["AUTHORS.rst", "readme.rst"]
    assert len((s | ext(".rst")).eval()) == 2  # the bar filters too
    assert len(((s & ext(".rst")) | ext(".txt")).eval()) == 3
    assert len((s & (~ext(".rst") | matches("A*"))).eval()) == 2
    assert s - str(tmp_path / "readme.rst") == (s & ~matches("readme.rst")).eval()
    assert s + s == s.clone() and not (s - s) and s != s - s
    assert [r.content.decode() for r in (s + PathSet.of(spark, [str(tmp_path)])).read_all_files().collect()] == ["AUTHORS.rst", "readme.rst", "readme.txt"]
    facts = {r.path: r for r in D.file_facts(PathSet.of(spark, [str(tmp_path), str(tmp_path / "no")]).frame).collect()}
    assert facts[str(tmp_path)].is_dir and not facts[str(tmp_path / "no")].exists


def test_walks_of_folders(spark, tmp_path):
    for n in ("a.yaml", "b.yml", ".h/g.yaml", "sub/d.yaml", "sub/deep/e.yaml", "sub/_f.json"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "link").symlink_to(tmp_path / "sub")
    base = pathlib.Path(tmp_path)
    for pattern in ("*", "*.y*", "sub/*.yaml", "*/d.yaml", "**/*.yaml", "sub/**/*.yaml", "no/*", "*/"):
        wanted = sorted(map(str, base.glob(pattern.rstrip("/"))))
        assert list(PathSet.glob(spark, str(tmp_path), pattern)) == wanted, pattern
    assert list(PathSet.glob(spark, str(tmp_path), "sub/**")) == sorted(str(p) for p in base.glob("sub/**/*"))
    assert list(PathSet.rglob(spark, str(tmp_path), "e.*")) == [str(base / "sub/deep/e.yaml")]
    assert list(PathSet.iterdir(spark, str(tmp_path))) == sorted(map(str, base.iterdir())) and not PathSet.iterdir(spark, str(tmp_path / "none"))
    for bad in ("", "/x", "/"):
        with pytest.raises(ValueError):
            PathSet.glob(spark, str(tmp_path), bad)
    rows = spark.createDataFrame([(f"{tmp_path}/link/../a.yaml",), (f"{tmp_path}/link/x",), (None,)], "p string")
    assert [r[0] for r in rows.select(paths.resolve("p")).collect()] == [os.path.realpath(base / "a.yaml"), os.path.realpath(base / "sub/x"), None]
    assert spark.range(1).select(scalars.ascii_lower(F.lit("AZÄıİ"))).first()[0] == "azÄıİ"


def test_rates_over_units(spark):
    cases = [(q, d, u) for q in (0, 0.5, 1, 10, 1023, 1024, 1e6, 2**20, 3e9, 7e15) for d in (1, 3, 0.25, 7, 60, 1e3, 1e-3, 12.5) for u in ("b",)]
    rows = spark.createDataFrame([(float(q), float(d), u) for q, d, u in cases], "q double, d double, u string")
    for r in rows.select("*", units.calculate_rate(F.col("q"), F.col("u"), F.col("d"), "s", 1).alias("r")).collect():
        x, k = r.q / r.d, 0
        while abs(x) >= 1024 and k < 5:
            x, k = x / 1024, k + 1
        assert r.r == f"{x:.1f} {units.RATE_UNITS[k]}"
    assert spark.range(1).select(units.calculate_rate(10, "MiB", 3, "s", 1)).first()[0] == "3.3 MB/s"
    assert spark.range(1).select(units.to_bytes(16, "Mbit"), units.to_seconds(90, "min"), units.to_seconds(5, "µs")).first()[:] == (2 * 2**20, 5400.0, 5e-6)
    assert spark.range(1).select(units.format_bytes_per_second(F.lit(None))).first()[0] is None
    for bad in (units.calculate_rate(1, "b", 0, "s"), units.to_bytes(1, "parsec"), units.to_seconds(1, "year")):
        with pytest.raises(PySparkException):
            spark.range(1).select(bad).collect()


def test_moments(spark):
    random.seed(1)
    micros = [0, -1, 1, 951782400000000, -86400000000, 1577836800000000] + [random.randrange(-(10**16), 10**16) for _ in range(50)]
    rows = spark.createDataFrame([(m,) for m in micros], "m long").select("m", moments.timestamp_from_micros("m").alias("t"))
    for r in rows.select("m", "t", moments.timestamp_parts("t").alias("p")).collect():
        want = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=r.m)
        assert r.t == want and tuple(r.p) == (want.year, want.month, want.day, want.hour, want.minute, want.second, want.microsecond)
    r = spark.range(1).select(moments.days_from_civil(2000, 3, 1), moments.civil_from_days(F.lit(-1)).alias("c"), moments.micros_since_midnight(1, 2, 3, 45), moments.time_parts(F.lit(3_723_000_004_500)).alias("t")).first()
    assert r[0] == 11017 and tuple(r[1]) == (1969, 12, 31) and r[2] == 3_723_000_004 and tuple(r[3]) == (1, 2, 3, 45)


SCALARS = {"null": ["", "~", "null", "Null", "NULL"], "bool": ["true", "True", "FALSE"], "int": ["0", "-1", "+7", "010", "0x1A", "0o17"], "float": ["1.5", ".5", "5.", "1e3", "-1E-4", ".inf", "-.INF", "+.Inf", ".nan", ".NaN"], "string": ["nULL", "tRUE", "yes", "0x", "-0x1", "0b1", "1_0", "inf", "nan", "-.nan", ".", "1e", "e3", " 1", "1 ", "1\n", "true\n"]}


def test_scalar_classes_agree_everywhere(spark):
    cases = [(t, k) for k, ts in SCALARS.items() for t in ts]
    rows = spark.createDataFrame(cases, "t string, k string")
    names = {type(None): "null", bool: "bool", int: "int", float: "float", str: "string"}
    for r in rows.select("t", "k", scalars.scalar_class("t").alias("c"), scalars.to_integer("t").alias("i"), scalars.to_double("t").alias("d"), scalars.to_boolean("t").alias("b"), scalars.needs_quotes("t").alias("q")).collect():
        value = D.scalar(r.t)
        assert r.c == r.k == names[type(value)] and r.q == (r.k != "string"), r
        if r.k == "int":
            assert int(r.i) == value and r.d == float(value)
        if r.k == "float":
            assert r.d == value or math.isnan(value) and math.isnan(r.d)
        assert r.b == (value if r.k == "bool" else None)


def test_text_checks(spark):
    r = spark.range(1).select(scalars.is_dunder(F.lit("__x__")), scalars.is_dunder(F.lit("___")), scalars.is_dunder(F.lit("____")), *(scalars.is_clean_utf8(F.lit(b)) for b in (bytearray(b"ok"), bytearray(b"\xff\xfea\0"), bytearray(b"a\0"), bytearray(b"\xc3"))))
    assert tuple(r.first()) == (True, False, True, True, False, False, False)


def test_each(spark):
    rows = spark.createDataFrame([([(1, "a"), (2, "b")],), ([],), (None,)], "xs array<struct<v: int, t: string>>")
    found = rows.select(arrays.each("xs").v.alias("v"), arrays.each("xs")(lambda x, n: x.v * n, 3).alias("m")).collect()
    assert [tuple(r) for r in found] == [([1, 2], [3, 6]), ([], []), (None, None)]
    assert spark.range(1).select(arrays.to_csv(F.array(F.lit("b"), F.lit("a"))), arrays.to_csv(F.array(F.lit("b"), F.lit("a")), True)).first()[:] == ("b, a", "a, b")


# merging


def _merge(spark, left, right, kind, rules=merge.Rules()):
    a, b = (spark.createDataFrame(list(x.items()), f"key string, value {kind}") for x in (left, right))
    rows = {r.key: r.value for r in merge.merge(a, b, rules=rules).collect()}
    spark_kind = a.schema["value"].dataType
    maps = spark.createDataFrame([(left, right)], f"l map<string,{kind}>, r map<string,{kind}>").select(merge.merge_maps("l", "r", spark_kind, rules)).first()[0]
    assert rows == maps
    return rows


def test_merge_by_strategies(spark):
    assert _merge(spark, {"a": 1, "b": 4}, {"a": 2, "c": 3}, "int") == {"a": 3, "b": 4, "c": 3}
    assert _merge(spark, {"b": "x"}, {"b": "y"}, "string") == {"b": "y"}
    assert _merge(spark, {"a": 1}, {"a": 5}, "int", merge.Rules.of(int=max)) == {"a": 5}
    assert _merge(spark, {"x": 9}, {"x": 3}, "int", merge.Rules.of(int=min).set_strategy("x", "max")) == {"x": 9}
    assert _merge(spark, {"x": 9}, {"x": 3}, "int", merge.Rules().set_default_strategy("replace")) == {"x": 3}
    assert _merge(spark, {"x": "a"}, {"x": "b"}, "string", merge.Rules.of(str=sum)) == {"x": "ab"}
    assert _merge(spark, {"x": 9, "y": None, "z": None}, {"x": None, "y": 2, "z": None}, "int") == {"x": 9, "y": 2, "z": None}
    assert _merge(spark, {"x": True, "y": True}, {"x": True}, "boolean") == {"x": 2, "y": 1}
    assert _merge(spark, {}, {}, "int") == {}


def test_merge_rules():
    r = merge.Rules()
    assert r.default_strategy() == "type-default" and r.type_strategy("int") is None
    assert r.set_type_strategy(int, max).type_strategy("int") == "max"
    for bad in ("mean", print, 3):
        with pytest.raises(ValueError):
            merge.strategy_name(bad)


def test_types_that_cant_be_merged(spark):
    a, b = spark.createDataFrame([("k", 1)], "key string, value int"), spark.createDataFrame([("k", "x")], "key string, value string")
    with pytest.raises(TypeError):
        merge.merge(a, b)
    with pytest.raises(TypeError):
        merge.combine(F.lit(1), F.lit(2), T.DateType(), "sum")


def test_merge_in_folds_in_order(spark):
    table = spark.createDataFrame([("a", 1), ("b", 5)], "key string, value int")
    updates = spark.createDataFrame([(2, "a", 7), (1, "a", 9), (1, "c", 4)], "o int, key string, value int")
    fold = lambda rules: {r.key: r.value for r in merge.merge_in(table, updates, "o", rules=rules).collect()}
    assert fold(merge.Rules()) == {"a": 17, "b": 5, "c": 4}
    assert fold(merge.Rules.of(int="replace")) == {"a": 7, "b": 5, "c": 4}
    assert fold(merge.Rules.of(int="replace").set_strategy("a", "max")) == {"a": 9, "b": 5, "c": 4}


@pytest.mark.parametrize(
    "kind, own, more, strategy, wanted",
    [
        ("string", "a", ["b", None, "c"], "sum", "abc"), ("string", "a", ["b", "c"], None, "c"), ("string", "m", ["z", "b"], "max", "z"), ("boolean", True, [True, False], None, 2), ("boolean", True, [], None, 1),
        ("boolean", True, [False], "min", 0), ("array<int>", [1], [[3], [2]], "sum", [1, 3, 2]), ("binary", bytearray(b"\x00a"), [bytearray(b"\xff")], "sum", bytearray(b"\x00a\xff")), ("int", 1, [None, 5, None], "replace", 5), ("string", None, [], "sum", None),
    ],
)
def test_merge_in_is_merge_again_and_again(spark, kind, own, more, strategy, wanted):
    rules = merge.Rules(default=strategy or "")
    table = spark.createDataFrame([("k", own)], f"key string, value {kind}")
    updates = spark.createDataFrame([(i, "k", v) for i, v in enumerate(more)][::-1], f"o int, key string, value {kind}")
    (found,) = merge.merge_in(table, updates, "o", rules=rules).collect()
    assert found.value == wanted
    if kind != "boolean":  # there the first step makes numbers of the column
        for v in more:
            table = merge.merge(table, spark.createDataFrame([("k", v)], f"key string, value {kind}"), rules=rules)
        assert table.first().value == wanted


def test_what_cannot_be_added_or_merged(spark):
    days = spark.sql("SELECT 'k' AS key, DATE '2020-01-01' AS value, 1 AS o")
    for rules, fails in ((merge.Rules.of(date="sum"), True), (merge.Rules(), False)):
        if fails:
            with pytest.raises(TypeError):
                merge.merge_in(days.drop("o"), days, "o", rules=rules)
        else:
            assert merge.merge_in(days.drop("o"), days, "o", rules=rules).count() == 1
    with pytest.raises(TypeError):
        merge.merge_in(days.drop("o"), days.withColumn("value", F.lit("x")), "o")


def test_the_right_values_type_goes_first(spark):
    left, right = spark.createDataFrame([("k", 5)], "key string, value int"), spark.createDataFrame([("k", 3.5)], "key string, value double")
    assert merge.merge(left, right, rules=merge.Rules.of(int="max", float="min")).first().value == 3.5
    assert merge.merge(left, right, rules=merge.Rules.of(int="max")).first().value == 5.0
    with pytest.raises(TypeError):
        merge.MergeMap({"k": "x"}, str="sum") | {"k": 1}


def test_strict_registration(spark):
    table, rows = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert sorted(map(tuple, keyed.register(table, rows, ["k"]).collect())) == [(1, "a"), (2, "b")]
    assert keyed.register(table, table.selectExpr("k", "'z' AS v"), ["k"], override=True).collect()[0].v == "z"
    for wrong, override in ((table, False), (rows, True)):
        with pytest.raises(ValueError):
            keyed.register(table, wrong, ["k"], override)


def test_merge_map_on_the_driver():
    m = merge.MergeMap({"a": 1, "b": "x"}, int=max)
    both = m | {"a": 5, "b": "y", "c": True}
    assert both.to_dict() == {"a": 5, "b": "y", "c": True} and m.to_dict() == {"a": 1, "b": "x"}
    assert (merge.MergeMap({"a": 1, "t": True}) | merge.MergeMap({"a": 2, "t": True})).to_dict() == {"a": 3, "t": 2}
    assert merge.MergeMap({"x": 9}, merge.Rules.of(int=min).set_strategy("x", "max")).merge({"x": 3})["x"] == 9
    m["d"] = 2
    del m["a"]
    assert m.get("d") == 2 and m.get("none", 7) == 7 and "a" not in m and len(m) == 2 and set(m) == {"b", "d"}
    with pytest.raises(KeyError):
        m.get("none")
    with pytest.raises(TypeError):
        merge.MergeMap({"a": "x"}, str=sum).merge({"a": 1})
