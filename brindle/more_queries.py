"""More queries over the driver's tables, of operators that ``queries`` doesn't show, with the same in DuckDB's SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle import metrics, support, wiring
from brindle.functions import moments, paths, scalars, units
from brindle.operators import keyed, merge
from brindle.operators.pathset import PathSet, ext, matches
from brindle.plans.scratch import new_path
from brindle.sources import datagen, documents, ranges, sqltypes
from brindle.sources.query import Query, TSqlDialect, qualified, split_name
from brindle.sources.store import DataStore, Format, acquire_datastore

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(function):
        _QUERIES[function.__name__] = function
        _SQL[function.__name__] = sql
        return function

    return keep


def _table(spark, sf_dir, name) -> DataFrame:
    return acquire_datastore(spark, sf_dir).table(name)


def _values(rows: list[tuple], names: str) -> str:
    """A table of literals in SQL."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


# merging one by one


@_query("SELECT c_custkey AS key, (c_nationkey + coalesce(n, 0))::BIGINT AS value FROM customer LEFT JOIN (SELECT o_custkey, sum(o_orderkey) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def merge_in_sum(spark, sf_dir):
    table = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("value"))
    updates = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("at"))
    return merge.merge_in(table, updates, "at")


@_query("SELECT c_custkey AS key, c_mktsegment || coalesce(t, '') AS value FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderpriority, '' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def merge_in_text(spark, sf_dir):
    table = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    updates = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("at"))
    return merge.merge_in(table, updates, "at", rules=merge.Rules.of(str="sum"))


@_query("SELECT c_custkey AS key, ((c_acctbal > 0)::INTEGER + coalesce(n, 0))::INTEGER AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def merge_in_bool(spark, sf_dir):
    """Truth values add up to numbers."""
    table = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") > 0).alias("value"))
    updates = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderstatus") == "F").alias("value"), F.col("o_orderkey").alias("at"))
    return merge.merge_in(table, updates, "at")


@_query("SELECT c_custkey AS key, coalesce(t, c_mktsegment) AS value FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def merge_in_replace(spark, sf_dir):
    table = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    updates = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("at"))
    return merge.merge_in(table, updates, "at")


_HALVES = """l AS (SELECT l_suppkey AS key, sum(l_linenumber)::BIGINT AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_suppkey AS key, sum(l_quantity)::DOUBLE AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""


@_query(f"WITH {_HALVES} SELECT key, greatest(l.v, r.v)::DOUBLE AS value FROM l FULL JOIN r USING (key)")
def merge_right_type(spark, sf_dir):
    """Of whole numbers on the left and others on the right, the right type's strategy counts."""
    lines = _table(spark, sf_dir, "lineitem")
    left = lines.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum("l_linenumber").alias("value"))
    right = lines.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum("l_quantity").alias("value"))
    return merge.merge(left, right, rules=merge.Rules.of(int="min", float="max"))


@_query(_values([("a", "3"), ("b", "xy"), ("c", "7"), ("d", "1"), ("e", "9")], "key, value"))
def merge_mapping(spark, sf_dir):
    """The mapping of the driver."""
    left = merge.MergeMap({"a": 1, "b": "x", "c": 7, "e": 4}, str="sum").merge({"a": 2, "b": "y", "d": 1})
    kept = merge.MergeMap({"c": 5}, rules=merge.Rules().set_strategy("e", "max").set_type_strategy("int", "min")) | {"e": 9}
    return spark.createDataFrame([(k, str(v)) for k, v in (left.to_dict() | {"e": kept["e"]}).items()], "key string, value string")


# registration


@_query("SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'new' ELSE p_name END AS p_name FROM part")
def registry_override(spark, sf_dir):
    """Every key is there, so all may be overridden."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    found = _table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return keyed.register(parts, parts.join(found, "p_partkey").select("p_partkey", F.lit("new").alias("p_name")), ["p_partkey"], override=True)


_SEEN = [("registered", "a"), ("override", "a"), ("refused", "a"), ("refused", "b"), ("read", "2"), ("find", "none"), ("keys", "a,b/n"), ("hook", "pre"), ("hook", "post")]


@_query(_values(_SEEN, "what, said"))
def registry_rules(spark, sf_dir):
    seen: list[tuple[str, str]] = []
    r = wiring.Registry(hooks=True)
    r.on_register(lambda k, v: None)
    r.register("a", 1)
    seen.append(("registered", "a"))
    r.register("a", 2, override=True)
    seen.append(("override", "a"))
    for key, override in (("a", False), ("b", True)):
        try:
            r.register(key, 3, override=override)
        except wiring.WiringError:
            seen.append(("refused", key))
    r.register(("b", "n"), 5)
    seen += [("read", str(r["a"])), ("find", str(r.find("zz", "none")).lower()), ("keys", ",".join(sorted("/".join(x for x in k if x) for k in r.registered_keys())))]
    said: list[str] = []
    r.on_pre(lambda k, v: said.append("pre"))
    r.on_post(lambda k, v: said.append("post"))
    r["a"], r.post("a", 1)
    return spark.createDataFrame(seen + [("hook", x) for x in said], "what string, said string")


class _Plain:
    pass


class _Own(_Plain):
    def __init__(self, n: int = 4):
        self.n = n


class _User:
    def __init__(self, held: _Plain):
        self.held = held


@_query(_values([("made", "9"), ("names", "double,plus"), ("wired", "4"), ("transient", "true"), ("single", "true"), ("lifecycle", "singleton")], "what, said"))
def factory_and_container(spark, sf_dir):
    f = wiring.Factory()
    f.register("double", lambda x: 2 * x)
    f.register("plus", lambda x, y: x + y)
    c = wiring.Container()
    c.register(_Plain, _Own)
    c.register(_User, _User, lifecycle="singleton")
    rows = [("made", str(f.create("plus", f.create("double", 2), 5))), ("names", ",".join(f.registered_callables())), ("wired", str(c[_User].held.n))]
    rows += [("transient", str(c[_Plain] is not c[_Plain]).lower()), ("single", str(c[_User] is c[_User]).lower()), ("lifecycle", c.describe(_User).lifecycle)]
    return spark.createDataFrame(rows, "what string, said string")


# generated tables

_NEXT = lambda s: f"xor(xor(xor({s}, ({s} * 8192) % M), xor({s}, ({s} * 8192) % M) // 128), (xor(xor({s}, ({s} * 8192) % M), xor({s}, ({s} * 8192) % M) // 128) * 131072) % M)".replace("M", "18446744073709551616")


def _draws(count: int) -> str:
    return f"x(i, s) AS (SELECT 0::BIGINT, 43::HUGEINT UNION ALL SELECT i + 1, {_NEXT('s')} FROM x WHERE i < {count})"


_WHOLE = ("int8", "int16", "uint8", "uint16", "uint32", "uint64")
_SPANS = {k: (datagen.INTEGERS[k][0], datagen.INTEGERS[k][1] - datagen.INTEGERS[k][0] + 1) for k in _WHOLE}


@_query(
    f"WITH RECURSIVE {_draws(7 * 300)} SELECT i::INTEGER AS n, "
    + ", ".join(f"({low} + max(s) FILTER (k = {j}) % {span})::BIGINT AS {k}" for j, (k, (low, span)) in enumerate(_SPANS.items()))
    + ", max(s) FILTER (k = 6) % 2 = 1 AS flag FROM (SELECT (i - 1) % 300 + 1 AS i, (i - 1) // 300 AS k, s FROM x WHERE i > 0) GROUP BY i"
)
def datagen_whole_numbers(spark, sf_dir):
    made = datagen.create_df(spark, {"n": "serial", **{k: k for k in _WHOLE}, "flag": "bool"}, 300)
    return made.select("n", *(F.col(k).cast("bigint").alias(k) for k in _WHOLE), "flag")


@_query(
    f"""WITH RECURSIVE {_draws(600 + 2526)},
u AS (SELECT (i - 1) // 2 AS row, (i - 1) % 2 AS half, s FROM x WHERE i BETWEEN 1 AND 600),
h AS (SELECT row, half, b, ((s // (CASE b WHEN 0 THEN 1 WHEN 1 THEN 256 WHEN 2 THEN 65536 WHEN 3 THEN 16777216 WHEN 4 THEN 4294967296 WHEN 5 THEN 1099511627776 WHEN 6 THEN 281474976710656 ELSE 72057594037927936 END)::HUGEINT) % 256)::INTEGER AS v FROM u, range(8) r(b)),
id AS (SELECT row, string_agg(printf('%02X', CASE WHEN half = 0 AND b = 7 THEN (v & 15) | 64 WHEN half = 1 AND b = 0 THEN (v & 63) | 128 ELSE v END), '' ORDER BY half, b) AS id FROM h GROUP BY row),
p AS (SELECT row, (sum(1 + row % 16) OVER (ORDER BY row) - (1 + row % 16))::BIGINT AS start, 1 + row % 16 AS n FROM range(300) r(row)),
raw AS (SELECT row, string_agg(printf('%02X', (s % 256)::INTEGER), '' ORDER BY i) AS raw FROM p JOIN x ON i - 601 >= start AND i - 601 < start + n GROUP BY row)
SELECT (row + 1)::INTEGER AS n, id, raw, (row::FLOAT * 1.23456789::FLOAT)::FLOAT AS f32 FROM id JOIN raw USING (row)"""
)
def datagen_bytes(spark, sf_dir):
    """Identifiers of two draws, bytes of one draw each, and single-precision numbers."""
    made = datagen.create_df(spark, {"n": "serial", "id": "uuid", "raw": "binary", "f32": "float32"}, 300)
    return made.select("n", F.hex("id").alias("id"), F.hex("raw").alias("raw"), "f32")


_COIN = "(s // 2048)::DOUBLE * pow(2.0, -53) < 0.3"


@_query(
    f"""WITH RECURSIVE x(i, c, s) AS (SELECT 0::BIGINT, false, 43::HUGEINT UNION ALL
SELECT i + 1, {_COIN}, CASE WHEN {_COIN} THEN s ELSE {_NEXT('s')} END FROM (SELECT i, {_NEXT('s')} AS s FROM x WHERE i < 500))
SELECT i::INTEGER AS n, CASE WHEN NOT c THEN (s % 100001)::INTEGER END AS a FROM x WHERE i > 0"""
)
def datagen_nulls(spark, sf_dir):
    """A coin before every value; a null takes no further draw."""
    return datagen.create_df(spark, {"n": "serial", "a": "int32"}, 500, null_fraction=0.3)


# scalar functions


@_query("SELECT DISTINCT year(d)::INTEGER AS year, month(d)::INTEGER AS month, day(d)::INTEGER AS day, (d - DATE '1970-01-01')::INTEGER AS days FROM (SELECT o_orderdate::DATE AS d FROM orders)")
def civil_days(spark, sf_dir):
    days = _table(spark, sf_dir, "orders").select(F.unix_date(F.col("o_orderdate").cast("date")).alias("days")).distinct()
    return days.select(moments.civil_from_days("days").alias("c"), "days").select("c.*", "days")


@_query(
    """WITH t AS (SELECT event_id, (epoch_us(ts) % 86400000000) * 1000 + event_id % 1000 AS ns FROM events)
SELECT event_id, (ns // 3600000000000)::INTEGER AS hour, (ns // 60000000000 % 60)::INTEGER AS minute, (ns // 1000000000 % 60)::INTEGER AS second, (ns // 100 % 10000000)::INTEGER AS fraction, (ns // 1000)::BIGINT AS micros FROM t"""
)
def times_of_day(spark, sf_dir):
    """Nanoseconds since midnight as parts, and parts as microseconds."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts)")
    nanos = (F.pmod(micros, F.lit(86_400_000_000)) * 1000 + F.col("event_id") % 1000).alias("ns")
    parts = _table(spark, sf_dir, "events").select("event_id", nanos).select("event_id", moments.time_parts("ns").alias("p"))
    again = moments.micros_since_midnight(F.col("p.hour"), F.col("p.minute"), F.col("p.second"), F.col("p.fraction"))
    return parts.select("event_id", "p.*", again.cast("bigint").alias("micros"))


@_query(
    """WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE l_linenumber % 4 WHEN 0 THEN 'KiB' WHEN 1 THEN 'mb' WHEN 2 THEN 'GB' ELSE 'B' END AS u, CASE l_linenumber % 3 WHEN 0 THEN 'min' WHEN 1 THEN 'h' ELSE 's' END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, q * CASE u WHEN 'KiB' THEN 1024.0::DOUBLE WHEN 'mb' THEN 1048576.0::DOUBLE WHEN 'GB' THEN 1073741824.0::DOUBLE ELSE 1.0::DOUBLE END AS bytes, q * CASE d WHEN 'min' THEN 60.0::DOUBLE WHEN 'h' THEN 3600.0::DOUBLE ELSE 1.0::DOUBLE END AS seconds FROM k"""
)
def units_of_size_and_time(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("KiB", "mb", "GB", "B"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    span = F.element_at(F.array(*map(F.lit, ("min", "h", "s"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", units.to_bytes(F.col("l_quantity"), unit).alias("bytes"), units.to_seconds(F.col("l_quantity"), span).alias("seconds"))


_WORDS = ["__init__", "___", "____", "_x_", "__a", "Año", "ÄB", "Z", "true", "1e3", "~", "word"]


@_query(
    "SELECT t AS text, starts_with(t, '__') AND ends_with(t, '__') AND length(t) >= 4 AS dunder, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, "
    "t IN ('true', '1e3', '~') AS quoted FROM (SELECT unnest([" + ", ".join(f"'{w}'" for w in _WORDS) + "]) AS t)"
)
def text_checks(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in _WORDS], "text string").select("text", scalars.is_dunder("text").alias("dunder"), scalars.ascii_lower("text").alias("low"), scalars.needs_quotes("text").alias("quoted"))


@_query("SELECT doc_id, text IS NOT NULL AND NOT contains(text, chr(0)) AS clean FROM documents WHERE text IS NOT NULL")
def utf8_gate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", scalars.is_clean_utf8(F.col("text").cast("binary")).alias("clean"))


_URLS = "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS p FROM pages"


def _url_paths(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "").alias("p"))


@_query(
    f"""WITH u AS ({_URLS}), n AS (SELECT page_id, p, list_filter(string_split(p, '/'), lambda x: x <> '') AS names FROM u)
SELECT page_id, list_concat(['/'], names) AS parts, list_transform(range(len(names) - 1, -1, -1), lambda k: '/' || array_to_string(names[1:k], '/')) AS parents,
len(names)::INTEGER AS depth, 'file:///' || array_to_string(list_transform(names, lambda x: url_encode(x)), '/') AS uri, true AS absolute FROM n"""
)
def path_ancestors(spark, sf_dir):
    urls = _url_paths(spark, sf_dir)
    return urls.select("page_id", paths.parts("p").alias("parts"), paths.parents("p").alias("parents"), (F.size(paths.parts("p")) - 1).alias("depth"), paths.uri("p").alias("uri"), paths.is_absolute("p").alias("absolute"))


@_query(
    f"""WITH u AS ({_URLS}), n AS (SELECT page_id, regexp_replace(p, '/+$', '') AS p FROM u), d AS (SELECT page_id, p, regexp_extract(p, '^(.*)/[^/]*$', 1) AS up, regexp_extract(p, '([^/]*)$', 1) AS name FROM n),
e AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^.+(\\.[^.]+)$', 1) ELSE '' END AS ext FROM d)
SELECT page_id, up || '/x.y' AS named, up || '/s' || ext AS stemmed, up || '/' || name[1:len(name) - len(ext)] || '.gz' AS suffixed, p || '/a/b' AS joined, '/root' || p AS below FROM e"""
)
def path_building(spark, sf_dir):
    u = _url_paths(spark, sf_dir)
    relative = F.substring(F.col("p"), F.lit(2), F.length("p"))
    return u.select(
        "page_id", paths.with_name("p", "x.y").alias("named"), paths.with_stem("p", "s").alias("stemmed"), paths.with_suffix("p", ".gz").alias("suffixed"), paths.joinpath("p", "a", "b").alias("joined"), paths.absolute(relative, "/root").alias("below")
    )


_FILES = ["a.tar.gz", ".bashrc", ".x.y", "n", "n.", "b/c.d.e.f"]


@_query(_values([(p, s, pa) for p, s, pa in (("a.tar.gz", ".tar|.gz", "."), (".bashrc", "", "."), (".x.y", ".y", "."), ("n", "", "."), ("n.", "", "."), ("b/c.d.e.f", ".d|.e|.f", "b"))], "p, suffixes, parent"))
def path_suffixes(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in _FILES], "p string").select("p", F.array_join(paths.suffixes("p"), "|").alias("suffixes"), paths.parent("p").alias("parent"))


# sets of paths


@_query("SELECT DISTINCT source AS path FROM documents WHERE source IS NOT NULL EXCEPT SELECT DISTINCT source FROM documents WHERE n_chars > 20000")
def path_set_difference(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return (PathSet(docs.select("source")) - PathSet(docs.where("n_chars > 20000").select("source"))).frame


@_query(f"WITH u AS ({_URLS}) SELECT DISTINCT regexp_replace(p, '/+$', '') AS path FROM u WHERE NOT p LIKE '%.html' OR regexp_matches(p, '/1[^/]*$')")
def path_set_filters(spark, sf_dir):
    """What lacks a suffix, or has a name that a pattern matches."""
    found = PathSet(_url_paths(spark, sf_dir).select(F.regexp_replace("p", "/+$", "")))
    return (found & (~ext(".html") | matches("1*"))).eval().frame


_TREE = ("a.yaml", "b.yml", "c.json", ".hidden/g.yaml", "sub/d.yaml", "sub/deep/e.yaml", "sub/_f.json")


@_query(
    _values([("iterdir", x) for x in (".hidden", "a.yaml", "b.yml", "c.json", "sub")] + [("glob *.y*", x) for x in ("a.yaml", "b.yml")] + [("glob sub/*.yaml", "d.yaml"), ("glob s?b/**", "_f.json"), ("glob s?b/**", "d.yaml"), ("glob s?b/**", "deep"), ("glob s?b/**", "e.yaml")]
            + [("rglob *.yaml", x) for x in ("a.yaml", "d.yaml", "e.yaml", "g.yaml")] + [("rglob deep", "deep")], "what, name")
)
def directory_walks(spark, sf_dir):
    """A tree of written files, listed in several ways; files of the read and of facts are the same ones."""
    base = new_path(spark, "tree").removeprefix("file:")
    base = "/" + base.lstrip("/")
    rows = spark.createDataFrame([(f"{base}/{p}",) for p in _TREE], "path string")
    documents.write_tree(rows.select("path", F.lit(b"k: 1").alias("content"))).collect()
    walks = {"iterdir": PathSet.iterdir(spark, base), "glob *.y*": PathSet.glob(spark, base, "*.y*"), "glob sub/*.yaml": PathSet.glob(spark, base, "sub/*.yaml"), "glob s?b/**": PathSet.glob(spark, base, "s?b/**"), "rglob *.yaml": PathSet.rglob(spark, base, "*.yaml"), "rglob deep": PathSet.rglob(spark, base, "deep")}
    out = None
    for what, found in walks.items():
        named = found.frame.select(F.lit(what).alias("what"), paths.name("path").alias("name"))
        out = named if out is None else out.unionByName(named)
    return out


@_query(_values([("a.txt", True, 4, "k: 1"), ("deep/b.txt", True, 4, "k: 1"), ("deep", False, None, None), ("missing", False, None, None)], "name, is_file, size, content"))
def files_and_facts(spark, sf_dir):
    """What the tasks see of paths, and the bytes of those that are files."""
    base = "/" + new_path(spark, "facts").removeprefix("file:").lstrip("/")
    names = ("a.txt", "deep/b.txt", "deep", "missing")
    documents.write_tree(spark.createDataFrame([(f"{base}/{n}",) for n in names[:2]], "path string").select("path", F.lit(b"k: 1").alias("content"))).collect()
    found = PathSet.of(spark, [f"{base}/{n}" for n in names])
    read = found.read_all_files().select("path", F.col("content").cast("string").alias("content"))
    size = F.when(F.col("is_file"), F.col("size")).cast("int")
    return documents.file_facts(found.frame).join(read, "path", "left").select(F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path")).alias("name"), "is_file", size.alias("size"), "content")


@_query("SELECT path, (row_number() OVER (ORDER BY path))::INTEGER AS place FROM (SELECT DISTINCT source AS path FROM documents WHERE source IS NOT NULL)")
def path_set_order(spark, sf_dir):
    """Paths in their order, as iterating over them gives them."""
    found = PathSet(_table(spark, sf_dir, "documents").select("source"))
    rows = [(p, k + 1) for k, p in enumerate(found)]
    return spark.createDataFrame(rows, "path string, place int")


# documents


def _written(spark, sf_dir, suffix: str, text) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return events.select(F.concat(F.col("event_id").cast("string"), F.lit(suffix)).alias("path"), text.cast("binary").alias("content"))


def _decoded(files: DataFrame) -> DataFrame:
    made = documents.read_documents(files)
    return made.select(F.regexp_extract("path", r"^\d+", 0).cast("bigint").alias("event_id"), F.get_json_object("json", "$.k").cast("bigint").alias("k"), F.get_json_object("json", "$.more[1].deep").alias("deep"))


_DECODED = "SELECT event_id, (props->>'$.k')::BIGINT AS k, 'yes' AS deep FROM events"


@_query(_DECODED)
def decode_yaml(spark, sf_dir):
    """Block style, with an anchor, and a word that only older versions of the format take for a truth value."""
    return _decoded(_written(spark, sf_dir, ".yml", F.concat(F.lit("# made\nk: &n "), F.col("k"), F.lit("\nmore:\n  - *n\n  - deep: yes\n"))))


@_query(_DECODED)
def decode_toml(spark, sf_dir):
    return _decoded(_written(spark, sf_dir, ".toml", F.concat(F.lit("k = "), F.col("k"), F.lit("\nmore = [{}, { deep = \"yes\" }]\n"))))


@_query("SELECT event_id, (props->>'$.k')::BIGINT AS k, engine FROM events, (SELECT unnest(['json', 'toml', 'yaml']) AS engine)")
def encode_documents(spark, sf_dir):
    """Written by each engine, and read again by the same."""
    events = _table(spark, sf_dir, "events").select("event_id", "props")
    out = None
    for engine in documents.ENGINES:
        again = documents.decoder(engine)(F.lit("x"), documents.encoder(engine)("props"))
        made = events.select("event_id", F.get_json_object(again, "$.k").cast("bigint").alias("k"), F.lit(engine).alias("engine"))
        out = made if out is None else out.unionByName(made)
    return out


# stores and queries


@_query(_values([("SELECT TOP 5 [a], [b]]c] FROM [s].[t] WHERE a > 1", "s|t", "dbo.t", "`k` decimal(12,2), `g` string, `w` boolean")], "tsql, parts, target, kinds"))
def names_and_dialects(spark, sf_dir):
    text = Query().select("a", "b]c").from_table("s.t").where("a > 1").limit(5).to_sql(TSqlDialect())
    kinds = sqltypes.custom_schema([("k", "decimal(12, 2)"), ("g", "uniqueidentifier"), ("w", "bit")])
    return spark.createDataFrame([(text, "|".join(split_name("s.t")), qualified("t", "dbo"), kinds)], "tsql string, parts string, target string, kinds string")


@_query("SELECT n_nationkey AS k, n_name AS name, n_nationkey + 0.5::DOUBLE AS x FROM nation")
def arrow_and_pandas(spark, sf_dir):
    """A table brought to the driver as Arrow and as pandas, and saved from each again."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 0.5).alias("x"))
    source = new_path(spark, "forms")
    DataStore(spark, source).save(rows, "t")
    store = DataStore(spark, new_path(spark, "forms"))
    store.save(DataStore(spark, source, Format.ARROW).load("t").slice(0, 10), "t")
    store.save(DataStore(spark, source, "pandas").load("t").iloc[10:], "t")
    return store.load("t")


@_query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def hooked_load(spark, sf_dir):
    """A hook that is given the loaded rows and returns others."""
    store = acquire_datastore(spark, sf_dir)
    store.add_post_transform(lambda frame: frame.where("o_totalprice > 1000").groupBy("o_orderpriority").agg(F.count("*").alias("n")))
    return store.load("orders")


@_query("SELECT 0::BIGINT AS left_over, true AS refused")
def save_of_nothing(spark, sf_dir):
    """An error, after which neither table nor file is there."""
    store = DataStore(spark, new_path(spark, "store"))
    try:
        store.save(_table(spark, sf_dir, "orders").where("o_totalprice < 0"), "nothing")
        refused = False
    except RuntimeError:
        refused = True
    return spark.createDataFrame([(len(store._files("nothing") or ()), refused)], "left_over long, refused boolean")


@_query("SELECT worker, count(*) AS n FROM (SELECT least((9007199254740993 + l_orderkey * 3 - (9007199254740993 + lo * 3)) // greatest(((hi - lo) * 3 + 1) // 7, 1), 6)::BIGINT AS worker FROM lineitem, (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem)) GROUP BY 1")
def ranges_of_large_keys(spark, sf_dir):
    """Keys beyond those that doubles tell apart."""
    rows = _table(spark, sf_dir, "lineitem").select((F.lit(9_007_199_254_740_993) + F.col("l_orderkey") * 3).alias("k"))
    low, high = ranges.bounds(rows, "k")
    return rows.groupBy(ranges.worker_of(F.col("k"), low, high, 7).alias("worker")).agg(F.count("*").alias("n"))


@_query("SELECT slice, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM (SELECT l_orderkey, ((row_number() OVER () - 1) * 7 // (SELECT count(*) FROM lineitem))::INTEGER AS slice FROM lineitem) GROUP BY 1")
def contiguous_slices(spark, sf_dir):
    """Seven slices of a table in its own order."""
    return ranges.slices(_table(spark, sf_dir, "lineitem"), 7).groupBy("slice").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@_query(_values([("a", "key"), ("b", "k"), ("c", None)], "columns, found"))
def detected_keys(spark, sf_dir):
    """The first whole number of a primary key."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType())])
    return spark.createDataFrame([("a", ranges.detect_key(schema, ["name", "key"])), ("b", ranges.detect_key(schema, ["k", "key"])), ("c", ranges.detect_key(schema, ["name"]))], "columns string, found string")


@_query(_values([("format", "unknown format 'xml'; there are spark, pandas, arrow"), ("limit", "limit must not be negative, but is -1"), ("name", "not a valid table to save to: 'a b'"), ("type", "x must be str, not int: 2"), ("option", "'z' isn't one of a, b"), ("unit", "rows must be positive"), ("shown", "DataStore(backend=parquet, format=arrow, transforms=0/1)")], "what, said"))
def errors_and_names(spark, sf_dir):
    """What wrong arguments are told, and how a store shows itself."""
    store = DataStore(spark, sf_dir, Format.ARROW)
    store.add_post_transform(lambda: None)

    def wrong():
        raise support.OptionError("z", "ab")

    tries = {"format": lambda: Format.of("xml"), "limit": lambda: Query("t").limit(-1), "name": lambda: qualified("a b"), "option": wrong, "unit": lambda: datagen.create_df(spark, {"a": "int8"}, 0)}
    rows = [("type", str(support.type_error(2, str, "x"))), ("shown", repr(store))]
    for what, action in tries.items():
        try:
            action()
        except (ValueError, support.LibraryError) as failure:
            rows.append((what, str(failure)))
    return spark.createDataFrame(rows, "what string, said string")


@_query("SELECT l_suppkey, sum(l_quantity) AS row_count, CASE WHEN max(l_tax) > 0 THEN sum(l_quantity) / max(l_tax) END AS rate FROM lineitem GROUP BY 1")
def worker_rates(spark, sf_dir):
    """Rows a second of the slowest worker; none where no time was measured."""
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_tax").alias("seconds"), F.col("l_quantity").alias("row_count"))
    made = metrics.merged(rows, ["l_suppkey"], ["seconds"], ["row_count"])
    return made.select("l_suppkey", "row_count", metrics.rate(F.col("row_count"), F.col("seconds")).alias("rate"))


# metrics and schemas


@_query("SELECT l_returnflag AS phase, sum(l_extendedprice) AS seconds FROM lineitem GROUP BY 1")
def timer_snapshot(spark, sf_dir):
    return metrics.snapshot(_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("phase"), F.col("l_extendedprice").alias("seconds")), "phase", "seconds")


@_query(_values([("save", 5, 3.0, 9.0), ("load", 3, 0.0, 2.0)], "what, row_count, slowest, total"))
def metric_objects(spark, sf_dir):
    """Two workers' measures put together: counts are summed, the slower one's waiting counts, totals of saves stay."""
    save = metrics.SaveMetrics(rows=2, write_seconds=3.0, total_seconds=9.0).merge(metrics.SaveMetrics(rows=3, write_seconds=1.0, total_seconds=5.0))
    load = metrics.LoadMetrics(rows=1, total_seconds=2.0).merge(metrics.LoadMetrics(rows=2, total_seconds=1.0))
    return spark.createDataFrame([("save", save.rows, save.write_seconds, save.total_seconds), ("load", load.rows, 0.0, load.total_seconds)], "what string, row_count int, slowest double, total double")


def _described(key: int, tags: list[str], share: float = 0.5, more: dict = None): ...


@_query(_values([("key", "integer", True, "bigint"), ("tags", "array", True, "array<string>"), ("share", "number", False, "double"), ("more", "string", False, "string")], "name, kind, needed, spark_type"))
def function_schema(spark, sf_dir):
    """A function's parameters as JSON Schema and as Spark types."""
    found, kinds = support.get_schema(_described), support.get_struct(_described)
    return spark.createDataFrame([(n, p["type"], n in found["required"], kinds[n].dataType.simpleString()) for n, p in found["properties"].items()], "name string, kind string, needed boolean, spark_type string")


@dataclasses.dataclass(frozen=True)
class _Coin:
    worth: int


@_query(_values([("ValueObject", True), ("Repository", True), ("Entity", False), ("Builder", False), ("Service", True)], "contract, met"))
def contracts(spark, sf_dir):
    coin, store = _Coin(3), acquire_datastore(spark, sf_dir)
    met = [("ValueObject", isinstance(coin, support.ValueObject)), ("Repository", isinstance(store, support.Repository)), ("Entity", isinstance(coin, support.Entity)), ("Builder", isinstance(coin, support.Builder)), ("Service", isinstance(coin, support.Service))]
    return spark.createDataFrame(met, "contract string, met boolean")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
