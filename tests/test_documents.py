import json
import math
import random
import tomllib

import pytest
from pyspark.errors import PySparkException

from brindle.sources import documents as D

yaml = pytest.importorskip("yaml")

VALUES = [{"a": 1, "b": [1, 2.5, None], "c": {"d": "x"}}, {"true": "true", "n": "null", "h": "0x1A", "f": "1e3", "y": "yes", "i": ".inf", "e": "", "o": "010"}, {"list": [{"a": 1}, {"b": []}, {}], "s": "line\nbreak: #x"}, {"u": "é 漢字 🎉", "q": 'say "hi"'}, {"big": 2**63 - 1, "neg": -5, "flt": 0.1}]


@pytest.mark.parametrize("value", VALUES)
@pytest.mark.parametrize("engine", D.ENGINES)
def test_round_trips(value, engine):
    if engine == "toml" and "null" in json.dumps([x for x in value.get("b", [])] if isinstance(value.get("b"), list) else []):
        value = value | {"b": [1, 2.5]}
    assert D.decode(D.encode(value, engine), engine) == value


@pytest.mark.parametrize("text, value", [("a: 010", {"a": 10}), ("a: yes", {"a": "yes"}), ("a: 0o17", {"a": 15}), ("a: 0x1F", {"a": 31}), ("a: 12e03", {"a": 12000.0}), ("a: -.inf", {"a": -math.inf}), ("a: '1'", {"a": "1"}), ("a: ~", {"a": None}), ("a: 2001-01-01", {"a": "2001-01-01"}), ("- 1\n- b", [1, "b"]), ("x: &p {k: 1}\ny: *p", {"x": {"k": 1}, "y": {"k": 1}}), ("b: &b {k: 1, z: 2}\nc:\n  <<: *b\n  k: 3", {"b": {"k": 1, "z": 2}, "c": {"k": 3, "z": 2}}), ("a: 1\na: 2", {"a": 2}), ("a: 1\n---\nb: 2", [{"a": 1}, {"b": 2}]), ("", None)])
def test_yaml_by_the_core_schema(text, value):
    assert D.decode(text.encode(), "yaml") == value


def test_small_documents_cost_little(monkeypatch):
    """Plain block style takes no parser of all of YAML, other documents no constructor of PyYAML's for each of their nodes."""
    block = "# made\nk: &n 7\nmore:\n  - *n\n  - deep: yes\n    x: 'a: b'  # c\nlast:\n- []\n-\n"
    flow = "{k: &n 7, more: [*n, {deep: yes, x: 'a: b'}], last: [[], null]}"
    value = {"k": 7, "more": [7, {"deep": "yes", "x": "a: b"}], "last": [[], None]}
    calls = []
    usual = yaml.constructor.BaseConstructor.construct_object
    monkeypatch.setattr(yaml.constructor.BaseConstructor, "construct_object", lambda *a, **k: calls.append(a) or usual(*a, **k))
    assert D.decode(flow.encode(), "yaml") == value and not calls
    monkeypatch.setattr(yaml, "load_all", lambda *_: pytest.fail("PyYAML was called"))
    assert D.decode(block.encode(), "yaml") == value


class Usual(D._yaml_loader()):
    construct_document = yaml.SafeLoader.construct_document


def by_pyyaml(text):
    """By PyYAML's own walk over the nodes."""
    try:
        found = list(yaml.load_all(text, Usual))
    except (yaml.YAMLError, RecursionError, ValueError):
        return "broken"
    return repr(None if not found else found[0] if len(found) == 1 else found)


def by_decode(text):
    try:
        return repr(D.decode(text.encode(), "yaml"))
    except D.DocumentError:
        return "broken"


EDGES = ["a: b\n  c", "a: b\n  - c", "- a\n  - b", "- a\nb: 1", "a:\n- 1\nb: 2", "a: 1\n- 2", "a:\n  - 1\n- 2", "- x: b\n  - c", "- x:\n  - c\n  y: 2", "- x:\n y: 2", "-\n- a", "-\n  - a", "a:\n    b: 1\n  c: 2", "a: &n 1\nb: &n 2", "a: *n", "a: &n\nb: *n", "a: &n [*n]", "a: &n {b: *n}", "a: 1\na:\n  b: 2", "1: a\n0x1: b\ntrue: c\n~: d", "a: ~\nb: null\nc:", "k : v", "a: b: c", "a: b#c", "a: b #c", "a: 'it''s'", 'a: "x\\n"', 'a: "b', "a: ' s '", "  a: 1", "---\na: 1", "a: 1\n...\n", "- - a", "- -5", "a:\t1", "a: 1\r\nb: 2", "x" * 1100 + ": 1", "a: " + "x" * 5000, "a: " + "1" * 5000, "é: é", "<<: {a: 1}\nb: 2", "? a\n: b", "- !!int '5'\n- !!str 5\n- !x y\n- !!set {a}", "\n".join(" " * k + "a:" for k in range(60)), "", "#", "a"]


@pytest.mark.parametrize("text", EDGES)
def test_yaml_is_pyyamls_at_the_edges(text):
    assert by_decode(text) == by_pyyaml(text)


def test_yaml_is_pyyamls_in_any_lines():
    random.seed(7)
    parts = ["a: 1", "b:", "c: x y", "- 1", "-", "- a: 2", "- b:", "-   c: &n 3", "*n", "d: *n", "- *n", "# c", "", "e: 'q: r'", "- []", "f: {a: *n}", "- &n z", "1: .5", "<<: {g: 1}"]
    read = 0
    for _ in range(3000):
        text = "\n".join(" " * random.choice([0, 0, 2, 2, 4, 1]) + random.choice(parts) for _ in range(random.randint(1, 5)))
        assert by_decode(text) == by_pyyaml(text), text
        read += D._block(text) is not None
    assert read > 100


def test_json_is_strict():
    for text in ('{"a": [1, 2.5, "x", null, true]}', "18446744073709551615", '"\\u00e9"', "[]"):
        assert D.decode(text.encode(), "json") == json.loads(text)
    for bad in ("18446744073709551616", "NaN", "{", "[1,]", ""):
        with pytest.raises(D.DocumentError):
            D.decode(bad.encode(), "json")


def test_toml_is_tomllibs():
    text = 'a = 1\nd = 2020-01-02\nt = 07:32:00\n[x]\ny = [1, 2]\nz = 1979-05-27T07:32:00Z'
    assert D.decode(text.encode(), "toml") == tomllib.loads(text)
    for bad in (3, [1]):
        with pytest.raises(D.DocumentError):
            D.encode(bad, "toml")


@pytest.mark.parametrize("engine, text", [("yaml", "a: 1"), ("json", '{"a": 1}'), ("toml", "a = 1")])
def test_encodings(engine, text):
    assert D.decode(b"\xef\xbb\xbf" + text.encode(), engine) == {"a": 1}
    for bad in (text.encode("utf-16"), text.encode() + b"\0", text.encode() + b"\xff"):
        with pytest.raises(D.DocumentError):
            D.decode(bad, engine)


def test_engines():
    assert D.resolve_engine("x.YML") == "yaml" and D.resolve_engine("x.json", "toml") == "toml" and D.resolve_engine("x", pinned="json") == "json"
    with pytest.raises(ValueError):
        D.resolve_engine("x.txt")


def test_nasty_documents_never_crash():
    random.seed(42)
    nasty = ["[" * 500, "{" * 500, "&a *a", "a: [", "- - - -", "%YAML 9.9", "\t- x", "? : ?", "!!python/object:os.system x", "*x"] + ["".join(random.choice("{}[]:,-&*!|>'\"%@`#\n ab1.") for _ in range(60)) for _ in range(100)]
    for text in nasty:
        for engine in D.ENGINES:
            try:
                D.decode(text.encode(), engine)
            except D.DocumentError:
                pass


def test_over_frames(spark, tmp_path):
    rows = [("a.json", bytearray(b'{"a": 1}')), ("b.yaml", bytearray(b"a: 2")), ("c.toml", bytearray(b"a = 3")), ("d.json", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    read = D.read_documents(files)
    assert {r.path: r.json for r in read.collect()} == {"a.json": '{"a":1}', "b.yaml": '{"a":2}', "c.toml": '{"a":3}', "d.json": None}
    assert D.read_documents(files.selectExpr("path", "cast('{' as binary) content"), errors="null").where("json IS NOT NULL").count() == 0
    with pytest.raises(PySparkException):
        D.read_documents(files.selectExpr("path", "cast('{' as binary) content")).collect()
    made = read.where("json IS NOT NULL").selectExpr("path", "json").withColumn("content", D.encoder("yaml")("json")).selectExpr(f"concat('{tmp_path}/', path, '.yaml') path", "content")
    assert D.write_files(made).count() == 3
    D.write_files(made).collect()
    back = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(r.json for r in D.read_documents(back).collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']
