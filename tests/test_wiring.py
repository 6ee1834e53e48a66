import threading

import pytest

from brindle import support
from brindle.wiring import Container, Factory, Registry, WiringError


def test_registry_is_strict_both_ways():
    r = Registry(hooks=True)
    seen = []
    r.on_register(lambda k, v: seen.append(("register", k)))
    r.on_pre(lambda k, v: seen.append(("pre", v)))
    r.on_post(lambda k, v: seen.append(("post", v)))
    r.register(("a", "x"), 1)
    r.register("a", 2)
    with pytest.raises(WiringError):
        r.register("a", 3)
    with pytest.raises(WiringError):
        r.register("b", 3, override=True)
    r.register("a", 4, override=True)
    assert r["a"] == 4 and len(r) == 2 and ("a", "x") in r and "b" not in r
    r.post("a", 9)
    assert r.find("a", "none") == 4 and r.find("zz") is None and seen[-1] == ("post", 9) and ("pre", 4) in seen

    @r.register("f")
    def f():
        return 1

    assert r["f"] is f and f() == 1 and "size=3" in repr(r)
    with pytest.raises(WiringError):
        r["none"]
    with pytest.raises(WiringError):
        r.register(("a", "b", "c"), 1)
    with pytest.raises(TypeError):
        r.register(("a", 3), 1)


def test_registry_by_identity():
    r, thing = Registry(by_identity=True), object()
    r.register(thing, 1)
    assert r[thing] == 1 and object() not in r
    with pytest.raises(TypeError):
        r.register("text", 1)


def test_factory():
    f = Factory(int)
    f.register("double", lambda x, y=0: x * 2 + y)
    f.register("text", lambda: "x")
    assert f.create("double", 3, y=1) == 7 and f.registered_callables() == ["double", "text"]
    with pytest.raises(TypeError):
        f.create("text")
    with pytest.raises(TypeError):
        f.register("bad", 1)
    with pytest.raises(WiringError):
        f.register("double", int)
    with pytest.raises(WiringError):
        f["none"]


class Base:
    pass


class Impl(Base):
    pass


class Needs:
    def __init__(self, base: Base, n: int = 3, *more):
        self.base, self.n = base, n


def test_container():
    c = Container()
    c.register(Base, Impl)
    c.register(Needs, Needs, lifecycle="singleton", decorators=[lambda x: x])
    assert c[Base] is not c[Base] and c[Needs] is c[Needs] and isinstance(c[Needs].base, Impl) and c[Needs].n == 3
    old = c[Needs]
    c.register(Needs, Needs, lifecycle="singleton", override=True)
    assert c[Needs] is not old and len(c) == 2 and Base in c
    assert c.describe(Needs).lifecycle == "singleton"
    with pytest.raises(WiringError):
        c.register(Base, Impl)
    with pytest.raises(TypeError):
        c.register("x", Impl)
    with pytest.raises(WiringError):
        Container().resolve(Base)
    c.register(Base, Impl, name="n")
    assert isinstance(c[(Base, "n")], Impl)
    made = []
    threads = [threading.Thread(target=lambda: made.append(c[Needs])) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(set(map(id, made))) == 1


def test_container_refuses():
    class A:
        def __init__(self, b: "B"): ...

    class B:
        def __init__(self, a: A): ...

    globals().update(A=A, B=B)
    c = Container()
    c.register(A, A)
    c.register(B, B)
    with pytest.raises(WiringError, match="cycle"):
        c[A]

    def plain(x): ...

    c.register(Base, plain)
    with pytest.raises(WiringError, match="annotation"):
        c[Base]
    c.register(Base, lambda: 3, override=True)
    with pytest.raises(TypeError):
        c[Base]


def test_schemas_timers_and_contracts():
    def f(a: int, b: list[str], c: float = 1.0, d: dict = None): ...

    s = support.get_schema(f)
    assert s["required"] == ["a", "b"] and s["properties"]["b"] == {"type": "array", "items": {"type": "string"}} and s["properties"]["d"] == {"type": "string"}
    assert support.get_struct(f).simpleString() == "struct<a:bigint,b:array<string>,c:double,d:string>"

    def g(a, *b): ...

    with pytest.raises(TypeError, match="annotation.*any number|'a'.*'b'"):
        support.get_schema(g)
    said = []
    with support.quick_timer("t", printer=said.append):
        pass
    with support.quick_profile(3, printer=said.append):
        sum(range(10))
    assert said[0] == "t: begins" and said[1].startswith("t: 0.") and len(said) == 3
    with support.quick_timer("t", printer=said.append, print_on_start=False) as so_far:
        assert 0 <= so_far() < 5
    assert len(said) == 4
    t, u = support.PhaseTimer(), support.PhaseTimer()
    t.start("a"), t.start("b"), t.stop()
    u.start("a"), u.stop()
    t.merge(u)
    assert set(t.seconds) == {"a", "b"}

    class Repo:
        def load(self): ...
        def save(self, entity): ...

    assert isinstance(Repo(), support.Repository) and not isinstance(object(), support.Builder)
    assert not isinstance(type("Half", (), {"load": lambda self: 1})(), support.Repository)

    class Color:
        __slots__ = ("red",)

        def __init__(self, red):
            self.red = red

        def __eq__(self, other):
            return isinstance(other, Color) and self.red == other.red

    assert isinstance(Color(1), support.ValueObject) and Color.__hash__ is None
    assert isinstance(type("E", (), {"id": property(lambda self: 1)})(), support.RootEntity) and not isinstance(Color(1), support.Entity)


def test_errors_and_profiles(monkeypatch):
    assert str(support.type_error(2, (str, None), "x")) == "x must be str or None, not int: 2" and str(support.type_error(int, str)) == "value must be str, not int"
    assert str(support.file_error("/no/such")) == "/no/such: not found"
    assert str(support.LibraryError("a", 2)) == "a\n2" and str(support.DispatchFailure()) == "No way to handle a value."
    assert "'z' isn't one of a, b" == str(support.OptionError("z", "ab")) and issubclass(support.MissingTarget, FileNotFoundError) and issubclass(support.UnknownType, TypeError)
    said, stops = [], []
    monkeypatch.setattr("builtins.breakpoint", lambda: stops.append(1))
    with support.quick_profile(1, printer=said.append, examine=True):
        sorted(range(10))
    assert len(said) == 1 and stops == [1]
