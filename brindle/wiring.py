"""Driver-side wiring: a strict registry, a factory of callables and a container that resolves dependencies."""

from __future__ import annotations

import inspect
import threading
import typing
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any


class WiringError(RuntimeError):
    """A registration or a resolution isn't possible."""


class Registry:
    """Values by (thing, name). Registering a known key needs ``override``, and overriding needs a known key.

    A class or function is known by its qualified name, or by identity with ``by_identity``; the name may be None.
    """

    def __init__(self, hooks: bool = False, by_identity: bool = False):
        self.hooks, self.by_identity = hooks, by_identity
        self._values: dict[tuple[Any, str | None], Any] = {}
        self._on_register: list[Callable] = []
        self._on_pre: list[Callable] = []
        self._on_post: list[Callable] = []

    def _key(self, key) -> tuple[Any, str | None]:
        thing, name = key if isinstance(key, tuple) and len(key) == 2 else (key, None)
        if isinstance(key, tuple) and len(key) != 2:
            raise WiringError("a key is a thing, or a thing and a name")
        if name is not None and not isinstance(name, str):
            raise TypeError("a name must be text or None")
        if self.by_identity:
            if isinstance(thing, str):
                raise TypeError("a registry by identity takes no text as a key")
            return id(thing), name
        return (thing if isinstance(thing, str) else f"{thing.__module__}.{thing.__qualname__}" if hasattr(thing, "__qualname__") else thing), name

    def register(self, key, value=None, *, override: bool = False):
        """Store a value; without one, a decorator that stores what it decorates and returns it."""
        if value is None:
            return lambda made: self.register(key, made, override=override) or made
        own = self._key(key)
        if own in self._values and not override:
            raise WiringError(f"{key!r} is registered already")
        if own not in self._values and override:
            raise WiringError(f"{key!r} is not registered, so it can't be overridden")
        if self.hooks:
            for hook in self._on_register:
                hook(key, value)
        self._values[own] = value
        return None

    def get(self, key):
        own = self._key(key)
        if own not in self._values:
            raise WiringError(f"{key!r} is not registered")
        if self.hooks:
            for hook in self._on_pre:
                hook(key, self._values[own])
        return self._values[own]

    __getitem__ = get

    def post(self, key, result) -> None:
        """Tell the hooks what came of a value."""
        if self.hooks:
            for hook in self._on_post:
                hook(key, result)

    def find(self, thing, name: str | None = None):
        """The value of (thing, name), else that of the thing without a name, else None."""
        return self._values.get(self._key((thing, name)), self._values.get(self._key((thing, None))))

    def __contains__(self, key) -> bool:
        return self._key(key) in self._values

    def __len__(self) -> int:
        return len(self._values)

    def registered_keys(self) -> list[tuple[Any, str | None]]:
        return list(self._values)

    def on_register(self, hook: Callable) -> None:
        self._on_register.append(hook)

    def on_pre(self, hook: Callable) -> None:
        self._on_pre.append(hook)

    def on_post(self, hook: Callable) -> None:
        self._on_post.append(hook)

    def __repr__(self) -> str:
        return f"Registry(size={len(self)}, hooks={self.hooks})"


class Factory:
    """Callables by name; what they make may be held to an interface."""

    def __init__(self, interface: type | None = None):
        self.interface, self._makers = interface, {}

    def register(self, name: str, maker: Callable | None = None, *, override: bool = False):
        if maker is None:
            return lambda made: self.register(name, made, override=override) or made
        if not callable(maker):
            raise TypeError(f"{maker!r} can't be called")
        if (name in self._makers) != override:
            raise WiringError(f"{name!r} is " + ("registered already" if name in self._makers else "not registered, so it can't be overridden"))
        self._makers[name] = maker
        return None

    def __getitem__(self, name: str) -> Callable:
        if name not in self._makers:
            raise WiringError(f"{name!r} is not registered")
        return self._makers[name]

    def create(self, name: str, *args, **kwargs):
        made = self[name](*args, **kwargs)
        if self.interface is not None and not isinstance(made, self.interface):
            raise TypeError(f"{name!r} made a {type(made).__name__}, not a {self.interface.__name__}")
        return made

    def registered_callables(self) -> list[str]:
        return sorted(self._makers)

    def use_module(self, module, names: Iterable[str] | None = None) -> None:
        """Register a module's public callables by their names."""
        for name in names or [n for n in vars(module) if not n.startswith("_")]:
            if callable(found := getattr(module, name)) and getattr(found, "__module__", None) == module.__name__:
                self.register(name, found)


@dataclass(frozen=True)
class Service:
    """How an interface is provided."""

    interface: type
    provider: Callable
    name: str | None = None
    lifecycle: str = "transient"
    decorators: tuple[Callable, ...] = ()
    autowire: bool = True
    generation: int = 0


class Container:
    """Providers of interfaces; resolving one resolves what its provider asks for by annotation."""

    def __init__(self):
        self._services: dict[tuple[type, str | None], Service] = {}
        self._single: dict[tuple[type, str | None], tuple[int, Any]] = {}
        self._lock = threading.RLock()
        self._open = threading.local()

    def register(self, interface: type, provider: Callable | None = None, *, name: str | None = None, lifecycle: str = "transient", decorators: Iterable[Callable] = (), autowire: bool = True, override: bool = False):
        if provider is None:
            return lambda made: self.register(interface, made, name=name, lifecycle=lifecycle, decorators=decorators, autowire=autowire, override=override) or made
        if not isinstance(interface, type):
            raise TypeError("an interface must be a class")
        if not callable(provider):
            raise TypeError(f"{provider!r} can't be called")
        if lifecycle not in ("transient", "singleton"):
            raise ValueError(f"unknown lifecycle {lifecycle!r}")
        key = (interface, name)
        with self._lock:
            old = self._services.get(key)
            if (old is not None) != override:
                raise WiringError(f"{interface.__name__} is " + ("registered already" if old else "not registered, so it can't be overridden"))
            self._services[key] = Service(interface, provider, name, lifecycle, tuple(decorators), autowire, old.generation + 1 if old else 0)
            self._single.pop(key, None)
        return None

    @staticmethod
    def _split(key) -> tuple[type, str | None]:
        return key if isinstance(key, tuple) else (key, None)

    def resolve(self, key):
        key = self._split(key)
        service = self._services.get(key)
        if service is None:
            raise WiringError(f"nothing provides {getattr(key[0], '__name__', key[0])}" + (f" named {key[1]!r}" if key[1] else ""))
        if service.lifecycle == "singleton" and (held := self._single.get(key)) and held[0] == service.generation:
            return held[1]
        path = self.__dict__["_open"].__dict__.setdefault("path", [])
        if key in path:
            raise WiringError("a cycle: " + " -> ".join(k[0].__name__ for k in [*path[path.index(key) :], key]))
        path.append(key)
        try:
            made = service.provider(**self._arguments(service)) if service.autowire else service.provider()
            for decorate in service.decorators:
                made = decorate(made)
        finally:
            path.pop()
        if not self._fits(made, service.interface):
            raise TypeError(f"the provider made a {type(made).__name__}, which is no {service.interface.__name__}")
        if service.lifecycle == "singleton":
            with self._lock:
                # an override since then must not be undone, and of two threads the first one's value stays
                if self._services.get(key) is service:
                    made = self._single.setdefault(key, (service.generation, made))[1]
        return made

    __getitem__ = resolve

    @staticmethod
    def _fits(made, interface: type) -> bool:
        try:
            return isinstance(made, interface)
        except TypeError:  # a protocol that isn't checkable at run time
            return True

    def _arguments(self, service: Service) -> dict[str, Any]:
        target = service.provider.__init__ if inspect.isclass(service.provider) else service.provider
        if target is object.__init__:
            return {}
        try:
            hints = typing.get_type_hints(target)
        except NameError:
            hints = {}
        out = {}
        for p in inspect.signature(service.provider).parameters.values():
            if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD):
                continue
            if p.kind is p.POSITIONAL_ONLY:
                raise WiringError(f"{p.name!r} can only be given by position")
            wanted = hints.get(p.name)
            if wanted is not None and (wanted, None) in self._services:
                out[p.name] = self.resolve(wanted)
            elif p.default is p.empty:
                raise WiringError(f"{p.name!r} has no annotation, and no default" if wanted is None else f"nothing provides {p.name!r}, and it has no default")
        return out

    def describe(self, key) -> Service:
        key = self._split(key)
        if key not in self._services:
            raise WiringError(f"nothing provides {key!r}")
        return replace(self._services[key])

    def registered_keys(self) -> list[tuple[type, str | None]]:
        return list(self._services)

    def __contains__(self, key) -> bool:
        return self._split(key) in self._services

    def __len__(self) -> int:
        return len(self._services)
