"""YAML, JSON and TOML documents: typed strictly, read and written in Arrow functions.

Documents of any shape come out as JSON text, which ``parse_json`` turns into a VARIANT; ``typed`` does both. Dates and
times, which JSON lacks, come out in ISO form. The engine is the one asked for, else the pinned one, else that of the
path's suffix. Broken documents raise, or give null with ``errors="null"``.

PyYAML reads YAML where it is installed; scalars are typed by the 1.2 core schema, not PyYAML's own. Documents in plain
block style, which most are, are read line by line to the same values; what has anything else in it goes to PyYAML whole.
"""

from __future__ import annotations

import datetime
import functools
import json
import math
import os
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalars import PATTERNS

SUFFIXES = {".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml"}
ENGINES = ("yaml", "json", "toml")
_TYPED = re.compile("|".join(rf"(?P<{kind}>{pattern}\Z)" for kind, pattern in PATTERNS.items()))


class DocumentError(RuntimeError):
    """A document can't be decoded or encoded."""


def resolve_engine(path: str, engine: str | None = None, pinned: str | None = None) -> str:
    found = engine or pinned or SUFFIXES.get(os.path.splitext(path)[1].lower())
    if found not in ENGINES:
        raise ValueError(f"no engine for {path!r}: {found!r}; there are {', '.join(ENGINES)}")
    return found


def text_of(content: bytes) -> str:
    """UTF-8 text; a byte order mark of UTF-8 is dropped, one of UTF-16 and NUL are errors."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise DocumentError("the document is UTF-16, not UTF-8")
    if b"\0" in content:
        raise DocumentError("the document holds a NUL byte")
    try:
        return content.removeprefix(b"\xef\xbb\xbf").decode()
    except UnicodeDecodeError as broken:
        raise DocumentError(f"the document isn't UTF-8: {broken}") from None


def scalar(text: str):
    """The value of a plain scalar by the YAML 1.2 core schema."""
    found = _TYPED.match(text)
    kind = found and found.lastgroup
    if kind is None:
        return text
    if kind == "null":
        return None
    if kind == "bool":
        return text.lower() == "true"
    if kind == "int":
        return int(text, 0) if text[:2] in ("0x", "0o") else int(text)
    if kind == "special":
        return math.nan if text.lower() == ".nan" else math.copysign(math.inf, -1 if text[0] == "-" else 1)
    return float(text)


class _Within(Exception):
    """A document holds itself by an alias."""


@functools.lru_cache(maxsize=1)
def _yaml_loader():
    """The loader, built once in a worker: the C one where PyYAML has it."""
    import yaml

    merge, value = "tag:yaml.org,2002:merge", "tag:yaml.org,2002:value"
    tags = {yaml.ScalarNode: "tag:yaml.org,2002:str", yaml.SequenceNode: "tag:yaml.org,2002:seq", yaml.MappingNode: "tag:yaml.org,2002:map"}

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers: dict = {}

        def resolve(self, kind, text, implicit):
            return merge if text == "<<" and kind is yaml.ScalarNode and implicit[0] else tags[kind]

        def construct_document(self, node):
            """As PyYAML's, which takes most of the time of small documents: scalars, lists and mappings without another tag are made here."""
            try:
                return made(self, node, {})
            except _Within:
                return super().construct_document(node)
            finally:
                self.constructed_objects, self.recursive_objects = {}, {}

    def made(loader, node, known):
        tag = node.tag
        if type(node) is yaml.ScalarNode:
            return plain(loader, node) if tag == tags[yaml.ScalarNode] else loader.construct_object(node, deep=True)
        if node in known:  # by an alias
            if known[node] is _Within:
                raise _Within
            return known[node]
        known[node] = _Within
        if type(node) is yaml.MappingNode and tag == tags[yaml.MappingNode]:
            if any(k.tag in (merge, value) for k, _ in node.value):
                loader.flatten_mapping(node)
            out = {_key(made(loader, k, known)): made(loader, v, known) for k, v in node.value}
        elif type(node) is yaml.SequenceNode and tag == tags[yaml.SequenceNode]:
            out = [made(loader, x, known) for x in node.value]
        else:
            out = loader.construct_object(node, deep=True)
        known[node] = out
        return out

    def plain(loader, node):
        return node.value if node.style else scalar(node.value)

    def mapping(loader, node, deep=True):
        loader.flatten_mapping(node)
        return {_key(loader.construct_object(k, deep=True)): loader.construct_object(v, deep=True) for k, v in node.value}

    def other(loader, node):
        if isinstance(node, yaml.MappingNode):
            return mapping(loader, node)
        return loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else node.value

    Loader.add_constructor("tag:yaml.org,2002:str", plain)
    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    Loader.add_constructor(None, other)
    return Loader


def _yaml(text: str):
    try:
        import yaml
    except ImportError:
        raise DocumentError("PyYAML isn't installed") from None
    try:
        if (block := _block(text)) is not None:
            return block
        found = list(yaml.load_all(text, _yaml_loader()))
    except (yaml.YAMLError, RecursionError, ValueError) as broken:
        raise DocumentError(f"broken YAML: {broken}") from None
    return None if not found else found[0] if len(found) == 1 else found


#: A plain scalar that is one however it is read: no colon, no mark of YAML's own.
_WORD = r"[-+]?\.?[A-Za-z0-9_][\w./+-]*+(?: ++[\w./+-]++)*+"
_PRINTABLE = re.compile(r"[\n -~]*")
#: Each line: its indent, the dash of a list's entry, key, anchor, value as a word, in quotes, by an alias or as an empty collection; else the rest of it.
_LINES = re.compile(rf"""^( *+)(?:(-(?: ++|$))?(?:({_WORD}):(?: ++|$))?(?:&([\w-]++) ++)?(?:({_WORD}|~)|("[^"\\\n]*+"|'[^'\n]*+')|\*([\w-]++)|(\[\]|\{{\}}))? *+(?:(?<= )\#.*)?$|(.+))""", re.ASCII | re.MULTILINE)


def _block(text: str) -> dict | list | None:
    """
    The value of a document whose every line is a comment, ``key: x``, ``- x`` or ``- key: x``, where x is a word or words, simply
    quoted text, an empty collection, an alias, or nothing with the lines further in below it. None for any other document, and for broken ones.
    """
    if not _PRINTABLE.fullmatch(text):
        return None
    open_: list[tuple[int, dict | list]] = []  # the blocks that the next line may be in, each with its column
    waits = None  # where the last line left a value out: a block further in goes there
    anchors: dict = {}
    for indent, dash, key, anchor, word, quoted, alias, empty, rest in _LINES.findall(text):
        if not dash and not key:
            if word or quoted or alias or empty or anchor or rest and rest[0] != "#":
                return None
            continue
        at = len(indent)
        while open_ and at < open_[-1][0]:
            open_.pop()
            waits = None
        if not open_ or at > open_[-1][0] or dash and type(open_[-1][1]) is dict:
            inner: dict | list = [] if dash else {}
            if waits:
                waits[0][waits[1]] = inner
            elif open_ or at:
                return None
            open_.append((at, inner))
        elif not dash and type(open_[-1][1]) is list:
            open_.pop()  # a list in its key's own column
            if not open_ or open_[-1][0] != at:
                return None
        block = open_[-1][1]
        if dash:
            place = len(block)
            block.append(None)
            if key:
                block[place] = inner = {}
                open_.append((at + len(dash), inner))
                block = inner
        if key:
            if len(key) > 1000:
                return None
            place = _plain_key(key)
        waits = None
        if word or quoted:
            x = scalar(word) if word else quoted[1:-1]
            if anchor:
                if anchor in anchors:
                    return None
                anchors[anchor] = x
        elif anchor or alias and alias not in anchors:
            return None
        elif alias:
            x = anchors[alias]
        elif empty:
            x = [] if empty == "[]" else {}
        else:
            x, waits = None, (block, place)
        block[place] = x
        if len(open_) > 50:
            return None
    return open_[0][1] if open_ else None


@functools.lru_cache(maxsize=4096)
def _plain_key(text: str) -> str:
    return _key(scalar(text))


def _key(k):
    return k if isinstance(k, str) else json.dumps(k) if not isinstance(k, (list, dict)) else json.dumps(k, sort_keys=True)


def _json(text: str):
    def whole(digits: str) -> int:
        value = int(digits)
        if not -(1 << 63) <= value < 1 << 64:
            raise DocumentError(f"{digits} has more than 64 bits")
        return value

    def refuse(name: str):
        raise DocumentError(f"{name} isn't JSON")

    try:
        return json.loads(text, parse_int=whole, parse_constant=refuse)
    except (ValueError, RecursionError) as broken:
        raise DocumentError(f"broken JSON: {broken}") from None


def _toml(text: str):
    try:
        return tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError) as broken:
        raise DocumentError(f"broken TOML: {broken}") from None


def decode(content: bytes, engine: str):
    """The document's value."""
    return {"yaml": _yaml, "json": _json, "toml": _toml}[engine](text_of(content))


def _plain(x):
    if isinstance(x, (datetime.datetime, datetime.date, datetime.time)):
        return x.isoformat()
    if isinstance(x, bytes):
        return x.decode()
    raise TypeError(type(x).__name__)


_TEXT = json.JSONEncoder(default=_plain, ensure_ascii=False, separators=(",", ":"))


def to_json_text(value) -> str:
    return _TEXT.encode(value)


# writing


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _yaml_scalar(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return ".nan" if math.isnan(x) else ("-.inf" if x < 0 else ".inf") if math.isinf(x) else repr(x)
    if isinstance(x, int):
        return str(x)
    text = x if isinstance(x, str) else _plain(x)
    safe = re.match(r"[A-Za-z_][\w ./+-]*\Z", text) and text == text.strip() and isinstance(scalar(text), str)
    return text if safe else _quoted(text)


def _yaml_lines(x, indent: int) -> Iterator[str]:
    pad = "  " * indent
    if isinstance(x, dict) and x:
        for k, v in x.items():
            nested = isinstance(v, (dict, list)) and v
            yield f"{pad}{_yaml_scalar(k)}:" + ("" if nested else f" {_yaml_flat(v)}")
            if nested:
                yield from _yaml_lines(v, indent + 1)
    elif isinstance(x, list) and x:
        for v in x:
            if isinstance(v, (dict, list)) and v:
                yield f"{pad}-"
                yield from _yaml_lines(v, indent + 1)
            else:
                yield f"{pad}- {_yaml_flat(v)}"
    else:
        yield pad + _yaml_flat(x)


def _yaml_flat(x) -> str:
    return "{}" if x == {} and isinstance(x, dict) else "[]" if x == [] and isinstance(x, list) else _yaml_scalar(x)


def _toml_value(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else ("-inf" if x < 0 else "inf") if math.isinf(x) else repr(x)
    if isinstance(x, int):
        if not -(1 << 63) <= x < 1 << 63:
            raise DocumentError(f"{x} is no 64-bit integer")
        return str(x)
    if isinstance(x, (datetime.datetime, datetime.date, datetime.time)):
        return x.isoformat()
    if isinstance(x, str):
        return _quoted(x).replace("\x7f", "\\u007f")
    if isinstance(x, list):
        return "[" + ", ".join(map(_toml_value, x)) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_value(v)}" for k, v in x.items()) + "}"
    raise DocumentError(f"TOML has no {type(x).__name__}")


def _toml_key(k: str) -> str:
    return k if re.match(r"[A-Za-z0-9_-]+\Z", k) else _quoted(k)


def _toml_lines(table: dict, prefix: str) -> Iterator[str]:
    for k, v in table.items():
        if not isinstance(v, dict):
            yield f"{_toml_key(k)} = {_toml_value(v)}"
    for k, v in table.items():
        if isinstance(v, dict):
            yield f"\n[{prefix}{_toml_key(k)}]"
            yield from _toml_lines(v, f"{prefix}{_toml_key(k)}.")


def encode(value, engine: str) -> bytes:
    """The document's bytes; decoding them gives the value again."""
    if engine == "json":
        return json.dumps(value, default=_plain, ensure_ascii=False, allow_nan=False).encode()
    if engine == "yaml":
        return ("\n".join(_yaml_lines(value, 0)) + "\n").encode()
    if not isinstance(value, dict):
        raise DocumentError("a TOML document must be a table")
    return ("\n".join(_toml_lines(value, "")) + "\n").encode()


# over DataFrames


def decoder(engine: str | None = None, errors: str = "raise"):
    """A Column function: (path, content) to JSON text."""

    def run(paths: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for path, content in zip(paths.to_pylist(), contents.to_pylist()):
            try:
                out.append(None if content is None else to_json_text(decode(content, resolve_engine(path or "", engine))))
            except (DocumentError, ValueError) as broken:
                if errors != "null":
                    raise DocumentError(f"{path}: {broken}") from None
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")


def read_documents(files: DataFrame, engine: str | None = None, errors: str = "raise") -> DataFrame:
    """``(path, json)`` of files given as ``(path, content)``, as the binaryFile source has them."""
    return files.select("path", decoder(engine, errors)("path", "content").alias("json"))


def typed(json_text: Column | str) -> Column:
    """JSON text as a VARIANT."""
    return F.parse_json(json_text)


def encoder(engine: str):
    """A Column function: JSON text to a document's bytes."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else encode(json.loads(x), engine) for x in texts.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")


def read_bytes(paths: DataFrame) -> DataFrame:
    """``(path, content)``; null content for what is no regular file."""
    from pyarrow import fs as pafs

    def run(column: pa.Array) -> pa.Array:
        out = []
        for path in column.to_pylist():
            store, inner = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
            if store.get_file_info(inner).type != pafs.FileType.File:
                out.append(None)
                continue
            with store.open_input_stream(inner) as file:
                out.append(file.read())
        return pa.array(out, pa.binary())

    return paths.select("path", F.arrow_udf(run, "binary").asNondeterministic()("path").alias("content"))


def file_facts(paths: DataFrame) -> DataFrame:
    """``(path, exists, is_file, is_dir, is_symlink, size)`` of local paths, each looked at where the task runs."""
    kind = pa.struct([(n, pa.bool_()) for n in ("exists", "is_file", "is_dir", "is_symlink")] + [("size", pa.int64())])

    def run(column: pa.Array) -> pa.Array:
        return pa.array([{"exists": os.path.exists(p), "is_file": os.path.isfile(p), "is_dir": os.path.isdir(p), "is_symlink": os.path.islink(p), "size": os.path.getsize(p) if os.path.exists(p) else None} for p in column.to_pylist()], kind)

    return paths.select("path", F.arrow_udf(run, "struct<exists: boolean, is_file: boolean, is_dir: boolean, is_symlink: boolean, size: bigint>").asNondeterministic()("path").alias("f")).select("path", "f.*")


def write_tree(documents: DataFrame) -> DataFrame:
    """As ``write_files``, making the folders that are missing."""
    return write_files(documents, folders=True)


def write_files(documents: DataFrame, folders: bool = False) -> DataFrame:
    """Write ``(path, content)`` rows to their paths; ``(path, size)`` of what was written. A repeated task writes the same again."""
    from pyarrow import fs as pafs

    def run(column: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for path, content in zip(column.to_pylist(), contents.to_pylist()):
            store, inner = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
            if folders:
                store.create_dir(os.path.dirname(inner), recursive=True)
            with store.open_output_stream(inner) as file:
                file.write(content or b"")
            out.append(len(content or b""))
        return pa.array(out, pa.int64())

    return documents.select("path", F.arrow_udf(run, "bigint").asNondeterministic()("path", "content").alias("size"))
