"""Operator 10: main text of web pages by the consensus of each host's pages.

Each page scores its containers: text of paragraphs counts for the container that holds them and half for the one
above, less what lies in links, with a factor for tags and class names that speak for or against. Containers are known
by generalised paths of tags and classes, digits and generated names left out, so that pages made from one template
agree. Every page votes for its best path; a host's winning paths are those with at least MIN_SHARE of its votes.
Then each page is extracted again from the first winning path that it has.

Plan: two Arrow passes over the pages. Between them votes are summed by host and path, combined before the shuffle; what
meets the pages in the second pass is at most 1 / MIN_SHARE paths a host, broadcast where that table is small and joined by
a shuffle on host where it isn't. A hot host's pages are then split over tasks by adaptive execution, since nothing
comes between that join and the result, and only a row of paths has to be read by each of them.

Defined results
  null or empty html         empty text, null path, no vote
  no tags                    the whole text, path ``body``
  long attribute values      read whole, whatever their length; a > in them doesn't end the tag
  null or broken url         such pages don't vote; each is extracted by its own best path
  ties                       of paths with equal scores or votes the one first in the alphabet
  no winning path in a page  the page's own best path
  repeated rows              each votes and is extracted
  no page                    no row
  extra or clashing columns  not read
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import bytewords as bw
from brindle.plans.scratch import materialize

MIN_SHARE, MIN_PARAGRAPH = 0.2, 20
_OPAQUE = r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
#: A quote opens a value after a = only, and a value without a closing quote ends at a blank.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
TOKEN, LOOSE = (re.compile(rf"{_OPAQUE}|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({inner})(>|\Z)", re.S | re.I) for inner in (_ATTRIBUTES, "[^>]*+"))
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
CONTAINERS = frozenset("body div article section main td aside header footer nav form blockquote ul ol dl table figure center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li pre tr th dt dd hr address figcaption fieldset option caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open element of these, above the nearest container.
CLOSES = {**dict.fromkeys(BLOCKS, ("p",)), "li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}
SCOPE = frozenset("body div article section main aside header footer nav form blockquote table figure ul ol dl center".split())
AGAINST = re.compile(r"(?:^|[-_.])(?:ad|ads|advert|banner|nav|menu|foot|footer|head|header|side|sidebar|comment|comments|promo|share|social|related|cookie|breadcrumb|widget|popup)(?:$|[-_.])")
FACTOR = {"article": 1.5, "main": 1.5, "nav": 0.1, "footer": 0.1, "aside": 0.1, "header": 0.2, "form": 0.3, "ul": 0.6, "ol": 0.6, "table": 0.6}
PAGE_TYPE = "struct<path: string, text: string>"


def _segment(tag: str, attributes: str) -> str:
    found = CLASS.search(attributes) if "class" in attributes or "CLASS" in attributes else None
    if not found:
        return tag
    names = {re.sub(r"\d+", "#", x) for x in (found[1] or found[2] or found[3] or "").lower().split()}
    # a name with two or more separate numbers is taken for a generated one
    return ".".join([tag, *sorted(x for x in names if x.count("#") < 2)])


def _tokens(html: str) -> Iterator[re.Match]:
    """Tags and what is left out, each character met a fixed number of times; from a tag without an end on, tags end at their first >."""
    pattern, at = TOKEN, 0
    while m := pattern.search(html, at):
        if m[3] is None or m[5]:
            yield m
            at = m.end()
        elif pattern is TOKEN:
            pattern, at = LOOSE, m.start()
        else:
            return


def elements(html: str) -> tuple[list[str], list[tuple[int, int, bool, str]]]:
    """Container elements as (path of each, and its parent's number), and the runs of text: (container, block, in a link, text)."""
    paths, texts = [("body", -1)], []
    stack: list[tuple[str, int]] = []  # open elements: tag, number of the container that surrounds them
    here, block, links, at = 0, 0, 0, 0
    for m in _tokens(html):
        if m.start() > at:
            texts.append((here, block, links > 0, html[at : m.start()]))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS or tag == "br":
            block += 1
        if tag in VOID or tag in ("html", "body"):
            continue
        if m[2]:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag:
                k -= 1
            down = k if k >= 0 else None
        else:
            down = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SCOPE:
                    break
                if stack[k][0] in CLOSES.get(tag, ()):
                    down = k
        if down is not None:
            here = stack[down][1]
            for name, _ in stack[down:]:
                links -= name == "a"
            del stack[down:]
        if not m[2] and not m[4].endswith("/"):
            stack.append((tag, here))
            links += tag == "a"
            if tag in CONTAINERS:
                paths.append((f"{paths[here][0]}>{_segment(tag, m[4])}", here))
                here = len(paths) - 1
    if at < len(html):
        texts.append((here, block, links > 0, html[at:]))
    return paths, texts


def _paragraphs(texts) -> Iterator[tuple[int, int, int, str]]:
    """Text of each block: (container, length, length in links, text)."""
    run: list[str] = []
    owner = number = None
    inside = 0
    for where, block, link, text in [*texts, (None, None, False, "")]:
        if (where, block) != (owner, number):
            if run and (whole := " ".join(entities.unescape("".join(run)).split())):
                yield owner, len(whole), min(inside, len(whole)), whole
            run, inside, owner, number = [], 0, where, block
        run.append(text)
        inside += len(text) if link else 0


def scores(paths, paragraphs) -> dict[str, float]:
    """Score of every path that holds text."""
    out: dict[str, float] = {}
    for where, length, inside, _ in paragraphs:
        worth = (length - inside) * (1.0 if length >= MIN_PARAGRAPH else 0.2)
        for part in paths[where][0].split(">"):
            worth *= min(1.0, _factor(part))
        for share in (1.0, 0.5):
            path, above = paths[where]
            out[path] = out.get(path, 0.0) + share * worth
            if above < 0:
                break
            where = above
    return {p: s * max(1.0, _factor(p.rpartition(">")[2])) for p, s in out.items()}


def _factor(part: str) -> float:
    """What a path's component speaks for (above 1) or against."""
    tag, _, names = part.partition(".")
    return FACTOR.get(tag, 1.0) * (0.1 if names and AGAINST.search(names) else 1.0)


def best(found: dict[str, float]) -> str | None:
    return min(found, key=lambda p: (-found[p], p)) if found else None


def extract(html: str, winners: list[str] | None) -> tuple[str | None, str]:
    """(path, text) of a page by the first of the host's winning paths that it has, else by its own best one."""
    paths, texts = elements(html)
    paragraphs = list(_paragraphs(texts))
    inside: dict[str, list[str]] = {}
    chosen = None
    own = {p for p, _ in paths}
    for path in [*(winners or ()), None]:
        chosen = best(scores(paths, paragraphs)) if path is None else path
        if chosen in own:
            held = _within(paths, chosen)
            inside = [text for where, _, _, text in paragraphs if held[where]]
            if inside:
                return chosen, "\n".join(inside)
    return None, ""


def _within(paths, chosen: str) -> list[bool]:
    """Which containers belong to the chosen path: its own, and those in them but for navigation and the like."""
    held: list[bool] = []
    for path, above in paths:
        held.append(path == chosen or (above >= 0 and held[above] and _factor(path.rpartition(">")[2]) > 0.2))
    return held


def host(url_col: str) -> F.Column:
    return F.lower(F.try_parse_url(F.col(url_col).cast("string"), F.lit("HOST")))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path, votes, score)``: how many of the host's pages chose the path, and their scores for it."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for part in bw.row_slices(column):
            for html in part.to_pylist():
                paths, texts = elements(html or "")
                found = scores(paths, _paragraphs(texts))
                path = best(found)
                out.append(None if path is None else {"path": path, "score": found[path]})
        return pa.array(out, pa.struct([("path", pa.string()), ("score", pa.float64())]))

    chosen = pages.select(host(url_col).alias("host"), F.arrow_udf(run, "struct<path: string, score: double>").asNondeterministic()(F.col(html_col).cast("string")).alias("v"))
    chosen = chosen.where("host IS NOT NULL AND v IS NOT NULL")
    return chosen.groupBy("host", F.col("v.path").alias("path")).agg(F.count("*").alias("votes"), F.round(F.sum("v.score"), 3).alias("score"))


def winning_paths(counted: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``(host, paths)``: each host's winning paths, most votes first."""
    all_votes = counted.groupBy("host").agg(F.sum("votes").alias("all"))
    ranked = counted.join(all_votes, "host").where(F.col("votes") / F.col("all") >= min_share).groupBy("host").agg(F.sort_array(F.collect_list(F.struct(-F.col("votes"), -F.col("score"), F.col("path").alias("path")))).alias("r"))
    return ranked.select("host", F.col("r.path").alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_share: float = MIN_SHARE) -> DataFrame:
    """``(page_id, host, path, text)`` of every page."""
    winners = materialize(winning_paths(materialize(votes(pages, url_col, html_col), "votes"), min_share), "winners")

    def run(column: pa.Array, chosen: pa.Array) -> pa.Array:
        out, at = [], 0
        for part in bw.row_slices(column):
            for html, paths in zip(part.to_pylist(), chosen.slice(at, len(part)).to_pylist()):
                path, text = extract(html or "", paths)
                out.append({"path": path, "text": text})
            at += len(part)
        return pa.array(out, pa.struct([("path", pa.string()), ("text", pa.string())]))

    rows = pages.select(F.col(id_col).alias("page_id"), host(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).join(winners, "host", "left")
    return rows.select("page_id", "host", F.arrow_udf(run, PAGE_TYPE).asNondeterministic()("html", "paths").alias("x")).select("page_id", "host", "x.path", "x.text")
