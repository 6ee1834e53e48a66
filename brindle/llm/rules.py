"""Operator 7: quality rules as weak supervision.

Each rule looks at one surface property of a text and votes good (1), bad (-1) or abstains (0). Votes are counted by
pattern over all documents; expectation-maximisation over the pattern counts estimates the share of good documents and,
for every rule, how often it is right on good and on bad ones when it votes. A document's posterior probability of good
quality then weighs its votes by those accuracies, instead of demanding that all rules pass.

Everything that touches a text is a built-in expression, and comparisons are of whole numbers, so that any SQL engine
gives the same votes. Only pattern counts, at most 3 to the number of rules, reach the driver.

Defined results
  null text, or no word      no evidence: posterior 0, rejected; such rows don't enter the estimate
  all rules abstain          posterior is the estimated share of good documents
  no document                nothing is estimated, the result is empty
  posterior of just 0.5      kept
  repeated rows              each row votes and is judged by itself
  extra or clashing columns  carried along untouched
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.plans.scratch import materialize

ITERATIONS, MIN_POSTERIOR = 30, 0.5
#: Where estimation starts: share of good documents, accuracy on good ones, accuracy on bad ones; and pseudo-counts.
START, PRIOR_WEIGHT = (0.8, 0.95, 0.5), 2.0
STOP_WORDS = (
    "the of and to in is that for with was as it be by this from are der die und den von zu mit das ist nicht ein eine auf für "
    "le la les de des du et en un une est que qui dans pour sur el los las y del se por con una para al au"
).split()
SYMBOLS = "#$%&*@^~|<>{}[]=+_/"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Counts that rules look at. {text} is the text; both dialects have length, replace and translate.
_COMMON = {
    "chars": "length({text})",
    "letters": "length(translate({text}, {blanks}, ''))",
    "symbols": f"(length({{text}}) - length(translate({{text}}, '{SYMBOLS}', '')))",
    "capitals": f"(length({{text}}) - length(translate({{text}}, '{CAPITALS}', '')))",
    "shouts": "(length({text}) - length(replace({text}, '!', '')))",
    "stops": "(length({text}) - length(translate({text}, '.?!', '')))",
}
_SPARK = {
    "words": "array_remove(split(translate({text}, '\\n\\t\\r', '   '), ' '), '')",
    "lines": "array_remove(split({text}, '\\n'), '')",
    "n": "size(words)", "kinds": "size(array_distinct(words))", "n_lines": "size(lines)", "line_kinds": "size(array_distinct(lines))",
    "common": "size(filter(words, w -> lower(w) IN ({stop_words})))",
}
_DUCK = {
    "words": "list_filter(string_split(translate({text}, chr(10) || chr(9) || chr(13), '   '), ' '), lambda w: w <> '')",
    "lines": "list_filter(string_split({text}, chr(10)), lambda w: w <> '')",
    "n": "len(words)", "kinds": "len(list_distinct(words))", "n_lines": "len(lines)", "line_kinds": "len(list_distinct(lines))",
    "common": "len(list_filter(words, lambda w: lower(w) IN ({stop_words})))",
}
#: Votes in terms of the counts: (name, bad if, good if). Bad wins over good.
RULES = (
    ("symbols", "100 * symbols > 3 * chars", "100 * symbols < chars"),
    ("capitals", "100 * capitals > 30 * chars", "100 * capitals < 12 * chars"),
    ("variety", "n >= 50 AND kinds * kinds < 36 * n", "n >= 50 AND kinds * kinds > 49 * n"),
    ("lines", "n_lines >= 4 AND 10 * line_kinds < 7 * n_lines", "n_lines >= 4 AND 10 * line_kinds >= 9 * n_lines"),
    ("shouting", "10 * shouts > n", "50 * shouts <= n AND n >= 5"),
    ("stop_words", "n >= 20 AND 100 * common < 3 * n", "n >= 20 AND 100 * common > 8 * n"),
    ("sentences", "n >= 30 AND 200 * stops < n", "n >= 10 AND 50 * stops >= n AND 4 * stops <= n"),
    ("word_length", "letters > 20 * n OR letters < 2 * n", "letters >= 3 * n AND letters <= 10 * n"),
)


def _counts(parts: dict[str, str], text: str, blanks: str) -> dict[str, str]:
    stop_words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    named = {"{text}": text, "{blanks}": blanks, "{stop_words}": stop_words}
    return {k: functools.reduce(lambda e, n: e.replace(n, named[n]), named, v) for k, v in parts.items()}


def votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``__row`` (the whole input row), ``__n`` words, and one vote column for each rule."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    d = docs.select(row, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    common = _counts(_COMMON, "text", "' \\n\\t\\r'")
    spark = _counts(_SPARK, "text", "")
    d = d.select("__row", *(F.expr(e).alias(k) for k, e in common.items()), *(F.expr(spark[k]).alias(k) for k in ("words", "lines")))
    d = d.select("__row", *common, *(F.expr(e).alias(k) for k, e in spark.items() if k not in ("words", "lines")))
    return d.select("__row", F.col("n").alias("__n"), *(F.expr(f"CAST(CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS INT)").alias(f"v_{name}") for name, bad, good in RULES))


class Accuracies:
    """The estimate: share of good documents, and each rule's accuracy on good and on bad ones."""

    def __init__(self, share: float, on_good: np.ndarray, on_bad: np.ndarray):
        self.share, self.on_good, self.on_bad = share, on_good, on_bad

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-odds of the share, and what a good and a bad vote of each rule add."""
        return math.log(self.share / (1 - self.share)), np.log(self.on_good / (1 - self.on_bad)), np.log((1 - self.on_good) / self.on_bad)


def estimate(patterns: np.ndarray, counts: np.ndarray, iterations: int = ITERATIONS) -> Accuracies:
    """Expectation-maximisation over vote patterns (one row each) and how many documents have them."""
    share, good, bad = START
    a = Accuracies(share, np.full(patterns.shape[1], good), np.full(patterns.shape[1], bad))
    up, down = (patterns == 1).astype(float), (patterns == -1).astype(float)
    for _ in range(iterations):
        base, plus, minus = a.weights()
        p = 1 / (1 + np.exp(-(base + up @ plus + down @ minus)))
        g, b = counts * p, counts * (1 - p)
        a = Accuracies(
            (g.sum() + PRIOR_WEIGHT * START[0]) / (counts.sum() + PRIOR_WEIGHT),
            (g @ up + PRIOR_WEIGHT * START[1]) / (g @ (up + down) + PRIOR_WEIGHT),
            (b @ down + PRIOR_WEIGHT * START[2]) / (b @ (up + down) + PRIOR_WEIGHT),
        )
    return a


def learn(voted: DataFrame) -> Accuracies:
    """Estimate from the votes on all documents; rows come from ``votes``."""
    names = [f"v_{r[0]}" for r in RULES]
    rows = voted.where("__n > 0").groupBy(*names).count().orderBy(*names).collect()
    found = np.array([list(r) for r in rows], float).reshape(-1, len(names) + 1)
    return estimate(found[:, :-1], found[:, -1])


def posterior(a: Accuracies) -> Column:
    """Probability of good quality from the vote columns."""
    base, plus, minus = a.weights()
    z = F.lit(float(base))
    for (name, _, _), p, m in zip(RULES, plus, minus):
        z = z + F.when(F.col(f"v_{name}") == 1, float(p)).when(F.col(f"v_{name}") == -1, float(m)).otherwise(0.0)
    return F.when(F.col("__n") > 0, 1 / (1 + F.exp(-z))).otherwise(0.0)


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``__row`` and ``posterior`` for every row of the input; rows are written with their votes, so that each text is looked at once."""
    voted = materialize(votes(docs, text_col), "voted")
    return voted.select("__row", F.round(posterior(learn(voted)), 6).alias("posterior"))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents whose posterior reaches MIN_POSTERIOR; columns unchanged."""
    return judge(docs, text_col).where(F.col("posterior") >= MIN_POSTERIOR).select("__row.*")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, posterior)`` of the documents that stay."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the votes are a few numbers a document: written, so that texts are read once
    voted = materialize(votes(slim).select("__row.doc_id", "__n", *(f"v_{r[0]}" for r in RULES)), "votes")
    return voted.select("doc_id", F.round(posterior(learn(voted)), 6).alias("posterior")).where(F.col("posterior") >= MIN_POSTERIOR)


def sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL, the iterations written out one after the other."""
    text = "coalesce(text, '')"
    common, duck = _counts(_COMMON, text, "' ' || chr(10) || chr(9) || chr(13)"), _counts(_DUCK, text, "")
    names = [r[0] for r in RULES]
    steps = [
        f"c AS (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in common.items())}, {', '.join(f'{duck[k]} AS {k}' for k in ('words', 'lines'))} FROM {table})",
        f"d AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in duck.items() if k not in ('words', 'lines'))} FROM c)",
        f"v AS MATERIALIZED (SELECT doc_id, n, {', '.join(f'CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{k}' for k, bad, good in RULES)} FROM d)",
        f"p AS MATERIALIZED (SELECT {', '.join(f'v_{k}' for k in names)}, count(*)::DOUBLE AS docs FROM v WHERE n > 0 GROUP BY ALL)",
        f"a0 AS (SELECT {START[0]}::DOUBLE AS share, {', '.join(f'{START[1]}::DOUBLE AS g_{k}, {START[2]}::DOUBLE AS b_{k}' for k in names)})",
    ]
    z = "ln(share / (1 - share)) + " + " + ".join(f"CASE v_{k} WHEN 1 THEN ln(g_{k} / (1 - b_{k})) WHEN -1 THEN ln((1 - g_{k}) / b_{k}) ELSE 0 END" for k in names)
    w = PRIOR_WEIGHT
    for i in range(ITERATIONS):
        rates = ", ".join(
            f"(coalesce(sum(docs * q) FILTER (v_{k} = 1), 0) + {w * START[1]}) / (coalesce(sum(docs * q) FILTER (v_{k} <> 0), 0) + {w}) AS g_{k}, "
            f"(coalesce(sum(docs * (1 - q)) FILTER (v_{k} = -1), 0) + {w * START[2]}) / (coalesce(sum(docs * (1 - q)) FILTER (v_{k} <> 0), 0) + {w}) AS b_{k}"
            for k in names
        )
        steps.append(f"a{i + 1} AS MATERIALIZED (SELECT (sum(docs * q) + {w * START[0]}) / (sum(docs) + {w}) AS share, {rates} FROM (SELECT p.*, 1 / (1 + exp(-({z}))) AS q FROM p, a{i}))")
    steps.append(f"r AS (SELECT doc_id, round(CASE WHEN n > 0 THEN 1 / (1 + exp(-({z}))) ELSE 0.0 END, 6) AS posterior FROM v, a{ITERATIONS})")
    return f"WITH {', '.join(steps)} SELECT doc_id, posterior FROM r WHERE posterior >= {MIN_POSTERIOR}"
