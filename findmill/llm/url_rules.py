"""URL filtering by association rules.

Urls become sets of tokens (host labels, path parts, file suffix, query keys).  Spark's
FP-growth mines the token sets of labelled urls together with one item for the label; rules
that lead to the label item are kept if their support and confidence suffice and no shorter
rule inside them is as confident.  Every url is then judged by an inverted index from token
to rules: a rule fires when all its tokens have been counted.

Mining reads labelled rows only, about ``sample_rows`` of them at most (chosen by hash), so
the work of FP-growth is bounded; the urls judged are all rows.  Redundant rules are pruned on
Spark before any reach the driver; the index that is sent to the tasks holds all rules that are
left, whose number the support bounds and the data judged does not change.

Fixed rules ``(verdict, host, path)`` come first: the longest one that fits wins.

Defined results: a NULL url, or one without ``://``, has an empty host and path, fires no
rule and is allowed.  Labels that are NULL are not used; an id labelled twice counts twice.
No labels, or none of the wanted kind, give no rules.  Columns of the input are kept;
results are added under the names asked for.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from findmill.llm.tables import ascii_lower, durable

TARGET = "label:target"
_PARTS = re.compile(r"[^/?#]+")
_WORDS = re.compile(r"[A-Za-z]+")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest fitting rule, else NULL.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    name = verdict = None
    for what, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def tokens_of(url: str | None) -> list[str]:
    """The distinct tokens of a url: labels and words of the host, path parts, suffix, query keys."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return []
    host = _PARTS.match(rest)
    host = host.group() if host and not rest.startswith(("/", "?", "#")) else ""
    rest, _, fragment = rest[len(host):].partition("#")
    path, _, query = rest.partition("?")
    labels = host.lower().split(".")
    tokens = {f"host:{x}" for x in labels if x} | {f"word:{w}" for x in labels if "-" in x for w in _WORDS.findall(x)}
    parts = [p for p in path.split("/") if p]
    tokens |= {f"path:{p}" for p in parts if not p[0].isdigit()}
    tokens |= {f"suffix:{p.rpartition('.')[2]}" for p in parts[-1:] if "." in p}
    tokens |= {f"query:{q.partition('=')[0]}" for q in query.split("&") if q}
    if fragment:
        tokens.add("fragment")
    return sorted(tokens)


def url_tokens(url: Column) -> Column:
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            yield pa.array([tokens_of(u) for u in urls.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(tokens, "array<string>")(url)


def mine_rules(
    labelled: DataFrame, url: str, target: Column, key: Column, min_support: float = 0.005,
    min_confidence: float = 0.5, sample_rows: int = 200_000,
) -> list[tuple[tuple[str, ...], float, float]]:
    """``(tokens, confidence, support)`` of the rules that lead to ``target``, a condition on a row.

    ``key`` identifies a row, for the choice of the sample.
    """
    rows = labelled.select(F.col(url).alias("url"), target.alias("target"), key.alias("key")).where("target IS NOT NULL")
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int(sample_rows / n * (1 << 20))))
    baskets = rows.select(
        F.when(F.col("target"), F.array_append(url_tokens(F.col("url")), TARGET)).otherwise(url_tokens(F.col("url"))).alias("items")
    )
    if not n:
        return []
    # all confidences: whether a rule is redundant depends on those of its parts
    model = FPGrowth(minSupport=min_support, minConfidence=0.0).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == TARGET).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support"
    )
    kept = pruned(durable(rules, "url-rules")).where(F.col("confidence") >= min_confidence)
    return sorted(((tuple(r.tokens), r.confidence, r.support) for r in kept.collect()), key=lambda r: (len(r[0]), r[0]))


def pruned(rules: DataFrame) -> DataFrame:
    """Rules ``(tokens, confidence, support)`` without those that hold a shorter one of at least their confidence.

    The parts of a rule are rules too, so the best confidence of a rule's parts is the largest of its parts
    of one token less and of the best of theirs: one join a length.
    """
    best, kept = None, rules.where("false")
    for size in range(1, (rules.agg(F.max(F.size("tokens"))).first()[0] or 0) + 1):
        level = rules.where(F.size("tokens") == size)
        if best is None:
            level = level.withColumn("below", F.lit(-1.0))
        else:
            parts = level.select("tokens", F.explode("tokens").alias("t")).select("tokens", F.array_remove("tokens", F.col("t")).alias("part"))
            parts = parts.join(best, "part").groupBy("tokens").agg(F.max("best").alias("below"))
            level = level.join(parts, "tokens", "left").withColumn("below", F.coalesce("below", F.lit(-1.0)))
        kept = kept.unionByName(level.where("confidence > below").select("tokens", "confidence", "support"))
        best = durable(level.select(F.col("tokens").alias("part"), F.greatest("confidence", "below").alias("best")), "url-rules")
    return kept


class RuleIndex:
    """Inverted index from token to rules."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float, float]]):
        self.rules = rules
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for k, (tokens, _, _) in enumerate(rules):
            for token in tokens:
                self.by_token[token].append(k)

    def confidence(self, tokens: list[str]) -> float | None:
        """The confidence of the most confident rule that fires."""
        counted: dict[int, int] = defaultdict(int)
        best = None
        for token in tokens:
            for k in self.by_token.get(token, ()):
                counted[k] += 1
                if counted[k] == len(self.rules[k][0]) and (best is None or self.rules[k][1] > best):
                    best = self.rules[k][1]
        return best


def judge_urls(
    pages: DataFrame, rules: list[tuple[tuple[str, ...], float, float]], fixed: list[tuple[str, str, str]],
    url: str = "url", host: str = "host", path: str = "path", rule: str = "rule", verdict: str = "verdict",
    confidence: str = "confidence",
) -> DataFrame:
    """``pages`` with host, path, the fixed rule that fits, the verdict and the mined rules' confidence."""
    index = RuleIndex(rules)

    def fired(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            yield pa.array([index.confidence(tokens_of(u)) for u in urls.to_pylist()], pa.float64())

    pages = pages.withColumns({
        host: url_host(F.col(url)), path: url_path(F.col(url)),
        confidence: F.arrow_udf(fired, "double")(F.col(url)),
    })
    name, said = fixed_rule(F.col(host), F.col(path), fixed)
    mined = F.when(F.col(confidence).isNotNull(), "block").otherwise("allow")
    return pages.withColumns({rule: name, verdict: F.coalesce(said, mined)})
