"""URL filtering by a rule list and by mined association rules.

A list of rules (host and start of a path) decides first: a rule fits its host and all subdomains, and the longest that
fits wins. Labels are the list's verdicts, and for URLs that it leaves open the labels of a table. From these Spark's
FP-growth mines combinations of URL tokens; the ones are kept that reach a support and a confidence and that contain no
shorter kept combination. They judge the URLs that the list leaves open, through an inverted index from tokens to rules: a
URL is blocked if some rule for "block" has all its tokens among the URL's.

FP-growth makes all subsets of what is frequent, so it gets no more than it needs: not the tokens that are rare among the
URLs of a label, nor those that are rules by themselves; and tokens that always occur together, as the names of a template
do, go in as one and may stand for each other in a rule. Rules have `most_tokens` tokens at most, which bounds the model.

Defined cases: a null url, or one without "://", has an empty host and path, no tokens and the verdict "allow"; repeated
rows are judged one by one; without labelled URLs, or with labels of one kind, there may be no rules: then what the list
leaves open is allowed. Mining counts all labelled URLs and judging covers every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galaxis.llm._store import read, remove, saved

#: Host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, SMALL), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the list, null where none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def named(name: str) -> str:
    """A name of more than 64 characters as its start and a hash of all of it; hosts, paths and keys have no # of their own."""
    return name if len(name) <= 64 else f"{name[:64]}#{xxhash.xxh3_128_hexdigest(name.encode('utf-8', 'surrogatepass'))}"


def tokens(url: str | None, host: str, path: str) -> list[str]:
    """The tokens of a URL: scheme, all labels and the last two of its host, all names of its path with numbers as N, a
    file's ending, and all keys of its query."""
    if not host:
        return []
    labels = [x for x in host.split(".") if x]
    out = ["scheme:" + named(url[: url.index("://")].lower())] + [f"host:{named(x)}" for x in labels] + ["site:" + named(".".join(labels[-2:]))]
    names = [x for x in path.split("/") if x]
    out += [f"path:{named(re.sub('[0-9]+', 'N', x.lower()))}" for x in names]
    if names and "." in names[-1]:
        out.append("ending:" + named(names[-1].rpartition(".")[2].lower()))
    query = url.partition("?")[2].partition("#")[0]
    out += [f"key:{named(x.partition('=')[0])}" for x in query.split("&") if x]
    return sorted(set(out))


def with_tokens(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls (with host and path) and `tokens`."""
    schema = T.StructType([*urls.schema, T.StructField("tokens", T.ArrayType(T.StringType()))])
    at = [urls.columns.index(c) for c in (url, "host", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [tokens(*x) for x in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.string()))], names=schema.names)

    return urls.mapInArrow(run, schema)


@dataclass(frozen=True)
class Mining:
    """support: the least share of labelled URLs that a combination with its label has; confidence: of the URLs with the
    combination, the least share with the label; least_rows: the least number of URLs that a rule rests on. Support
    and most_tokens bound the model; of what reaches them nothing is cut off."""

    least_rows: int = 20
    support: float = 0.002
    confidence: float = 0.9
    most_tokens: int = 3


@dataclass(frozen=True)
class Rule:
    """also: for each token, itself and those that may stand for it."""

    tokens: tuple[str, ...]
    label: str
    confidence: float
    support: float
    also: tuple[tuple[str, ...], ...] = ()

    def choices(self) -> tuple[tuple[str, ...], ...]:
        return self.also or tuple((x,) for x in self.tokens)


ITEMS = T.StructType([T.StructField("items", T.ArrayType(T.IntegerType()))])
#: The item of a row that has the label.
LABEL = -1


def _items(label: str, number: dict[str, int]):
    """Transactions of rows (tokens, label) with two or more of the numbered tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for names, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = {number[x] for x in names if x in number}
                if len(have) > 1:
                    rows.append([*sorted(have), LABEL] if own == label else sorted(have))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=ITEMS.names)

    return run


def _combined(rows: DataFrame, label: str, number: dict[str, int], least: int, mining: Mining) -> list[tuple[tuple[int, ...], int, int]]:
    """Combinations of two numbered tokens or more that reach the support and the confidence, with the rows that have them:
    all, and those with the label."""
    from pyspark.ml.fpm import FPGrowth

    spark = rows.sparkSession
    items, place = saved(rows.select("tokens", "label").mapInArrow(_items(label, number), ITEMS), "items")
    n = items.count()
    if n < least:
        remove(spark, place)
        return []
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(items)
    of_label = F.array_contains("items", LABEL)
    tokens = F.array_sort(F.array_remove("items", LABEL)).alias("tokens")
    sets = model.freqItemsets.select(tokens, of_label.alias("own"), "freq").where(F.size("tokens").between(2, mining.most_tokens))
    sets, sets_place = saved(sets, "itemsets")
    hits = sets.where("own").select("tokens", F.col("freq").alias("hits"))
    found = sets.where("NOT own").select("tokens", F.col("freq").alias("total")).join(hits, "tokens").where(F.col("hits") / F.col("total") >= mining.confidence).collect()
    remove(spark, place, sets_place)
    return [(tuple(r.tokens), r.total, r.hits) for r in found]


def mine(labelled: DataFrame, mining: Mining | None = None, only: str | None = None) -> list[Rule]:
    """labelled: tokens and label. Rules (for one label only) without a kept subset for the same label, in a fixed order.
    All rows count; what the driver holds are tokens that reach the support, and rules."""
    mining = mining or Mining()
    rows = labelled.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).select(F.array_distinct("tokens").alias("tokens"), "label")
    rows, place = saved(rows.withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "labelled")
    by_label = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(by_label.values())
    kept: list[Rule] = []
    if n and n >= mining.least_rows:
        least = max(1, mining.least_rows, ceil(mining.support * n))
        for label in sorted(by_label) if only is None else [only]:
            kept += _mined(rows, label, n, least, mining)
    remove(labelled.sparkSession, place)
    kept.sort(key=lambda r: (len(r.tokens), -r.support, r.tokens, r.label))
    return kept


def _mined(rows: DataFrame, label: str, n: int, least: int, mining: Mining) -> list[Rule]:
    """Rules for a label from rows (tokens, label, row: a number of its own)."""
    own = F.col("label") == label
    single = rows.select(F.explode("tokens").alias("token"), "row", F.when(own, 1).otherwise(0).alias("hit"))
    single = single.groupBy("token").agg(F.count("*").alias("total"), F.sum("hit").alias("hits"), F.bit_xor("row").alias("where1"), F.bit_xor(F.xxhash64("row")).alias("where2"))
    kept: list[Rule] = []
    alike: dict[tuple, list[str]] = {}
    for r in sorted(single.where(F.col("hits") >= least).collect(), key=lambda r: r.token):
        if r.hits / r.total >= mining.confidence:
            kept.append(Rule((r.token,), label, r.hits / r.total, r.hits / n))
        else:
            alike.setdefault((r.total, r.hits, r.where1, r.where2), []).append(r.token)
    groups = list(alike.values())
    if len(groups) < 2 or mining.most_tokens < 2:
        return kept
    number = {x: i for i, group in enumerate(groups) for x in group}
    have: set[tuple[int, ...]] = set()
    for c, total, hits in sorted(_combined(rows, label, number, least, mining), key=lambda x: (len(x[0]), x[0])):
        if not any(x in have for k in range(2, len(c)) for x in combinations(c, k)):
            have.add(c)
            also = sorted((tuple(groups[i]) for i in c), key=lambda x: x[0])
            kept.append(Rule(tuple(x[0] for x in also), label, hits / total, hits / n, tuple(also)))
    return kept


class Index:
    """Rules by token: a URL's tokens count up the places of the rules that have them, and a rule fits once it is full."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.lists: dict[str, list[tuple[int, int]]] = {}
        for i, rule in enumerate(rules):
            for place, choice in enumerate(rule.choices()):
                for token in choice:
                    self.lists.setdefault(token, []).append((i, place))

    def fits(self, names: list[str]) -> list[Rule]:
        full: dict[int, set[int]] = {}
        for token in names:
            for i, place in self.lists.get(token, ()):
                full.setdefault(i, set()).add(place)
        return [self.rules[i] for i in sorted(full) if len(full[i]) == len(self.rules[i].tokens)]


JUDGED = [T.StructField("mined_rule", T.StringType()), T.StructField("mined_confidence", T.DoubleType()), T.StructField("mined_verdict", T.StringType())]


def judge(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """urls (with tokens) and the surest rule for "block" that fits, its confidence, and the verdict."""
    index = Index([r for r in rules if r.label == "block"])
    schema = T.StructType([*urls.schema, *JUDGED])
    at = urls.columns.index("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [max(index.fits(x or []), key=lambda r: r.confidence, default=None) for x in batch.column(at).to_pylist()]
            made = [pa.array([r and " & ".join(r.tokens) for r in best], pa.string()), pa.array([r and r.confidence for r in best], pa.float64()), pa.array(["block" if r else "allow" for r in best], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return urls.mapInArrow(run, schema)


def verdicts(labels: DataFrame) -> DataFrame:
    """(page_id, label) of rows (doc_id, quality, toxic): "block" if any of an id's rows is toxic or of low quality."""
    bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.when(F.max(bad), "block").otherwise("allow").alias("label"))


def filtered(pages: DataFrame, labels: DataFrame | None = None, rules: tuple = RULES, mining: Mining | None = None) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict and what the mined rules say. labels: (page_id, label)."""
    host, path = host_path()
    urls = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    urls = with_tokens(urls.withColumns({"rule": rule, "listed": verdict}))
    known = urls.withColumn("label", F.col("listed"))
    if labels is not None:
        known = urls.join(labels, "page_id", "left").withColumn("label", F.coalesce("listed", "label"))
    return judge(urls, mine(known, mining, only="block")).withColumn("verdict", F.coalesce("listed", "mined_verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filtered(read(spark, sf_dir, "pages"), verdicts(read(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")
