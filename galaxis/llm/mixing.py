"""Mixing sources to target weights by hierarchical budgeting.

Weights are propagated through a tree of domains, languages and sources. A node's budget is shared among its children by
weight, but a child gets no more than it can supply (its tokens, times the epochs allowed). What a child can't take goes
to its siblings; only what all children of a node together can't take is missing at the node itself, and so goes to the
node's own siblings. Each leaf then takes whole epochs of its documents, and of the last epoch the longest prefix within
its budget, in the order of a seeded hash.

All steps are DataFrame operations on integers. A prefix is found without sorting a leaf: tokens are summed by leaf and
leading hash digits, running sums over those find the one bucket in which the budget ends, and only that bucket's
documents are ordered, after those with equal hashes are summed. The number of digits follows from the number of rows, so
a leaf may hold any share of them, and null ids too.

Defined cases: null languages and sources are leaves of their own; null texts have 0 tokens. Rows with equal ids have
equal hashes and are taken or left together. A leaf without tokens gets no budget; its documents (no tokens each) are
left out unless an epoch of them costs nothing and the leaf has a budget. An empty table gives an empty result. Other
columns, of any name, stay as they are; the pipeline stage changes none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galaxis.llm._store import names_of, read, remove, saved

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("m_domain", "m_lang", "m_source")
#: Leading hash digits by which a leaf's tokens are summed, at least: 4096 buckets a leaf, or as many more as it takes for
#: a bucket of a leaf with all rows to have some BUCKET_ROWS of them.
DIGITS, BUCKET_ROWS = 3, 10_000


@dataclass(frozen=True)
class Mix:
    """share: the budget as a fraction (numerator, denominator) of the input's tokens. Weights are positive integers;
    names that are missing have weight 1. A domain is one of `domains`, five numbered sources each, or "other"."""

    share: tuple[int, int] = (1, 2)
    max_epochs: int = 3
    seed: int = 17
    domains: tuple[str, ...] = ("web", "reference", "code", "dialogue")
    per_domain: int = 5
    domain_weights: dict[str, int] = field(default_factory=lambda: {"web": 4, "reference": 3, "code": 2, "dialogue": 1})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 2})
    source_weights: dict[str, int] = field(default_factory=dict)

    def domain(self) -> Column:
        number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "^src([0-9]{1,6})$", 1)
        place = F.floor(number.cast("int") / self.per_domain).cast("int") + 1
        names = F.array(*map(F.lit, self.domains))
        return F.when((number != "") & (place <= len(self.domains)), F.try_element_at(names, place)).otherwise(F.lit("other"))


def _weight(weights: dict[str, int], name: str) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out.cast("long")


def with_leaves(docs: DataFrame, mix: Mix) -> DataFrame:
    return docs.withColumns({"m_domain": mix.domain(), "m_lang": F.coalesce("lang", F.lit("\u0000")), "m_source": F.coalesce("source", F.lit("\u0000"))})


def tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _share(children: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """children (parent..., name, w, cap, budget of the parent) with `got`: the parent's budget by weight, none above its
    cap. In the order of cap/w, a child is full if its own level, given to all after it, stays within the budget."""
    group = Window.partitionBy(*parent)
    upto = group.orderBy(F.col("cap") / F.col("w"), name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = children.withColumns({"all_w": F.sum("w").over(group), "cum_w": F.sum("w").over(upto), "cum_cap": F.sum("cap").over(upto)})
    out = out.withColumn("full", F.col("cum_cap") * F.col("w") + F.col("cap") * (F.col("all_w") - F.col("cum_w")) <= F.col(budget) * F.col("w"))
    out = out.withColumns({"full_w": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(group), "full_cap": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group)})
    rest = F.expr(f"(w * ({budget} - full_cap)) div (all_w - full_w)")
    return out.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(rest)).drop("all_w", "cum_w", "cum_cap", "full", "full_w", "full_cap")


def budgets(supply: DataFrame, mix: Mix) -> DataFrame:
    """supply (m_domain, m_lang, m_source, s: tokens) with `got`, the tokens that each leaf is to give."""
    leaves = supply.withColumns({"cap": F.col("s") * mix.max_epochs, "root": F.lit(0)})
    total = leaves.groupBy("root").agg((F.expr(f"sum(s) * {mix.share[0]} div {mix.share[1]}")).cast("long").alias("budget"))
    domains = leaves.groupBy("root", "m_domain").agg(F.sum("cap").alias("cap")).join(total, "root").withColumn("w", _weight(mix.domain_weights, "m_domain"))
    domains = _share(domains, ["root"], "m_domain", "budget").select("m_domain", F.col("got").alias("budget"))
    langs = leaves.groupBy("m_domain", "m_lang").agg(F.sum("cap").alias("cap")).join(domains, "m_domain").withColumn("w", _weight(mix.lang_weights, "m_lang"))
    langs = _share(langs, ["m_domain"], "m_lang", "budget").select("m_domain", "m_lang", F.col("got").alias("budget"))
    sources = leaves.drop("root").join(langs, ["m_domain", "m_lang"]).withColumn("w", _weight(mix.source_weights, "m_source"))
    return _share(sources, ["m_domain", "m_lang"], "m_source", "budget").select(*LEVELS, "s", "got")


def order_key(mix: Mix, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def plan(docs: DataFrame, mix: Mix) -> tuple[DataFrame, list[str]]:
    """For each leaf: m_full, the epochs it gives whole, and m_last, the largest hash that its next epoch gives; and the
    tables written on the way."""
    meta, place = saved(with_leaves(docs, mix).select("doc_id", *LEVELS, tokens().alias("n")), "mix")
    digits = max(DIGITS, math.ceil(math.log(max(1, meta.count() / BUCKET_ROWS), 16)))
    supply = meta.groupBy(*LEVELS).agg(F.sum("n").alias("s"))
    full = F.when(F.col("s") > 0, F.least(F.expr("got div s"), F.lit(mix.max_epochs).cast("long"))).otherwise(F.lit(0).cast("long"))
    leaves, leaf_place = saved(budgets(supply, mix).withColumn("m_full", full).withColumn("rest", F.col("got") - F.col("m_full") * F.col("s")).drop("s", "got"), "leaves")
    keyed = meta.join(leaves, list(LEVELS)).withColumn("h", order_key(mix, F.col("m_full") + 1)).withColumn("bucket", F.substring("h", 1, digits))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    sums = sums.withColumn("cum", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")))
    ends = sums.where("cum > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("cum") - F.col("n")).alias("base"))).alias("e")).select(*LEVELS, "e.*")
    inside = keyed.join(ends, [*LEVELS, "bucket"]).groupBy(*LEVELS, "bucket", "h").agg(F.sum("n").alias("n"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    inside = inside.withColumn("cum", F.col("base") + F.sum("n").over(Window.partitionBy(*LEVELS, "bucket").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    last = inside.where("cum <= rest").groupBy(*LEVELS).agg(F.max("h").alias("last"))
    cut = ends.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "bucket").alias("m_last"))
    # Without an end, the rest holds the leaf whole: every hash is below "g". Leaves without a budget give nothing.
    out, out_place = saved(leaves.join(cut, list(LEVELS), "left").select(*LEVELS, "m_full", F.when((F.col("rest") <= 0), F.lit("")).otherwise(F.coalesce("m_last", F.lit("g"))).alias("m_last")), "plan")
    remove(docs.sparkSession, place, leaf_place)
    return out, [out_place]


def taken(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows that the mix takes as a struct `doc`, their leaf, and m_epochs, how often each is taken."""
    rows = docs.select(F.struct(*names_of(docs)).alias("doc"), "doc_id", "lang", "source")
    leaves, _ = plan(docs.select("doc_id", "lang", "source", "text"), mix)
    rows = with_leaves(rows, mix).join(leaves, list(LEVELS))
    partly = F.when(order_key(mix, F.col("m_full") + 1) <= F.col("m_last"), 1).otherwise(0)
    return rows.select("doc", *LEVELS, (F.col("m_full") + partly).alias("m_epochs")).where("m_epochs > 0")


def mixed(docs: DataFrame, mix: Mix, epoch: str = "epoch") -> DataFrame:
    """The rows of docs that the mix takes, once for each epoch, with their leaf (m_...) and the number of the epoch from 1;
    columns of docs with these names are replaced."""
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m_epochs"))) if mix.max_epochs > 1 else F.lit(1).cast("long")
    rows = taken(docs, mix).select("doc", *LEVELS, each.alias("m_epoch"))
    own = [F.col(f"doc.{c}") for c in names_of(docs.drop(*LEVELS, epoch))]
    return rows.select(*own, *LEVELS, F.col("m_epoch").alias(epoch))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(read(spark, sf_dir, "documents"), Mix())
    return out.select("doc_id", F.col("m_domain").alias("domain"), "lang", "source", "epoch", tokens().alias("n_tokens"))


#: The pipeline keeps nine tenths of the tokens and takes no document twice.
PIPELINE = Mix(share=(9, 10), max_epochs=1)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of the mix, each once."""
    return taken(docs, PIPELINE).select("doc.*")


def _weights_sql(weights: dict[str, int], name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _share_sql(name: str, children: str, parent: str, key: str) -> str:
    """The same rule for a level: `children` has parent, key, w, cap, budget."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}_c AS (SELECT *, sum(w) OVER ({by}) AS all_w, sum(w) OVER u AS cum_w, sum(cap) OVER u AS cum_cap FROM ({children}) WINDOW u AS ({by} ORDER BY cap / w, {key} ROWS UNBOUNDED PRECEDING)),
{name}_f AS (SELECT *, cum_cap * w + cap * (all_w - cum_w) <= budget * w AS filled FROM {name}_c),
{name} AS (SELECT *, CASE WHEN filled THEN cap ELSE (w * (budget - coalesce(sum(cap) FILTER (WHERE filled) OVER ({by}), 0))) // nullif(all_w - coalesce(sum(w) FILTER (WHERE filled) OVER ({by}), 0), 0) END AS got FROM {name}_f)"""


def oracle(mix: Mix) -> str:
    """DuckDB SQL: the same budgets, and prefixes by one running sum over each leaf."""
    cases = " ".join(f"WHEN k = {i} THEN '{d}'" for i, d in enumerate(mix.domains))
    leaf = "domain, l, s"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, CASE {cases} ELSE 'other' END AS domain, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM (SELECT *, try_cast(regexp_extract(coalesce(source, ''), '^src([0-9]+)$', 1) AS INTEGER) // {mix.per_domain} AS k FROM documents)),
leaves AS (SELECT {leaf}, sum(n_tokens) AS sup, sum(n_tokens) * {mix.max_epochs} AS cap FROM d GROUP BY ALL),
{_share_sql("a", f"SELECT domain, sum(cap) AS cap, {_weights_sql(mix.domain_weights, 'domain')} AS w, (SELECT sum(sup) * {mix.share[0]} // {mix.share[1]} FROM leaves) AS budget FROM leaves GROUP BY domain", "", "domain")},
{_share_sql("b", f"SELECT domain, l, sum(leaves.cap) AS cap, {_weights_sql(mix.lang_weights, 'l')} AS w, any_value(a.got) AS budget FROM leaves JOIN a USING (domain) GROUP BY domain, l", "domain", "l")},
{_share_sql("c", f"SELECT domain, l, s, leaves.cap, sup, {_weights_sql(mix.source_weights, 's')} AS w, b.got AS budget FROM leaves JOIN b USING (domain, l)", "domain, l", "s")},
e AS (SELECT {leaf}, CASE WHEN sup > 0 THEN least(got // sup, {mix.max_epochs}) ELSE 0 END AS whole, got - CASE WHEN sup > 0 THEN least(got // sup, {mix.max_epochs}) ELSE 0 END * sup AS rest FROM c),
h AS (SELECT d.*, whole, rest, md5('{mix.seed}|' || (whole + 1)::BIGINT::VARCHAR || '|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM d JOIN e USING ({leaf})),
p AS (SELECT *, whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY h RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS m FROM h)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens FROM (SELECT *, unnest(range(1, m::BIGINT + 1)) AS epoch FROM p)
"""


ORACLE = oracle(Mix())
