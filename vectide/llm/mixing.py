"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves are (domain, language, source). A token budget goes down the tree by weight; a node takes at most what its
leaves supply times ``max_epochs``. What a full node cannot take goes to its siblings by weight, and leaves the
parent only when the parent is full: that is water-filling, done level by level in closed form over cumulative sums.

A leaf's quota is whole epochs plus a token prefix of one more epoch, whose order is a hash of (seed, epoch,
doc_id). The place where the prefix ends is found by radix descent: sums of 256 hash ranges of a leaf, then of the 256 ranges
inside the one that holds the end, then the documents of that one; each level is a map-side combined aggregate, so a
leaf with a third of all rows is never sorted by one task. The result is one row for each leaf, and one more pass
over the documents applies it without moving a text.

Defined results: a null language or source is the leaf "unknown"; null texts have no tokens; tokens are runs without
white space (space, \\t-\\r); documents of a leaf that share a doc_id are taken or left together; a document without
tokens goes with its place in the order; texts of any length are counted whole; an empty table gives no rows; the
mixed documents keep all columns of the input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import as_row, discard, save, save_narrow, small, table

#: Domain of a source by the number at its end, modulo four; "other" without a number.
DOMAINS = ("web", "books", "forums", "reference")
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "forums": 10, "reference": 20}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
#: Weight of a domain or language that has none, and of every source.
OTHER_WEIGHT, SOURCE_WEIGHT = 5, 1
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.8, 2, 17
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number == "", "other").otherwise(F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.right(number, F.lit(6)).cast("int") % len(DOMAINS)) + 1))


def with_leaf(docs: DataFrame) -> DataFrame:
    """``docs`` with __domain, __lang, __source and __n (tokens)."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    return docs.withColumns({
        "__domain": domain_of(source), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "__source": source,
        "__n": F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"),
    })


def _weight(column: str, weights: dict[str, int], other: int) -> Column:
    if any(w <= 0 for w in (*weights.values(), other)):
        raise ValueError("weights have to be positive integers")
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def water_fill(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """``children`` (parent columns, key, weight, capacity, budget of the parent) with ``granted``, a double.

    Shares of the budget are in proportion to weight, except that no child gets more than its capacity.
    """
    part = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upto = part.orderBy("ratio", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = children.withColumn("ratio", F.col("capacity").cast("double") / F.col("weight").cast("double")).withColumns({
        "cum_c": F.sum("capacity").over(upto), "cum_w": F.sum("weight").over(upto), "all_w": F.sum("weight").over(part)})
    full = ranked.withColumn("is_full", F.col("cum_c").cast("double") + F.col("ratio") * (F.col("all_w") - F.col("cum_w")).cast("double") <= F.col("budget"))
    level = full.withColumns({
        "full_c": F.coalesce(F.max(F.when(F.col("is_full"), F.col("cum_c"))).over(part), F.lit(0)),
        "full_w": F.coalesce(F.max(F.when(F.col("is_full"), F.col("cum_w"))).over(part), F.lit(0)),
    })
    share = (F.col("budget") - F.col("full_c").cast("double")) * F.col("weight").cast("double") / (F.col("all_w") - F.col("full_w")).cast("double")
    return level.withColumn("granted", F.when(F.col("is_full"), F.col("capacity").cast("double")).otherwise(F.least(share, F.col("capacity").cast("double")))).drop("ratio", "cum_c", "cum_w", "all_w", "is_full", "full_c", "full_w", "budget")


def quotas(leaves: DataFrame, budget_share: float, max_epochs: int, domain_weights: dict, lang_weights: dict, source_weight: int = SOURCE_WEIGHT) -> DataFrame:
    """leaves (domain, lang, source, supply) -> those with quota, full_epochs, rest."""
    cap = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    total = cap.agg(F.floor(F.sum("supply").cast("double") * F.lit(float(budget_share))).cast("double").alias("budget"))
    domains = cap.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight("domain", domain_weights, OTHER_WEIGHT))
    domains = water_fill(domains.join(F.broadcast(total)), [], "domain").select("domain", F.col("granted").alias("budget"))
    langs = cap.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight("lang", lang_weights, OTHER_WEIGHT))
    langs = water_fill(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("granted").alias("budget"))
    out = water_fill(cap.withColumn("weight", F.lit(source_weight).cast("long")).join(langs, ["domain", "lang"]), ["domain", "lang"], "source")
    # whole tokens: floors, then one token each by largest remainder until the granted sum is used
    out = save_narrow(out.withColumns({"whole": F.floor(F.col("granted") + 1e-6).cast("long"), "part": F.round(F.col("granted") - F.floor(F.col("granted") + 1e-6), 6)}), "mix-granted")
    left = out.agg(F.coalesce((F.round(F.sum("granted"), 3) + 1e-6).cast("long") - F.sum("whole"), F.lit(0))).first()[0]
    one_more = out.where(F.col("whole") < F.col("capacity")).orderBy(F.desc("part"), *LEAF).limit(max(0, left)).select(*LEAF, F.lit(1).alias("more"))
    out = out.join(one_more, LEAF, "left").withColumn("quota", F.col("whole") + F.coalesce(F.col("more"), F.lit(0)))
    full = F.when(F.col("supply") > 0, F.floor(F.col("quota") / F.col("supply")).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("full_epochs", full).withColumn("rest", F.col("quota") - F.col("full_epochs") * F.col("supply")).select(*LEAF, "supply", "capacity", "quota", "full_epochs", "rest")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place in an epoch: 16 hex digits of a seeded hash."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 16)


def _end_of_prefix(sums: DataFrame, by: list[str], n: str) -> DataFrame:
    """Of the ordered sums of each leaf, the one in which token ``rest`` lies, with the tokens before it."""
    upto = Window.partitionBy(*LEAF).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn("upto", F.sum(n).over(upto)).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col(n) < F.col("rest"))).withColumn("before", F.col("upto") - F.col(n))


def plan(counts: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain_weights: dict | None = None, lang_weights: dict | None = None) -> DataFrame:
    """counts (doc_id, domain, lang, source, n) -> one row a leaf: quota, full_epochs, cut_key, cut_id, cut_tokens.

    Of epoch number full_epochs, documents before (cut_key, cut_id) are taken, and cut_tokens of that document.
    """
    leaves = save_narrow(counts.groupBy(*LEAF).agg(F.sum("n").alias("supply")), "mix-leaves")
    given = save_narrow(quotas(leaves, budget_share, max_epochs, DOMAIN_WEIGHTS if domain_weights is None else domain_weights, LANG_WEIGHTS if lang_weights is None else lang_weights), "mix-quotas")
    n_leaves = given.count()
    open_ = small(given.where(F.col("rest") > 0).select(*LEAF, "full_epochs", "rest"), n_leaves)
    keyed = counts.join(open_, LEAF).withColumn("key", order_key(seed, F.col("full_epochs"), F.col("doc_id"))).withColumns({"b1": F.substring("key", 1, 2), "b2": F.substring("key", 3, 2)})
    one = save_narrow(_end_of_prefix(keyed.groupBy(*LEAF, "rest", "b1").agg(F.sum("n").alias("s")), ["b1"], "s").select(*LEAF, "b1", F.col("before").alias("before1")), "mix-first")
    inside = keyed.join(small(one, n_leaves), [*LEAF, "b1"]).withColumn("rest", F.col("rest") - F.col("before1")).drop("before1")
    two = save_narrow(_end_of_prefix(inside.groupBy(*LEAF, "rest", "b1", "b2").agg(F.sum("n").alias("s")), ["b2"], "s").select(*LEAF, "b1", "b2", F.col("before").alias("before2")), "mix-second")
    last = inside.join(small(two, n_leaves), [*LEAF, "b1", "b2"]).withColumn("rest", F.col("rest") - F.col("before2"))
    cut = _end_of_prefix(last.groupBy(*LEAF, "rest", "key", "doc_id").agg(F.sum("n").alias("s")), ["key", "doc_id"], "s")
    cut = cut.select(*LEAF, F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), (F.col("rest") - F.col("before")).alias("cut_tokens"))
    out = save_narrow(given.join(cut, LEAF, "left"), "mix-plan")
    discard(leaves, given, one, two)
    return out


def apply_plan(keyed: DataFrame, leaf_plan: DataFrame, seed: int, cols: dict[str, str]) -> DataFrame:
    """Adds full_epochs and __partial (tokens of the last epoch; null: not in it). cols: names of the leaf, id and count columns in ``keyed``."""
    p = leaf_plan.select(*[F.col(c).alias(f"__p_{c}") for c in LEAF], *[F.col(c).alias(f"__{c}") for c in ("full_epochs", "rest", "cut_key", "cut_id", "cut_tokens")])
    p = small(p, leaf_plan.count())
    out = keyed.join(p, [F.col(cols[c]) == F.col(f"__p_{c}") for c in LEAF])
    key, doc_id, n = order_key(seed, F.col("__full_epochs"), F.col(cols["doc_id"])), F.col(cols["doc_id"]), F.col(cols["n"])
    at = F.col("__key") == F.col("__cut_key")
    before = (F.col("__key") < F.col("__cut_key")) | (at & F.coalesce(doc_id < F.col("__cut_id"), doc_id.isNull() & F.col("__cut_id").isNotNull()))
    partial = F.when(F.col("__rest") <= 0, None).when(before, n).when(at & doc_id.eqNullSafe(F.col("__cut_id")), F.least(n, F.col("__cut_tokens")))
    return out.withColumn("__key", key).withColumn("__partial", partial).drop("__key", "__rest", "__cut_key", "__cut_id", "__cut_tokens", *[f"__p_{c}" for c in LEAF])


def leaf_counts(docs: DataFrame) -> DataFrame:
    """The narrow table that plans are made from; texts are read once for it."""
    return save(with_leaf(docs.select("doc_id", "lang", "source", "text")).select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__n").alias("n")), "mix-counts")


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, **weights: dict) -> DataFrame:
    """The mixed documents with all their columns: a row for each epoch that takes it.

    Documents stay whole here: one that the prefix ends in is taken if half of its tokens are inside.
    """
    counts = leaf_counts(docs)
    leaf_plan = plan(counts, budget_share, max_epochs, seed, **weights)
    discard(counts)
    names = {"domain": "__domain", "lang": "__lang", "source": "__source", "doc_id": "doc_id", "n": "__n"}
    rows = with_leaf(docs.select(as_row(docs).alias("__doc"), "doc_id", "lang", "source", "text")).drop("lang", "source", "text")
    out = apply_plan(rows, leaf_plan, seed, names)
    copies = F.col("__full_epochs").cast("int") + F.coalesce((2 * F.col("__partial") >= F.col("__n")).cast("int"), F.lit(0))
    return out.withColumn("__copies", copies).where(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__doc.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: whole epochs and tokens of the last one."""
    counts = leaf_counts(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    leaf_plan = plan(counts)
    out = apply_plan(counts, leaf_plan, SEED, {c: c for c in (*LEAF, "doc_id", "n")})
    out = out.where((F.col("__full_epochs") > 0) | F.col("__partial").isNotNull())
    partial = F.coalesce(F.col("__partial"), F.lit(0))
    return out.select("doc_id", *LEAF, F.col("n").alias("n_tokens"), F.col("__full_epochs").alias("full_epochs"), partial.alias("partial_tokens"), (F.col("__full_epochs") * F.col("n") + partial).alias("tokens_taken"))


def op1_sql() -> str:
    def case(column: str, weights: dict[str, int]) -> str:
        return f"CAST(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {OTHER_WEIGHT} END AS BIGINT)"

    def fill(name: str, source: str, part: str, key: str) -> str:
        return f"""
{name}_r AS (SELECT *, CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM {source}),
{name}_c AS (SELECT *, sum(capacity) OVER (PARTITION BY {part} ORDER BY ratio, {key} ROWS UNBOUNDED PRECEDING) AS cum_c,
  sum(weight) OVER (PARTITION BY {part} ORDER BY ratio, {key} ROWS UNBOUNDED PRECEDING) AS cum_w, sum(weight) OVER (PARTITION BY {part}) AS all_w FROM {name}_r),
{name}_f AS (SELECT *, CAST(cum_c AS DOUBLE) + ratio * CAST(all_w - cum_w AS DOUBLE) <= budget AS is_full FROM {name}_c),
{name}_l AS (SELECT *, coalesce(max(CASE WHEN is_full THEN cum_c END) OVER (PARTITION BY {part}), 0) AS full_c,
  coalesce(max(CASE WHEN is_full THEN cum_w END) OVER (PARTITION BY {part}), 0) AS full_w FROM {name}_f),
{name} AS (SELECT *, CASE WHEN is_full THEN CAST(capacity AS DOUBLE) ELSE least((budget - CAST(full_c AS DOUBLE)) * CAST(weight AS DOUBLE) / CAST(all_w - full_w AS DOUBLE), CAST(capacity AS DOUBLE)) END AS granted FROM {name}_l)"""

    names = ", ".join(f"'{d}'" for d in DOMAINS)
    return f"""
WITH d0 AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, regexp_extract(coalesce(source, 'unknown'), '([0-9]+)$', 1) AS num,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents),
d AS (SELECT doc_id, lang, source, n, CASE WHEN num = '' THEN 'other' ELSE ([{names}])[CAST(right(num, 6) AS INTEGER) % {len(DOMAINS)} + 1] END AS domain FROM d0),
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS supply, CAST(sum(n) * {MAX_EPOCHS} AS BIGINT) AS capacity FROM d GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, {case('domain', DOMAIN_WEIGHTS)} AS weight,
  (SELECT floor(CAST(sum(supply) AS DOUBLE) * CAST({BUDGET_SHARE} AS DOUBLE)) FROM leaves) AS budget FROM leaves GROUP BY domain),
{fill('gd', 'dom', '1', 'domain')},
lng AS (SELECT l.domain, l.lang, CAST(sum(l.capacity) AS BIGINT) AS capacity, {case('l.lang', LANG_WEIGHTS)} AS weight, any_value(gd.granted) AS budget FROM leaves l JOIN gd ON l.domain = gd.domain GROUP BY l.domain, l.lang),
{fill('gl', 'lng', 'domain', 'lang')},
src AS (SELECT l.*, CAST({SOURCE_WEIGHT} AS BIGINT) AS weight, gl.granted AS budget FROM leaves l JOIN gl ON l.domain = gl.domain AND l.lang = gl.lang),
{fill('gs', 'src', 'domain, lang', 'source')},
fl AS (SELECT *, CAST(floor(granted + 1e-6::DOUBLE) AS BIGINT) AS whole, round(granted - floor(granted + 1e-6::DOUBLE), 6) AS part FROM gs),
lf AS (SELECT *, CAST(floor(round(sum(granted) OVER (), 3) + 1e-6::DOUBLE) AS BIGINT) - sum(whole) OVER () AS left_,
  row_number() OVER (ORDER BY CASE WHEN whole >= capacity THEN 1 ELSE 0 END, part DESC, domain, lang, source) AS place FROM fl),
q AS (SELECT *, CAST(whole + CASE WHEN place <= left_ AND whole < capacity THEN 1 ELSE 0 END AS BIGINT) AS quota FROM lf),
e AS (SELECT domain, lang, source, quota, CASE WHEN supply > 0 THEN quota // supply ELSE 0 END AS full_epochs, supply FROM q),
k AS (SELECT d.*, full_epochs, quota - full_epochs * supply AS rest, substr(md5('{SEED}|' || full_epochs || '|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 16) AS key
  FROM d JOIN e ON d.domain = e.domain AND d.lang = e.lang AND d.source = e.source),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n AS before FROM k)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(full_epochs AS BIGINT) AS full_epochs,
  CAST(CASE WHEN before < rest THEN least(n, rest - before) ELSE 0 END AS BIGINT) AS partial_tokens,
  CAST(full_epochs * n + CASE WHEN before < rest THEN least(n, rest - before) ELSE 0 END AS BIGINT) AS tokens_taken
FROM c WHERE full_epochs > 0 OR before < rest
"""
