"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget goes down the tree domain > language > source by weight. No node gets more than its
documents give in ``epochs`` passes; what a node cannot take goes to its siblings by their weights,
and only what a whole level cannot take is missing at the level above. As every level is filled with
the capacities of its whole subtrees, siblings come before ancestors. Each leaf then takes the
token-prefix of a seeded stream: its documents in a seeded order, one order per epoch.

No order of a whole leaf is ever made in one place: documents fall into buckets by the first digits
of their seeded digest, bucket totals are added up, and only the one bucket in which the budget ends
is ordered document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.common import attach, settle

UNIT = 1000                 # weights are whole numbers of 1 / UNIT
DOMAINS = ("web", "books", "forum")
DOMAIN_WEIGHTS = {"web": 5.0, "books": 3.0, "forum": 2.0}
LANG_WEIGHTS = {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0}
DIGITS = 3                  # hexadecimal digits of a bucket: 4096 buckets a leaf and epoch
SEED = 17
EPOCHS = 4
WORD = r"[^\x20\x09-\x0D]+"
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """The domain of a source of the tables: their number, in turns of the three domains; others are web."""
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return F.coalesce(F.element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))) + 1), F.lit(DOMAINS[0]))


def weight_of(name: Column, weights: dict[str, float], other: float = 1.0) -> Column:
    """A weight table as a column, in whole units."""
    out = F.lit(round(other * UNIT))
    for key, w in weights.items():
        out = F.when(name == key, round(w * UNIT)).otherwise(out)
    return out.cast("decimal(38,0)")


def fill(nodes: DataFrame, parent: list[str], node: str, weight: str, cap: str, given: str, out: str) -> DataFrame:
    """Shares ``given`` (of the parent) among the parent's nodes by weight, none over its ``cap``.

    In order of cap / weight, a node is full if its weight's share of what is left reaches its cap;
    the rest share what is left, in whole tokens. One row per node: the table is the tree, not the data."""
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    order = Window.partitionBy(*parent).orderBy((F.col(cap).cast("double") / F.col(weight).cast("double")).asc(), F.col(node).asc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = nodes.select("*", F.coalesce(F.sum(dec(cap)).over(before), F.lit(0)).alias("_taken"), F.sum(dec(weight)).over(after).alias("_rest"))
    d = d.withColumn("_full", dec(cap) * F.col("_rest") <= dec(weight) * (dec(given) - F.col("_taken")))
    d = d.withColumn("_left", dec(given) - F.coalesce(F.sum(F.when(F.col("_full"), dec(cap))).over(whole), F.lit(0)))
    open_weight = F.when(~F.col("_full"), dec(weight)).otherwise(F.lit(0))
    d = d.select("*", F.sum(open_weight).over(upto).alias("_to"), F.sum(open_weight).over(whole).alias("_all"))
    part = F.expr("CAST(_left * _to AS DECIMAL(38,0)) div _all - CAST(_left * (_to - _w) AS DECIMAL(38,0)) div _all")
    d = d.withColumn("_w", dec(weight))
    got = F.when(F.col("_full"), dec(cap)).otherwise(part)
    return d.withColumn(out, got.cast("long")).drop("_taken", "_rest", "_full", "_left", "_to", "_all", "_w")


def budgets(leaves: DataFrame, budget: int | None, epochs: int, domain_weights: dict[str, float], lang_weights: dict[str, float],
            source_weights: dict[str, float]) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, docs) with ``budget`` tokens each. No budget: all tokens there are."""
    d = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = d.agg(F.sum("tokens").alias("_b"))
    d = d.crossJoin(F.broadcast(total)).withColumn("_b", F.col("_b") if budget is None else F.lit(budget).cast("long"))      # one row
    langs = d.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("_b").alias("_b"))
    tops = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("_b").alias("_b"))
    tops = fill(tops.withColumn("w", weight_of(F.col("domain"), domain_weights)).withColumn("all", F.lit(1)), ["all"], "domain", "w", "cap", "_b", "got")
    langs = langs.join(tops.select("domain", "got"), "domain").withColumn("w", weight_of(F.col("lang"), lang_weights))
    langs = fill(langs.withColumnRenamed("got", "given"), ["domain"], "lang", "w", "cap", "given", "got")
    d = d.drop("_b").join(langs.select("domain", "lang", F.col("got").alias("given")), ["domain", "lang"]).withColumn("w", weight_of(F.col("source"), source_weights))
    return fill(d, ["domain", "lang"], "source", "w", "cap", "given", "budget").select(*LEAF, "tokens", "docs", "budget")


def select(docs: DataFrame, budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
           lang: str = "lang", source: str = "source", domain: Column | None = None, domain_weights: dict[str, float] = DOMAIN_WEIGHTS,
           lang_weights: dict[str, float] = LANG_WEIGHTS, source_weights: dict[str, float] | None = None, rid: Column | None = None) -> DataFrame:
    """One row per document and epoch that the mixture takes: doc_id, domain, lang, source, epoch, n_tokens,
    start_token (place in its leaf's stream), take_tokens (under n_tokens only where a leaf's prefix ends), and
    rid, where one is given.

    Tokens are words between ASCII white space. A NULL lang or source is the leaf part 'unknown'. A NULL, empty
    or blank text has no token and is never taken. Rows of equal doc_id follow one another by length and
    digest of their text; rows equal in all that are interchangeable. No rows give no rows. Unnamed
    sources and languages weigh 1. Extra columns are ignored."""
    src = F.coalesce(F.col(source).cast("string"), F.lit("unknown"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (domain_of(src) if domain is None else domain).alias("domain"),
                       F.coalesce(F.col(lang).cast("string"), F.lit("unknown")).alias("lang"), src.alias("source"),
                       F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
                       F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("body"),
                       *([] if rid is None else [rid.alias("rid")]))
    rows = settle(rows.where("n_tokens > 0").withColumn("leaf", F.xxhash64(*LEAF)), "mixing-rows")
    leaves = settle(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    plan = budgets(leaves, budget, epochs, domain_weights, lang_weights, source_weights or {})
    # epoch e of a leaf takes min(tokens, what is left of its budget)
    each = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    each = each.withColumn("goal", F.least("tokens", F.col("budget") - F.col("epoch") * F.col("tokens"))).where("goal > 0")
    each = settle(each.withColumn("leaf", F.xxhash64(*LEAF)).groupBy("leaf", *LEAF).agg(F.max("docs").alias("docs"), F.max("tokens").alias("tokens"),
                  F.collect_list(F.struct("epoch", "goal")).alias("epochs")), "leaf-epochs")           # ``epochs`` entries at most
    stream = attach(rows, each.drop(*LEAF), "leaf", rows.count(), "docs").where("epochs IS NOT NULL")
    stream = stream.select("*", F.explode("epochs").alias("e")).select("*", "e.epoch", "e.goal").drop("epochs", "e", "docs")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    stream = settle(stream.withColumn("key", key).withColumn("bucket", F.substring("key", 1, DIGITS)), "streams")
    sums = stream.groupBy("leaf", "epoch", "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.max("goal").alias("g"))
    run = Window.partitionBy("leaf", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)            # 16 ** DIGITS rows at most
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(run), F.lit(0)))
    taken = sums.where("ahead < g").select("leaf", "epoch", "bucket", "ahead")
    near = stream.join(taken, ["leaf", "epoch", "bucket"])
    inside = Window.partitionBy("leaf", "epoch", "bucket").orderBy("key", "n_tokens", "body").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("start_token", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("start_token < goal")
    return near.select("doc_id", *LEAF, "epoch", "n_tokens", (F.col("start_token") + F.col("epoch") * F.col("tokens")).alias("start_token"),
                       F.least(F.col("n_tokens"), F.col("goal") - F.col("start_token")).alias("take_tokens"), *([] if rid is None else ["rid"]))


def oracle(table: str = "documents", budget: str = "(SELECT sum(tokens) FROM leaves)", epochs: int = EPOCHS, seed: int = SEED,
           domain_weights: dict[str, float] = DOMAIN_WEIGHTS, lang_weights: dict[str, float] = LANG_WEIGHTS) -> str:
    """The same in ANSI SQL: exact whole-number water filling and one running sum per leaf and epoch."""
    def case(col: str, w: dict[str, float]) -> str:
        return f"(CASE {col} " + " ".join(f"WHEN '{k}' THEN {round(v * UNIT)}" for k, v in w.items()) + f" ELSE {UNIT} END)::HUGEINT" if w else f"{UNIT}::HUGEINT"

    names = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAINS))

    def level(name: str, src: str, parent: str, node: str) -> str:
        order = f"(PARTITION BY {parent} ORDER BY cap::DOUBLE / w::DOUBLE, {node} "
        part = f"(PARTITION BY {parent})"
        return f"""{name}1 AS (SELECT *, coalesce(sum(cap) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS taken,
            (sum(w) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS rest FROM {src}),
        {name}2 AS (SELECT *, cap::HUGEINT * rest <= w * (given::HUGEINT - taken) AS is_full FROM {name}1),
        {name}3 AS (SELECT *, given::HUGEINT - coalesce(sum(CASE WHEN is_full THEN cap END) OVER {part}, 0)::HUGEINT AS remain,
            (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::HUGEINT AS upto,
            (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER {part})::HUGEINT AS every FROM {name}2),
        {name} AS (SELECT *, CASE WHEN is_full THEN cap::HUGEINT ELSE remain * upto // every - remain * (upto - w) // every END::BIGINT AS got FROM {name}3)"""

    return f"""WITH parts AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
            len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS body FROM {table}),
        toks AS (SELECT *, CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % {len(DOMAINS)} {names} END AS domain FROM parts WHERE n_tokens > 0),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM toks GROUP BY ALL),
        caps AS (SELECT *, tokens * {epochs} AS cap FROM leaves),
        dom0 AS (SELECT 1 AS one, domain, sum(cap)::BIGINT AS cap, {case('domain', domain_weights)} AS w, {budget}::BIGINT AS given FROM caps GROUP BY domain),
        {level('dom', 'dom0', 'one', 'domain')},
        lan0 AS (SELECT c.domain, lang, sum(c.cap)::BIGINT AS cap, {case('lang', lang_weights)} AS w, max(d.got) AS given FROM caps c JOIN dom d ON c.domain = d.domain GROUP BY c.domain, lang),
        {level('lan', 'lan0', 'domain', 'lang')},
        src0 AS (SELECT c.domain, c.lang, c.source, c.tokens, c.cap, {case('c.source', {})} AS w, l.got AS given FROM caps c JOIN lan l ON c.domain = l.domain AND c.lang = l.lang),
        {level('src', 'src0', 'domain, lang', 'source')},
        ep AS (SELECT domain, lang, source, tokens, e.epoch::INT AS epoch, least(tokens, got - e.epoch * tokens) AS goal FROM src, range(0, {epochs}) AS e(epoch)),
        st AS (SELECT t.*, ep.epoch, ep.goal, ep.tokens, coalesce(sum(n_tokens) OVER (PARTITION BY t.domain, t.lang, t.source, ep.epoch
            ORDER BY md5('{seed}|' || ep.epoch || '|' || coalesce(doc_id::VARCHAR, 'null')), n_tokens, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_token
            FROM toks t JOIN ep ON t.domain = ep.domain AND t.lang = ep.lang AND t.source = ep.source AND ep.goal > 0)
        SELECT doc_id, domain, lang, source, epoch, n_tokens, (start_token + epoch * tokens)::BIGINT AS start_token, least(n_tokens, goal - start_token)::BIGINT AS take_tokens
        FROM st WHERE start_token < goal"""
