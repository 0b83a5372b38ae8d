"""Mixing sources to target weights (operator 3), with DataFrame functions only.

Sources form a tree domain - language - source. A token budget flows from the root to the leaves:
at each node it is shared among the children by weight, no child getting more than all its leaves
hold in ``max_epochs`` passes. What a short child cannot take goes to its siblings by weight
(water-filling); only if all siblings together are short is their parent short, and its own
siblings take over. So shortages are made good among siblings before ancestors. Shares are whole
tokens and add up exactly.

A leaf with budget B and T tokens gives B div T whole epochs, then the token-prefix of B mod T of
the next epoch. Each epoch is an order of the leaf's documents, seeded by (seed, epoch, doc_id); the
last document of the prefix may be cut.

A leaf of any size is ordered in parts: its rows are dealt by the first three hex digits of their
order key, sums of the parts give each part its offset, and only within a part is a running sum
taken. Joins with leaves are salted, so a source with a third of all rows is spread.

Defined cases: null language or source is the node ''; a null or blank text has no tokens and is
never selected; a null doc_id orders as ''; rows repeated whole are drawn like different rows; an
empty table gives an empty result; a child of weight 0 gets nothing; further columns do not matter.
Products of tokens and summed sibling weights must stay under 2^63.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Workspace, read_table

LEVELS = ("domain", "lang", "source")
SALTS = 64
PARTS_HEX = 3

#: Target weights of the production mix; names that are missing weigh 1.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {},
}


def default_domain() -> Column:
    """The domain of a source: its trailing number modulo 4."""
    digits = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.when(digits != "", digits.cast("long") % 4), F.lit(0)).cast("string"))


def token_count() -> Column:
    """Words of the text, as the unit of the budget."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water-fills ``budget`` of each parent among its children (``weight``, ``cap``) to ``share``."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    x = children.where("weight > 0 and cap > 0").select("*", F.coalesce(F.sum("cap").over(before), zero).alias("cap_before"), F.coalesce(F.sum("weight").over(before), zero).alias("weight_before"), F.sum("weight").over(by).alias("weight_all"))
    x = x.withColumn("full", F.expr("cap * (weight_all - weight_before) <= (budget - cap_before) * weight"))
    x = x.select("*", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), zero).alias("cap_full"), F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(by), zero).alias("weight_full"))
    # whole tokens: differences of rounded running shares
    x = x.withColumn("share", F.expr("case when full then cap else (budget - cap_full) * (weight_before + weight - weight_full) div (weight_all - weight_full) - (budget - cap_full) * (weight_before - weight_full) div (weight_all - weight_full) end"))
    return x.drop("cap_before", "weight_before", "weight_all", "full", "cap_full", "weight_full")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``(domain, lang, source, tokens, budget)`` of each leaf, from its ``tokens``."""
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs).withColumn("root", F.lit(0))
    above = tree.groupBy("root").agg(F.expr(f"least(sum(cap), sum(tokens) * {share[0]} div {share[1]})").alias("budget"))
    path = ["root"]
    for level in LEVELS:
        nodes = tree.groupBy(*path, level).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        filled = _fill(nodes.join(above, path), path, level)
        path = [*path, level]
        above = filled.select(*path, F.col("share").alias("budget"))
    return tree.join(above, path).select(*LEVELS, "tokens", "budget").where("budget > 0")


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, share: tuple[int, int] = (4, 5), max_epochs: int = 2, seed: int = 17, domain: Column | None = None, work: Workspace | None = None) -> DataFrame:
    """``(doc_id, dh, domain, lang, source, n_tokens, epochs, prefix_tokens)`` of selected rows.

    The budget is ``share[0] / share[1]`` of all tokens. A selected document is taken ``epochs``
    times whole and once more with its first ``prefix_tokens`` tokens.
    """
    work = work or Workspace(docs.sparkSession, "mixing")
    domain = default_domain() if domain is None else domain
    blank = F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", blank)).alias("dh"), domain.alias("domain"), F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"), token_count().alias("n_tokens"), F.when(F.col("doc_id").isNull(), F.md5("text")).alias("digest")).where("n_tokens > 0")
    rows = work.put(rows, "tokens")
    leaves = work.put(budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), weights, share, max_epochs), "leaves")
    salted = leaves.select(*LEVELS, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod("dh", F.lit(SALTS)).cast("int")
    # rows without an id are dealt by their texts
    text_id = F.coalesce(F.col("doc_id").cast("string"), "digest")
    drawn = rows.withColumn("salt", salt).join(salted, [*LEVELS, "salt"]).drop("salt")
    drawn = drawn.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), text_id))).withColumn("part", F.substring("key", 1, PARTS_HEX))
    drawn = work.put(drawn, "drawn")
    ahead = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = drawn.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("held")).select(*LEVELS, "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*LEVELS, "part").orderBy("key", "n_tokens", "dh").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.join(parts, [*LEVELS, "part"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    out = placed.select("doc_id", "dh", *LEVELS, "n_tokens", "epochs", F.expr("greatest(0, least(n_tokens, rest - start))").cast("long").alias("prefix_tokens"))
    return out.where("epochs > 0 or prefix_tokens > 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every selected document: whole epochs, tokens of the last prefix, and tokens in all."""
    rows = mix(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *LEVELS, "n_tokens", "epochs", "prefix_tokens", (F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("taken_tokens"))


def _sql_weight(level: str) -> str:
    cases = "".join(f" WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    return f"CAST(CASE {level}{cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"


def _sql_level(i: int) -> str:
    """One level of water-filling: table f<i> with the shares of the nodes on the path."""
    path, parent, level = ", ".join(LEVELS[: i + 1]), ", ".join(LEVELS[:i]), LEVELS[i]
    by = f"PARTITION BY {parent}" if parent else ""
    budget = f"JOIN f{i - 1} USING ({parent})" if parent else "CROSS JOIN root"
    source = f"share{i - 1}" if parent else "budget"
    return f"""
n{i} AS (
  SELECT {path}, cap, weight, {source} AS budget FROM (
    SELECT {path}, sum(2 * tokens)::BIGINT AS cap, {_sql_weight(level)} AS weight FROM leaves GROUP BY {path}) {budget}),
w{i} AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS cb, coalesce(sum(weight) OVER b, 0)::BIGINT AS wb, (sum(weight) OVER ({by}))::BIGINT AS wa
  FROM n{i} WHERE cap > 0 WINDOW b AS ({by} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s{i} AS (
  SELECT *, coalesce(sum(cap) FILTER (WHERE isfull) OVER ({by}), 0)::BIGINT AS cf, coalesce(sum(weight) FILTER (WHERE isfull) OVER ({by}), 0)::BIGINT AS wf
  FROM (SELECT *, cap * (wa - wb) <= (budget - cb) * weight AS isfull FROM w{i})),
f{i} AS (
  SELECT {path}, CASE WHEN isfull THEN cap ELSE (budget - cf) * (wb + weight - wf) // (wa - wf) - (budget - cf) * (wb - wf) // (wa - wf) END AS share{i} FROM s{i})"""


#: The same rows in DuckDB SQL.
ORACLE = (
    r"""
WITH rows AS (
  SELECT * FROM (
    SELECT doc_id, 'd' || coalesce(CAST(CAST(nullif(regexp_extract(coalesce(source, ''), '(\d{1,9})$', 1), '') AS BIGINT) % 4 AS VARCHAR), '0') AS domain,
      coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
      CASE WHEN doc_id IS NULL THEN md5(text) END AS digest
    FROM documents) WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
root AS (SELECT least(sum(2 * tokens), sum(tokens) * 4 // 5)::BIGINT AS budget FROM leaves),"""
    + ",".join(_sql_level(i) for i in range(3))
    + r""",
drawn AS (
  SELECT rows.*, share2 // tokens AS epochs, share2 % tokens AS rest, md5('17:' || (share2 // tokens)::BIGINT || ':' || coalesce(CAST(doc_id AS VARCHAR), digest)) AS key
  FROM rows JOIN leaves USING (domain, lang, source) JOIN f2 USING (domain, lang, source) WHERE share2 > 0),
placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM drawn),
cut AS (
  SELECT doc_id, domain, lang, source, n_tokens, epochs::BIGINT AS epochs, greatest(0, least(n_tokens, rest - start))::BIGINT AS prefix_tokens FROM placed)
SELECT *, (epochs * n_tokens + prefix_tokens)::BIGINT AS taken_tokens FROM cut WHERE epochs > 0 OR prefix_tokens > 0
"""
)
