"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every source has a target repetition rate: its target weight times the total size, over its own size. A document's
number of copies is drawn from a Poisson distribution with that mean, by inverting the distribution at a number in
[0, 1) taken from a digest of the seed and the document's id. The draw needs nothing but the row and its source's
rate, so no source is gathered anywhere, however large it is. The copies are then shuffled globally: each goes to
the partition, and to the place in it, that a digest of seed, id and copy number gives.

Rates above ``STEP`` are drawn as sums of smaller draws (a sum of Poisson numbers is Poisson), so any rate works.

Defined results: a null source is a source of its own; a null text has size 0; a source of size 0 keeps rate 1;
rows with the same id and source get the same number of copies; a null id is drawn like the text "null"; an empty
table gives no rows; columns of the input pass through, whatever their names, except that ``copy`` and
``shuffle_key`` are added, or replaced where the input has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.names import unused, without
from tidemill.session import stage

SEED = "mix-1"
#: Exponent of a source's size in the default target weights: between 1 (as is) and 0 (all sources alike).
ALPHA = 0.5
#: The largest mean of one draw, and the largest number that one draw can give (its chance to be more is under 1e-28).
STEP, MOST = 16.0, 96
#: Source rates that are sent to every task. With more sources the join shuffles, and every source is dealt over ``SALTS`` keys.
BROADCAST_SOURCES, SALTS = 100_000, 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, mean: Column) -> Column:
    """The smallest n with u < P(X <= n): a Poisson number by inversion."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.when(u >= a["c"], F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["n"] + 1).alias("n"))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda a: a["n"])


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``mix_source, rate`` of every source. ``weights``: (source, weight) rows; by default size ** alpha. A source without a weight has rate 0."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(float(alpha))) if alpha != 0.5 else F.sqrt("size"))
    else:
        given = weights.select(F.col(weights.columns[0]).alias("w_source"), F.col(weights.columns[1]).cast("double").alias("weight"))
        weighted = sizes.join(given, F.col("mix_source").eqNullSafe(F.col("w_source")), "left").select("mix_source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighted = stage(weighted, "weights")  # a row for each source, read three times
    total = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    scale = (total["size"] or 0.0) / total["weight"] if total["weight"] else 0.0
    return weighted.select("mix_source", F.when(F.col("size") > 0, F.col("weight") * F.lit(scale) / F.col("size")).otherwise(1.0).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All copies of all documents in a global random order: the input's columns, ``copy`` (from 1) and ``shuffle_key``."""
    columns = without(docs, "copy", "shuffle_key")
    docs = docs.select(*columns)
    rate_name, source_name, count_name, salt_name = unused(docs, "rate", "mix_source", "n_copies", "salt")
    found = rates(docs, weights, alpha, source_col, text_col).toDF(source_name, rate_name)
    same = F.col(source_col).eqNullSafe(F.col(source_name))
    if found.count() <= BROADCAST_SOURCES:  # a checked size
        rated = docs.join(F.broadcast(found), same)
    else:
        salted = docs.withColumn(salt_name, F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SALTS)).cast("int"))
        (other,) = unused(salted, "salt_of_source")
        found = found.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = salted.join(found, same & (F.col(salt_name) == F.col(other)))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rate = F.col(rate_name)
    draws = F.greatest(F.lit(1), F.ceil(rate / STEP)).cast("int")
    copies = F.aggregate(
        F.sequence(F.lit(1), draws),
        F.lit(0),
        lambda n, j: n + poisson(uniform(F.lit(seed), name, j.cast("string")), rate / draws),
    )
    drawn = rated.withColumn(count_name, copies).where(F.col(count_name) > 0)
    out = drawn.select(*columns, F.explode(F.sequence(F.lit(1), F.col(count_name))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), name, F.col("copy").cast("string"))), 1, 13), 16, 10).cast("long")
    return out.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key", id_col, "copy")


#: The same draw in DuckDB's SQL for the default weights.
SQL = f"""
WITH RECURSIVE sizes AS (SELECT source AS mix_source, CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (SELECT mix_source, CASE WHEN size > 0 THEN sqrt(size) * ((SELECT sum(size) FROM sizes) / (SELECT sum(sqrt(size)) FROM sizes)) / size ELSE 1.0 END AS rate FROM sizes),
means AS (SELECT mix_source, CAST(greatest(1, ceil(rate / {STEP})) AS BIGINT) AS draws, rate / CAST(greatest(1, ceil(rate / {STEP})) AS BIGINT) AS mean FROM rates),
steps AS (SELECT mix_source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL SELECT mix_source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps WHERE k + 1 < {MOST}),
curves AS (SELECT mix_source, any_value(draws) AS draws, list(c ORDER BY k) AS cs FROM steps GROUP BY mix_source),
drawn AS (SELECT d.*, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cs, lambda c: c <=
    CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)))) AS n_copies
  FROM documents d JOIN curves ON d.source IS NOT DISTINCT FROM mix_source),
copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, CAST(n_copies AS BIGINT) + 1)) AS INTEGER) AS copy FROM drawn)
SELECT *, CAST('0x' || substr(md5('{SEED}|place|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy), 1, 13) AS BIGINT) AS shuffle_key FROM copies
"""
