"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations alone.

Targets come from weights by water filling under a cap of `most_repeats` times the source. The mix is then
made of equal blocks of `block` words. A house of that many seats is given to the sources by highest
quotients target / (2 i - 1); the method is house-monotone, so the seats of shard k are the difference of
two houses: integer quotas per shard. Each source's documents are laid out in a seeded order, cut into
equal blocks, and the quotas take one block after another, from the start again when the source is used up.

No quotients are listed beyond those near the cut: seats(d) = floor(t / d + 1/2) at two divisors d that
provably bracket the right one leave at most about two candidates for each source. The running word count
of a source is summed per hash bucket first and inside buckets after, so a source that holds a third of
all rows is spread over all tasks.

Defined cases: null text has size 0; a null source is one source, last; null or repeated ids are kept, one
row each (rows alike in id and size may swap their shares); an empty table gives an empty mix; a corpus
without a word gives targets and takes of 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, scratch

BLOCK, SHARDS, SEED, MOST_REPEATS = 64, 8, "mix-1", 3
#: Rows that one task orders by seeded key at a time, about.
BUCKET_ROWS = 2_000


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size (words), key (seeded order)."""
    return docs.select("doc_id", "source", _size().alias("size"), _key(seed).alias("key"))


def _source_key(column: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def targets(totals: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, weight -> those and rank, target (double): one row for each source.

    Sources in the order of the ratio cap / weight: source k is capped if its cap is no more than what its
    weight gets of the words that the capped ones before it leave. The order key is an exact integer.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(by_code_point))
    if "weight" not in totals.columns:
        ranked = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    ratio = F.col("source_size") * most_repeats / F.col("weight")
    if "weight" not in totals.columns:  # weights 1, 2, 3 divide 6
        ratio = F.col("source_size") * F.expr("6 div weight")
    before = Window.orderBy(ratio, "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = F.col("source_size") * most_repeats
    step = (
        ranked.withColumn("cap", cap)
        .withColumn("place", F.row_number().over(Window.orderBy(ratio, "rank")))
        .withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    )
    first_free = F.min(F.when(~F.col("capped"), F.struct("place", "left_words", "left_weight"))).over(everything)
    free = F.col("first_free")
    return (
        step.withColumn("first_free", first_free)
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
                (F.col("weight") * free["left_words"]).cast("double") / free["left_weight"].cast("double")
            ),
        )
        .select("source", "source_size", "rank", "weight", "target")
    )


def allot(shares: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """Sainte-Laguë: source, rank, shard (1..shards), quota (blocks), first_block (of the source's sequence).

    shares: source, rank, target. House of shard k: floor(k * blocks / shards), blocks = round(sum of targets / block).
    """
    everything = Window.partitionBy()
    house = (
        shares.filter("target > 0")
        .withColumn("all_words", F.sum("target").over(everything))
        .withColumn("sources", F.count(F.lit(1)).over(everything))
        .withColumn("blocks", F.round(F.col("all_words") / block).cast("long"))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("seats", F.expr(f"blocks * shard div {shards}"))
    )
    few = F.col("seats") - F.col("sources") / 2
    least = F.when(few > 0, F.greatest(F.floor(F.col("target") * few / F.col("all_words") + 0.5) - 1, F.lit(0))).otherwise(F.lit(0))
    most = F.floor(F.col("target") * (F.col("seats") + F.col("sources") / 2 + 1) / F.col("all_words") + 0.5) + 1
    bracket = house.withColumn("least", least.cast("long")).withColumn("most", most.cast("long"))
    shard = Window.partitionBy("shard")
    wanted = bracket.withColumn("open", F.col("seats") - F.sum("least").over(shard))
    quotient = F.col("target") / (2 * F.col("seat") - 1)
    seated = (
        wanted.withColumn("seat", F.explode(F.sequence(F.col("least") + 1, F.col("most"))))
        .withColumn("place", F.row_number().over(shard.orderBy(quotient.desc(), "rank", "seat")))
        .groupBy("source", "rank", "shard")
        .agg((F.max("least") + F.sum((F.col("place") <= F.col("open")).cast("long"))).alias("held"))
    )
    by_shard = Window.partitionBy("rank").orderBy("shard")
    first = F.coalesce(F.lag("held").over(by_shard), F.lit(0))
    return seated.select("source", "rank", "shard", (F.col("held") - first).alias("quota"), first.alias("first_block"))


def _bucket(rows: int) -> Column:
    """Hash bucket of the seeded key; their number follows the number of rows."""
    buckets = 1
    while buckets * BUCKET_ROWS < rows and buckets < 1 << 16:
        buckets *= 2
    return F.expr(f"shiftright(cast(conv(substring(key, 1, 4), 16, 10) as int) * {buckets}L, 16)").cast("int")


def _placed(known: DataFrame, block: int, shards: int, most_repeats: int) -> DataFrame:
    """One row for each source: of, source_size, target, passes (how often all of it is taken), rest (words of one more pass), cut (the
    bucket in which that pass ends) and base (words of the source before that bucket)."""
    per_bucket = known.groupBy("of", "bucket").agg(F.sum("size").alias("bucket_size"), F.max("source").alias("source"))
    totals = per_bucket.groupBy("of").agg(F.sum("bucket_size").alias("source_size"), F.max("source").alias("source"))
    shares = targets(totals.drop("of"), most_repeats)
    seats = allot(shares, block, shards).groupBy("rank").agg(F.sum("quota").alias("blocks"))
    words = F.least(F.coalesce("blocks", F.lit(0)) * block, F.col("source_size") * most_repeats)
    plan = (
        shares.join(seats, "rank", "left")
        .withColumn("words", words)
        .select(
            _source_key().alias("of"),
            "source_size",
            "target",
            F.expr("CASE WHEN source_size > 0 THEN words div source_size ELSE 0 END").alias("passes"),
            F.expr("CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END").alias("rest"),
        )
    )
    base = F.sum("bucket_size").over(Window.partitionBy("of").orderBy("bucket")) - F.col("bucket_size")
    ends = per_bucket.withColumn("base", base).join(plan, "of").filter("base <= rest AND rest < base + bucket_size")
    # a source without a word has no cut: nothing of it is taken
    return plan.join(ends.select("of", F.col("bucket").alias("cut"), "base"), "of", "left").withColumn("cut", F.coalesce("cut", F.lit(-1)))


def _whole(laid: DataFrame) -> DataFrame:
    """The rows beside their source's cut, and `times`: how often each is taken, always as a whole; nothing is put in order for that."""
    return laid.filter("bucket <> cut").withColumn("times", F.col("passes") + (F.col("bucket") < F.col("cut")).cast("long"))


def _at_cut(sized: DataFrame) -> DataFrame:
    """The rows of the buckets that hold their source's cut, in order, and `taken`: the words that the mix takes."""
    within = Window.partitionBy("of").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("base") - F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.least(F.greatest(left, F.lit(0)), F.col("size"))
    return sized.withColumn("part", part).withColumn("taken", (F.col("passes") * F.col("size") + F.col("part")).cast("long"))


def mix(
    docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix, repeats counted)."""
    known = scratch(sizes(docs, seed), "sizes").withColumn("of", _source_key())
    known = known.withColumn("bucket", _bucket(known.count()))
    placed = scratch(_placed(known, block, shards, most_repeats), "placed", narrow=True)
    laid = known.join(placed, "of")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return _whole(laid).withColumn("taken", F.col("times") * F.col("size")).select(columns).union(_at_cut(laid.filter("bucket = cut")).select(columns))


def mixture(
    docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """The rows of the mix, all columns: each document as often as the mix takes it, to the nearest whole number. Texts stay where they
    are, but for those of one bucket of each source."""
    known = scratch(sizes(docs, seed), "sizes").withColumn("of", _source_key())
    bucket = _bucket(known.count())
    placed = scratch(_placed(known.withColumn("bucket", bucket), block, shards, most_repeats), "placed", narrow=True)
    rows = docs.select(F.struct(*docs.columns).alias("row"), _source_key().alias("of"), "text", _key(seed).alias("key")).withColumn("bucket", bucket)
    laid = rows.join(placed, "of").filter(F.col("text").rlike(WORD))  # a text without a word adds nothing, so it is never taken
    edge = _at_cut(laid.filter("bucket = cut").withColumn("size", _size())).withColumn("times", F.round(F.col("taken") / F.col("size")))
    taken = _whole(laid).select("row", "times").union(edge.select("row", "times")).filter("times > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")


#: DuckDB SQL for `mix` over `documents` with the default parameters.
ORACLE = f"""
WITH known AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
ranked AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, {MOST_REPEATS} * source_size AS cap FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM known GROUP BY source)),
step AS (
  SELECT *, cap * left_weight <= weight * left_words AS capped FROM (
    SELECT *, row_number() OVER o AS place,
      CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS BIGINT) AS left_words,
      CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS left_weight
    FROM ranked
    WINDOW o AS (ORDER BY source_size * (6 // weight), rank),
           b AS (ORDER BY source_size * (6 // weight), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
free AS (SELECT left_words AS w, left_weight AS k FROM step WHERE NOT capped ORDER BY place LIMIT 1),
shares AS (
  SELECT source, source_size, rank,
    CASE WHEN capped THEN CAST(cap AS DOUBLE)
         ELSE CAST(weight * (SELECT w FROM free) AS DOUBLE) / CAST((SELECT k FROM free) AS DOUBLE) END AS target
  FROM step),
house AS (SELECT CAST(round(sum(target) / {BLOCK}) AS BIGINT) AS seats FROM shares),
seats AS (
  SELECT source, count(*) AS blocks FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, rank, seat) AS place
    FROM shares, range(1, CAST(target / {BLOCK} + 3 + (SELECT count(*) FROM shares) AS BIGINT)) AS t(seat)
    WHERE target > 0)
  WHERE place <= (SELECT seats FROM house) GROUP BY source),
plan AS (
  SELECT s.source, s.source_size, s.target, least(coalesce(q.blocks, 0) * {BLOCK}, {MOST_REPEATS} * s.source_size) AS words
  FROM shares s LEFT JOIN seats q ON s.source IS NOT DISTINCT FROM q.source),
laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM known)
SELECT l.doc_id, l.size, p.source_size, p.target,
  CAST(CASE WHEN p.source_size = 0 THEN 0
       ELSE (p.words // p.source_size) * l.size + least(greatest(p.words % p.source_size - l.start, 0), l.size) END AS BIGINT) AS taken
FROM laid l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source
"""
