"""Mixing sources to target weights with hash thresholds.

A document's place in its source is a 60-bit hash. Sizes are summed per source and hash bucket (4,096 buckets); the
thresholds where whole copies stop lie inside one bucket per source. Only that boundary bucket is summed again by the
next 12 bits, and so on until the hash is used up; a document is then taken when its hash is below the threshold.
Budgets are nested: a larger budget of a source keeps every document a smaller one took. Nothing is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import unused
from .registry import query, table

WORD = r"[^\x20\x09-\x0D]+"
HEX = 3  # hexadecimal digits of the hash that one round looks at: 4,096 buckets
ROUNDS = 5


@dataclass(frozen=True)
class Params:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # repeated over the sources in code-point order, null last
    share: float = 1.5  # of all sizes
    most: int = 2  # times its size that a source or a document is taken at most


def place(id_col: str) -> Column:
    """The document's hash as 32 hexadecimal digits."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))


def targets(sizes: DataFrame, p: Params = Params()) -> DataFrame:
    """From one row per source (source, source_size): target. Excess over `most` times the size is reshared by weight.

    Water filling: with sources ordered by cap per weight, the first k are full where the level that the others share
    no longer passes their cap. One row per source takes part in the window.
    """
    weights = F.array(*[F.lit(w) for w in p.weights])
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", weights[F.col("_i") % len(p.weights)])
    ranked = ranked.withColumn("_cap", (p.most * F.col("source_size")).cast("double")).withColumn("_per", F.col("_cap") / F.col("_w"))
    full = Window.orderBy("_per", "_i").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_per", "_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (p.share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(full), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(full), F.lit(0.0)))
    leveled = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_per"))
    final = F.min(F.when(F.col("_open"), F.struct("_per", "_i", "_level"))).over(every)
    target = F.when(F.col("_open"), F.col("_w") * F.coalesce(final["_level"], F.col("_per"))).otherwise(F.col("_cap"))
    return leveled.select("source", "source_size", F.round(F.least(target, F.col("_cap")), 6).alias("target"))


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """source, copies (whole copies of everything), edge (hash prefix): documents below the edge are taken once more.

    rows: source, size, place. The boundary hash itself is taken when that brings the sum nearer to the target.
    """
    edge = sources.select(
        "source", F.floor(F.col("target") / F.col("source_size")).cast("long").alias("copies"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("left"), F.lit("").alias("prefix"),
    ).where("source_size > 0")
    for k in range(ROUNDS):
        inside = rows.join(edge, rows["source"].eqNullSafe(edge["source"]) & F.col("place").startswith(F.col("prefix")) if k == 0 else
                           rows["source"].eqNullSafe(edge["source"]) & (F.substring("place", 1, HEX * k) == F.col("prefix"))).drop(edge["source"])
        bucket = F.substring("place", 1, HEX * (k + 1)).alias("b")
        hist = inside.groupBy("source", "copies", "left", bucket).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("b"))
        hist = hist.withColumn("_upto", run).withColumn("_before", F.col("_upto") - F.col("n"))
        # The last bucket that begins at or under the budget holds the threshold.
        edge = hist.where(F.col("_before") <= F.col("left")).groupBy("source", "copies").agg(
            F.max_by(F.struct("b", (F.col("left") - F.col("_before")).alias("left"), "n"), "b").alias("x")
        ).select("source", "copies", F.col("x.b").alias("prefix"), F.col("x.left").alias("left"), F.col("x.n").alias("n"))
        edge = cut_lineage(edge)
    nearer = F.col("n") - F.col("left") < F.col("left")
    return edge.select("source", "copies", F.col("prefix").alias("edge"), nearer.alias("with_edge"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", p: Params = Params()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies: one row per input row.

    Null texts have size 0; a null source is a source of its own, ordered last; null ids share one place. Rows that
    repeat an id share a place, so they are taken together. Sources without words have target 0 and take nothing.
    An empty table gives no rows; other columns play no part.
    """
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place(id_col).alias("place"),
    ))
    sources = cut_lineage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), p))
    edges = thresholds(rows.select("source", "size", "place"), sources)
    plan = sources.join(edges, sources["source"].eqNullSafe(edges["source"]), "left").drop(edges["source"])
    here = F.substring("place", 1, HEX * ROUNDS)
    extra = F.when((here < F.col("edge")) | ((here == F.col("edge")) & F.col("with_edge")), 1).otherwise(0)
    copies = F.coalesce(F.least(F.col("copies") + extra, F.lit(p.most)), F.lit(0)).cast("long")
    return rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), rows["source"], copies.alias("copies")
    )


def mixed_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with its own columns, whatever their names. Word-free documents go."""
    key, n, k = (unused(docs, x) for x in ("_id", "_n", "_k"))
    m = mix(docs, p=p).where("copies > 0 and size > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(n))
    out = docs.join(m, docs["doc_id"].eqNullSafe(m[key])).where(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0)
    return out.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select([f"`{c}`" for c in docs.columns])


SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size, substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15) as place from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
i as (select *, ([3.0, 1.0, 2.0]::double[])[((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int] as w, (2 * source_size)::double as cap,
        row_number() over (order by source is null, encode(source)) as i from s),
p as (select *, cap / w as per from i),
l as (select *, (1.5 * sum(source_size) over () - coalesce(sum(cap) over (order by per, i rows between unbounded preceding and 1 preceding), 0))
        / (sum(w) over () - coalesce(sum(w) over (order by per, i rows between unbounded preceding and 1 preceding), 0)) as level from p),
o as (select *, (select arg_min(level, per) from l where level <= per) as final from l),
t as (select source, source_size, round(least(case when level <= per then w * coalesce(final, per) else cap end, cap), 6) as target from o),
h as (select d.*, t.source_size, t.target, floor(target / source_size)::bigint as copies, target - floor(target / source_size) * source_size as left_over,
        sum(size) over (partition by d.source order by place range between unbounded preceding and current row) as upto,
        sum(size) over (partition by d.source, place) as n from d join t on d.source is not distinct from t.source),
c as (select *, case when source_size = 0 then 0 else least(2, copies + case when upto <= left_over and n > 0 then 1 when upto - n <= left_over and upto - left_over < left_over - (upto - n) then 1
        when n = 0 and upto - n <= left_over then 1 else 0 end) end::bigint as k from h)
select doc_id, size, source_size, target, k * size as taken, source, k as copies from c
"""


@query("op6_hash_threshold_mix", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
