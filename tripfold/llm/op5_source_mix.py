"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by hash) and queued, up to REPEATS times over. A copy's virtual
finish time is its source's cumulative size up to and with it, divided by the source's target. All
copies are sorted by finish time over the whole corpus (range partitions), and the mix is the longest
beginning whose sizes fit the budget. At virtual time 1 each source has given its target, so each ends
within about a document of it.

Cumulative sums are two-level: a source is cut into slices by hash, about SLICE rows each; slices are
summed first and added up per source, then rows within a slice. So no task holds a whole source. The
final sum is two-level as well: range partitions, then rows within one.

Cases: a null text has size 0; a null source is a source of its own, the last; documents of size 0 take
nothing; a source of size 0 has target 0; repeated rows are documents of their own, but give the same
result, so they are told apart by nothing but their number; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripfold.llm.common import MARKS, lean, shuffle_parts, stored, with_marks

WEIGHTS = (1, 2, 3)  # of the sources in code-point order, repeating
REPEATS = 3  # a document is taken so often at most
SLICE = 10_000  # rows of a slice
SEED = 17


def with_size(docs: DataFrame) -> DataFrame:
    """docs and _size, the number of words [^\\x20\\x09-\\x0D]+ of the text."""
    return docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def targets(sized: DataFrame) -> DataFrame:
    """_source, source_size and target for each source of sized(_source, _size).

    Targets share the total by weight, none above REPEATS times its source's size: target =
    min(REPEATS * size, level * weight), the level found by raising it until the shares add up.
    """
    spark = sized.sparkSession
    sizes = stored(sized.groupBy("_source").agg(F.sum("_size").alias("source_size")))
    # place of each source in code-point order: places within range parts, after the parts before
    parts = stored(sizes.repartitionByRange(shuffle_parts(spark), F.col("_source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before, at = {}, 0
    for r in parts.groupBy("_part").count().orderBy("_part").collect():  # a row for each range part
        before[r["_part"]], at = at, at + r["count"]
    offset = F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_source").asc_nulls_last())) - 1 + offset[F.col("_part")]
    weighed = stored(
        parts.withColumn("_weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double"))
        .select("_source", "source_size", "_weight")
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, REPEATS * F.col("source_size")
    while True:
        full = cap <= F.lit(level) * F.col("_weight")
        r = weighed.agg(F.sum(F.when(full, cap).otherwise(0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("open")).first()
        new = (total - r["fixed"]) / r["open"] if r["open"] else level
        if new <= level:
            break
        level = new
    return weighed.select("_source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("_weight")).alias("target"))


def queue(docs: DataFrame, marks: tuple = ()) -> DataFrame:
    """doc_id, _source, _size, the columns `marks`, source_size, target and _n: a row per document of the mix,
    _n telling how often the mix takes it (0 to REPEATS)."""
    spark = docs.sparkSession
    given = stored(
        with_size(docs).select("doc_id", F.col("source").alias("_source"), "_size", *marks)
        .withColumn("_hash", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 1))
    )
    goal = targets(given.select("_source", "_size"))
    slices = max(1, -(-given.count() // SLICE))
    # the slice's number has the order of the hash (63 bits, not negative)
    cut = given.withColumn("_slice", F.shiftright(F.shiftright("_hash", 32) * slices, 31))
    sums = cut.groupBy("_source", "_slice").agg(F.sum("_size").alias("_sum"))
    over = Window.partitionBy("_source").orderBy("_slice")
    sums = sums.withColumn("_before", F.sum("_sum").over(over) - F.col("_sum"))
    sums = sums.join(goal.withColumnRenamed("_source", "_goal_source"), F.col("_source").eqNullSafe(F.col("_goal_source"))).drop("_goal_source", "_sum")
    rows = (
        cut.alias("c").join(sums.alias("s"), F.col("c._source").eqNullSafe(F.col("s._source")) & (F.col("c._slice") == F.col("s._slice")))
        .select("c.doc_id", "c._source", "c._size", *[f"c.{m}" for m in marks], "c._hash", "c._slice", "s._before", "s.source_size", "s.target")
    )
    within = Window.partitionBy("_source", "_slice").orderBy("_hash", "doc_id", "_size", *marks)
    rows = rows.withColumn("_place", F.row_number().over(within)).withColumn("_sum", F.col("_before") + F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = stored(rows)
    copies = (
        rows.where("_size > 0 and target > 0").withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
        .withColumn("_finish", (F.col("_round") * F.col("source_size") + F.col("_sum")) / F.col("target"))
    )
    order = ["_finish", "_hash", "doc_id", "_source", "_place", "_round"]
    sorted_ = stored(copies.repartitionByRange(shuffle_parts(spark), *order).withColumn("_part", F.spark_partition_id()).select("_part", "_size", "_slice", *order))
    budget = given.agg(F.sum("_size")).first()[0] or 0
    whole, last, at = [], None, 0
    for r in sorted_.groupBy("_part").agg(F.sum("_size").alias("n")).orderBy("_part").collect():  # a row for each range part
        if at + r["n"] > budget:
            last = r["_part"]
            break
        whole.append(r["_part"])
        at += r["n"]
    top = max(whole, default=-1)
    chosen = sorted_.where(F.col("_part") <= top)
    if last is not None:  # the one part in which the budget ends
        run = F.sum("_size").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        chosen = chosen.unionByName(sorted_.where(F.col("_part") == last).withColumn("_run", run + at).where(F.col("_run") <= budget).drop("_run"))
    key = ["_source", "_slice", "_place"]
    taken = chosen.groupBy(*key).agg(F.count("*").alias("_n"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in key]
    return (
        rows.alias("r").join(taken.alias("t"), same[0] & same[1] & same[2], "left")
        .select("r.doc_id", "r._source", "r._size", *[f"r.{m}" for m in marks], "r.source_size", "r.target", F.coalesce("t._n", F.lit(0)).alias("_n"))
    )


def source_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for each document."""
    return queue(docs).select("doc_id", F.col("_size").alias("size"), "source_size", F.round("target", 6).alias("target"), (F.col("_size") * F.col("_n")).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken. Rows are told apart by a hash of all their columns
    (128 bits), so that ids may be null or repeated; rows that are equal throughout are taken as often as all of
    them together."""
    marked = with_marks(docs)
    taken = queue(marked, MARKS).where("_n > 0").groupBy(*MARKS).agg(F.sum("_n").alias("_n"), F.count("*").alias("_equal"))
    rows = marked.join(taken.withColumnsRenamed({m: f"{m}_of" for m in MARKS}), F.expr(" and ".join(f"{m} = {m}_of" for m in MARKS)))
    # rows with others equal to them become one, which stands for all
    more = rows.where("_equal > 1").groupBy(*MARKS).agg(F.min(F.struct("_n", *docs.columns)).alias("_row")).select("_row.*")
    times = rows.where("_equal = 1").select("_n", *docs.columns).unionByName(more.select("_n", *docs.columns))
    return times.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select(docs.columns)


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return source_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
