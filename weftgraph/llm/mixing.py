"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents, in a fixed pseudo-random order, are cut into blocks. With a source's share w of all weights,
its block b (from 0) may run from slot floor(b / w) on and must have run before slot ceil((b + 1) / w); earliest deadline
first over these windows, ties to the smaller source, keeps every source within one block of its share at every slot
while all sources last. Shares are exact fractions of whole numbers (see `_shares`): nothing is rounded to a period, so
the bound does not wear out with the length of the schedule.

The schedule is worked out in segments of SEGMENT slots, in parallel. Which blocks run in a segment depends on the past
only through the blocks that are released and still wait at its beginning. Earliest deadline first runs, of any jobs
released by then, the set that is best by deadline (a greedy basis of the sets that fit), and jobs that wait at the
beginning fit anywhere in the segment. So:

1. Each segment schedules the jobs released in it alone and reports how many of them are due by its end, which others
   ran, and which are left.
2. Reports of FAN neighbours are merged into one, level by level, and the waiting jobs at every segment's beginning are
   handed down again: of the jobs that are not due by the end, those of least deadline take the slots that the due ones
   leave. A report holds a few jobs a source.
3. Each segment schedules its own and its waiting jobs.

Work is in proportion to the slots, times the jobs of a segment and the sources. Positions of documents in their source
come from counts of (source, bucket) and row numbers inside a bucket, so a source with a third of all rows is spread
over BUCKETS tasks.

Every document stays. The first slot that a source which has run out would take ends the part on target; what is left
follows by deadline, without gaps, and has ``on_target`` false.

Cases: a null source is mixed as the source ''; a null id counts as 0 in the order; of repeated rows each takes its own
place; an empty table gives an empty result; columns named like the results are replaced; texts are never read.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import few, staged

BLOCK_DOCS = 16
SEGMENT = 128
FAN = 64
BUCKETS = 1024
#: Default weights are floor(sqrt(documents) * ROOT_SCALE).
ROOT_SCALE = 1 << 20
#: Given weights are taken exactly if their common denominator makes them sum up to less, else in units of the largest / 2^50.
WHOLE_SUM = 1 << 62
#: Fixed values of the multiplicative congruential order: modulus 2^31 - 1 and multiplier 48271.
MODULUS, MULTIPLIER = 2147483647, 48271
_RESULT = ("block", "place", "release", "deadline", "slot", "on_target")
_JOBS = "array<struct<deadline: bigint, source: string, release: bigint, block: bigint>>"


def source_key(source_col: str = "source") -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers, one at least, in the proportions of the weights."""
    exact = {k: Fraction(v) for k, v in weights.items()}
    unit = Fraction(math.gcd(*(x.numerator for x in exact.values())), math.lcm(*(x.denominator for x in exact.values())))
    if sum(exact.values()) / unit >= WHOLE_SUM:
        unit = max(exact.values()) / (1 << 50)
    return {k: max(1, round(x / unit)) for k, x in exact.items()}


def _shares(sizes: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """sizes plus weight, a whole number, one at least."""
    if weights is None:
        return sizes.withColumn("weight", F.greatest(F.floor(F.sqrt(F.col("docs").cast("double")) * ROOT_SCALE), F.lit(1).cast("long")))
    whole = whole_weights(weights)
    given = sizes.sparkSession.createDataFrame(list(whole.items()), "source string, weight long")
    return sizes.join(given, "source", "left").fillna(min(whole.values()), ["weight"])


def _windows(jobs: DataFrame, total: int) -> DataFrame:
    """jobs (source, weight, block) plus release and deadline."""
    at = f"cast(block as decimal(19, 0)) * cast({total} as decimal(19, 0))"
    after = f"cast(block + 1 as decimal(19, 0)) * cast({total} as decimal(19, 0))"
    whole = "cast(weight as decimal(19, 0))"
    return jobs.withColumns({"release": F.expr(f"({at}) div {whole}"), "deadline": F.expr(f"({after} + {whole} - 1) div {whole}")})


def _edf(jobs: str, begin: str, slots: int) -> str:
    """Earliest deadline first over `slots` slots from `begin`: struct(left, ran), ran: (slot, job). jobs are sorted."""
    first = "array_min(filter(transform(s.left, (x, i) -> if(x.release <= t, i, null)), i -> i IS NOT NULL))"
    return f"""
      aggregate(sequence({begin}, {begin} + {slots}L - 1),
        named_struct('left', {jobs}, 'ran', filter(transform({jobs}, x -> named_struct('slot', 0L, 'job', x)), x -> false)),
        (s, t) -> aggregate(array({first}), s, (a, i) -> if(i IS NULL, a, named_struct(
          'left', concat(slice(a.left, 1, i), slice(a.left, i + 2, size(a.left))),
          'ran', concat(a.ran, array(named_struct('slot', t, 'job', a.left[i])))))))"""


def _open(report: str, waiting: str, end: str) -> tuple[str, str, str]:
    """Of jobs waiting before a stretch that ends at `end`: those due by then, those not due with the stretch's own that
    ran, best first, and how many of these have a slot."""
    due = f"size(filter({waiting}, x -> x.deadline <= {end}))"
    rest = f"array_sort(concat(filter({waiting}, x -> x.deadline > {end}), {report}.used))"
    return due, rest, f"cast(greatest({report}.slots - {report}.due - {due}, 0) as int)"


def _merge(reports: DataFrame, fan: int) -> DataFrame:
    """One report for every `fan` neighbours."""
    due, rest, room = _open("r", "a.moved", "r.ending")
    step = f"""named_struct('ending', r.ending, 'slots', a.slots + r.slots,
      'due', cast(a.due + size(filter(a.used, x -> x.deadline <= r.ending)) + r.due + {due} as bigint),
      'used', concat(filter(a.used, x -> x.deadline > r.ending), slice({rest}, 1, {room})),
      'moved', concat(r.moved, slice({rest}, {room} + 1, size({rest}))))"""
    several = reports.groupBy((F.col("part") / fan).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("part", "report"))).alias("all"))
    return several.select("part", F.expr(f"aggregate(slice(all, 2, size(all)).report, all[0].report, (a, r) -> {step})").alias("report"))


def _hand_down(reports: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """(part, waiting) of every report from (part, waiting) of the merged ones."""
    _, rest, room = _open("r.report", "a.waiting", "r.report.ending")
    later = f"concat(r.report.moved, slice({rest}, {room} + 1, size({rest})))"
    several = reports.groupBy((F.col("part") / fan).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("part", "report"))).alias("all"))
    walked = several.join(above.withColumnRenamed("part", "up"), "up").select(
        F.expr(f"""
      aggregate(all, named_struct('waiting', waiting, 'seen', filter(transform(all, x -> named_struct('part', x.part, 'waiting', waiting)), x -> false)),
        (a, r) -> named_struct('waiting', {later}, 'seen', concat(a.seen, array(named_struct('part', r.part, 'waiting', a.waiting)))),
        a -> a.seen)""").alias("seen")
    )
    return walked.select(F.explode("seen").alias("x")).select("x.part", "x.waiting")


def _schedule(jobs: DataFrame, segments: int, segment: int, fan: int) -> DataFrame:
    """(slot, source, block) of earliest deadline first over segments * segment slots. jobs: source, block, release, deadline."""
    spark = jobs.sparkSession
    own = jobs.select(F.expr(f"release div {segment}").alias("part"), F.struct("deadline", "source", "release", "block").alias("job"))
    own = own.groupBy("part").agg(F.sort_array(F.collect_list("job")).alias("jobs"))
    every = spark.range(segments).select(F.col("id").alias("part")).join(own, "part", "left")
    every = staged(every.withColumn("jobs", F.expr(f"coalesce(jobs, cast(array() as {_JOBS}))")), "mix-segments")

    alone = every.select("part", F.expr(f"part * {segment} + {segment}").alias("ending"), F.expr(_edf("jobs", f"part * {segment}", segment)).alias("s"))
    report = f"""named_struct('ending', ending, 'slots', {segment}L, 'due', cast(size(filter(s.ran, x -> x.job.deadline <= ending)) as bigint),
      'used', filter(s.ran, x -> x.job.deadline > ending).job, 'moved', s.left)"""
    levels = [staged(alone.select("part", F.expr(report).alias("report")), "mix-reports")]
    n = segments
    while n > fan:
        levels.append(staged(_merge(levels[-1], fan), "mix-reports"))
        n = -(-n // fan)
    waiting = spark.range(1).select(F.col("id").alias("part"), F.expr(f"cast(array() as {_JOBS})").alias("waiting"))
    for reports in reversed(levels):
        waiting = staged(_hand_down(reports, waiting, fan), "mix-waiting")

    ready = every.join(waiting, "part").select("part", F.array_sort(F.concat("jobs", "waiting")).alias("jobs"))
    ran = ready.select(F.explode(F.expr(_edf("jobs", f"part * {segment}", segment))["ran"]).alias("r"))
    return ran.select("r.slot", "r.job.source", "r.job.block")


def mix_sources(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_docs: int = BLOCK_DOCS,
    segment: int = SEGMENT,
    fan: int = FAN,
    buckets: int = BUCKETS,
) -> DataFrame:
    """df plus block, place (in the block), release, deadline, slot and on_target.

    weights: target weight by source, any positive scale; None: the square root of the source's documents. Sources
    that weights does not name get the smallest named weight.
    """
    kept = [c for c in df.columns if c not in _RESULT]
    ident = F.coalesce(F.col(id_col), F.lit(0)).cast("long")
    # The row travels as one column, so that no name of its can clash.
    rows = df.select(F.struct(*kept).alias("_row"), F.col(id_col).alias("_id"), source_key(source_col).alias("_src"), ident.alias("_h"))
    rows = rows.withColumn("_h", (F.pmod("_h", F.lit(MODULUS)) * F.lit(MULTIPLIER)) % F.lit(MODULUS))
    rows = rows.withColumn("_bucket", F.col("_h") % buckets)

    counts = staged(rows.groupBy("_src", "_bucket").agg(F.count(F.lit(1)).alias("n")), "mix-buckets")
    earlier = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select(F.col("_src").alias("source"), "_bucket", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    sizes = counts.groupBy(F.col("_src").alias("source")).agg(F.sum("n").alias("docs"))
    shares = staged(_shares(sizes, weights).withColumn("blocks", F.expr(f"(docs + {block_docs} - 1) div {block_docs}")), "mix-shares")
    total, sources = shares.agg(F.sum("weight"), F.count(F.lit(1))).first()
    # The block that a source does not have any more is scheduled too; the first of them ends the part on target.
    missing = _windows(shares.select("source", "weight", F.col("blocks").alias("block")), total or 1)
    segments = -(-(missing.agg(F.min("deadline")).first()[0] or 0) // segment)

    starts = F.expr(f"sequence((before + {block_docs} - 1) div {block_docs}, (before + n - 1) div {block_docs})")
    some = parts.filter(f"(before + {block_docs} - 1) div {block_docs} <= (before + n - 1) div {block_docs}")
    have = some.select("source", F.explode(starts).alias("block")).join(few(shares.select("source", "weight"), sources), "source")
    jobs = staged(_windows(have, total or 1).select("source", "block", "release", "deadline"), "mix-jobs")
    early = jobs.unionByName(missing.select("source", "block", "release", "deadline")).filter(F.col("release") < segments * segment)
    ran = staged(_schedule(early, segments, segment, fan), "mix-slots")

    ends = few(shares.select("source", "blocks"), sources)
    horizon = ran.join(ends, "source").filter("block = blocks").agg(F.min("slot")).first()[0] or 0
    on_target = ran.filter(F.col("slot") < horizon)
    done = on_target.groupBy("source").agg((F.max("block") + 1).alias("done"))
    late = jobs.join(few(done, sources), "source", "left").filter("done IS NULL OR block >= done")
    late = staged(late.repartitionByRange("deadline", "source").select("source", "block", "deadline", F.spark_partition_id().alias("part")), "mix-late")
    # One row a partition of the range exchange.
    part_rows = late.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    part_rows = part_rows.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("deadline", "source"))
    late = late.withColumn("nth", nth).join(F.broadcast(part_rows), "part")
    slots = on_target.unionByName(late.select((F.lit(horizon) + F.col("first") + F.col("nth") - 1).alias("slot"), "source", "block"))

    # The slots of a bucket's blocks travel as one array, so documents are joined on the buckets they are ranked in.
    touched = parts.select("source", "_bucket", F.explode(F.expr(f"sequence(before div {block_docs}, (before + n - 1) div {block_docs})")).alias("block"))
    by_bucket = touched.join(slots, ["source", "block"]).groupBy("source", "_bucket")
    by_bucket = by_bucket.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("_slots"))
    by_bucket = parts.join(by_bucket, ["source", "_bucket"]).join(few(shares.select("source", "weight"), sources), "source")
    by_bucket = by_bucket.select(F.col("source").alias("_src"), "_bucket", F.col("before").alias("_before"), "weight", "_slots")

    nth = Window.partitionBy("_src", "_bucket").orderBy("_h", "_id")
    placed = rows.withColumn("_rn", F.row_number().over(nth)).join(by_bucket, ["_src", "_bucket"])
    placed = placed.withColumn("_pos", F.col("_before") + F.col("_rn") - 1).withColumn("block", F.expr(f"_pos div {block_docs}"))
    placed = placed.withColumn("slot", F.get("_slots", (F.col("block") - F.expr(f"_before div {block_docs}")).cast("int")))
    placed = _windows(placed, total or 1)
    return placed.select(*[F.col("_row")[c].alias(c) for c in kept], "block", (F.col("_pos") % block_docs).alias("place"), "release", "deadline", "slot", (F.col("slot") < horizon).alias("on_target"))


SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(source, '') AS src, coalesce(doc_id, 0) AS ident FROM documents),
h AS (
  SELECT doc_id, src, (((ident % {MODULUS}) + {MODULUS}) % {MODULUS} * {MULTIPLIER}) % {MODULUS} AS h FROM r),
p AS (
  SELECT doc_id, src, row_number() OVER (PARTITION BY src ORDER BY h % {BUCKETS}, h, doc_id) - 1 AS pos FROM h),
z AS (
  SELECT src, (count(*) + {BLOCK_DOCS - 1}) // {BLOCK_DOCS} AS blocks,
         CAST(greatest(floor(sqrt(count(*)::DOUBLE) * {ROOT_SCALE}), 1) AS HUGEINT) AS w FROM h GROUP BY src),
q AS (SELECT list(w ORDER BY src) AS w, list(src ORDER BY src) AS src, list(blocks ORDER BY src) AS blocks, sum(w)::HUGEINT AS total FROM z),
s AS (
  SELECT 0::BIGINT AS t, list_transform(w, lambda x: 0::HUGEINT) AS done, NULL::BIGINT AS pick, false AS over FROM q
  UNION ALL
  SELECT t + 1, list_transform(done, lambda c, i: CASE WHEN i = g THEN c + 1 ELSE c END), g, done[g] >= blocks[g]
  FROM (
    SELECT s.t, s.done, q.blocks, list_min(list_filter(list_transform(s.done, lambda c, i:
        CASE WHEN (c * q.total) // q.w[i] <= s.t
             THEN {{'d': ((c + 1) * q.total + q.w[i] - 1) // q.w[i], 'i': i}} END), lambda x: x IS NOT NULL)).i AS g
    FROM s, q WHERE NOT s.over)),
hz AS (SELECT min(t) - 1 AS horizon FROM s WHERE over),
o AS (
  SELECT q.src[pick] AS src, s.t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY s.t) - 1 AS block
  FROM s, q WHERE pick IS NOT NULL AND NOT over),
b AS (
  SELECT DISTINCT p.src, pos // {BLOCK_DOCS} AS block,
         CAST(((pos // {BLOCK_DOCS})::HUGEINT * total) // z.w AS BIGINT) AS release,
         CAST(((pos // {BLOCK_DOCS} + 1)::HUGEINT * total + z.w - 1) // z.w AS BIGINT) AS deadline
  FROM p JOIN z ON z.src = p.src, q),
x AS (
  SELECT b.*, coalesce(o.slot, horizon + row_number() OVER (PARTITION BY o.slot IS NULL ORDER BY deadline, b.src) - 1) AS slot
  FROM b LEFT JOIN o ON o.src = b.src AND o.block = b.block, hz)
SELECT p.doc_id, p.src AS source, x.block, pos % {BLOCK_DOCS} AS place, x.release, x.deadline, x.slot, x.slot < horizon AS on_target
FROM p JOIN x ON x.src = p.src AND x.block = pos // {BLOCK_DOCS}, hz
"""
