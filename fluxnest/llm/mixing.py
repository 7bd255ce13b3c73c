"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a seeded random order and repeated at most max_repeats times, are a stream of
tokens that is cut into blocks of the same number of tokens at every size. Block j of a source of share w is
released at slot floor(j / w) and due at slot ceil((j + 1) / w); earliest deadline first fills every slot, so at
any time each source has less than one block more or less than its share. A document fills as many blocks as it
touches: it comes out as one row for each of them, so the rows keep that bound too. Running totals that place documents
in their stream are two-level: totals of hash buckets first, then sums inside a bucket, so no source is one task.

Shares are fractions n / period, so after period slots each source has exactly its n blocks and the schedule starts
again: one period and the rest after the last whole one give every slot by arithmetic. Periods above PERIOD aren't
used; then the schedule is cut into windows of WINDOW slots (more where a source has a smaller share than one block in
these), each written by a task of its own: before a window each source has done its share of the slots so far, rounded so that
the sum is right, which puts it less than two blocks off at any time.

Shares are weights over the sum of the weights of the sources that have tokens; sources that are absent, empty
or of weight zero get nothing and are reported with their target. The total is the largest for which no source needs
more than max_repeats of any document.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialise, release, small_enough
from .kmv import hash60

#: Tokens a block.
BLOCK = 256
#: Longest period that is repeated: a table of at most twice as many rows a mix, whatever the input's size.
PERIOD = 20_000
#: Slots that one task schedules where no period is repeated.
WINDOW = 50_000
#: Documents a hash bucket, about; one task sorts a bucket.
BUCKET = 200_000
#: Rows of targets at most: they and one total a listed source are kept on the driver. More are an error.
TARGETS = 100_000
#: Slots whose running totals one task adds up in the report.
CHUNK = 4096


def whole_parts(weights: dict[str, Fraction]) -> dict[str, int]:
    """The smallest whole numbers in proportion to the weights; their sum is the period."""
    common = math.lcm(*(w.denominator for w in weights.values()))
    parts = {s: int(w * common) for s, w in weights.items()}
    divisor = math.gcd(*parts.values())
    return {s: n // divisor for s, n in parts.items()}


def earliest_deadline_first(parts: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) by earliest deadline first among released blocks; a source's share is its part of all parts.

    A slot with no released block (sources that run out early leave some) is skipped over.
    """
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts) if blocks.get(s, 0) > 0]
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    time, slot = 0, 0
    while waiting or ready:
        if not ready and waiting and waiting[0][0] > time:
            time = waiting[0][0]
        while waiting and waiting[0][0] <= time:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[s]), s, j))
        _, s, j = heapq.heappop(ready)
        yield s, j, slot
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (max(time + 1, (j + 1) * period // parts[s]), s, j + 1))
        time += 1
        slot += 1


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of all blocks."""
    return list(earliest_deadline_first(whole_parts({s: Fraction(str(w)) for s, w in weights.items()}), blocks))


def done_before(parts: dict[str, int], slot: int) -> dict[str, int]:
    """Blocks of each source before a slot: its share of the slots, rounded up or down so that the sum is the number of slots."""
    period, before, out = sum(parts.values()), 0, {}
    for s in sorted(parts):
        out[s] = (before + parts[s]) * slot // period - before * slot // period
        before += parts[s]
    return out


def window(parts: dict[str, int], first: dict[str, int], last: dict[str, int], start: int) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of the blocks first to last (excluded) of each source, in the slots from start on, by earliest deadline first.

    Where no block is released, the next one to be comes early.
    """
    period = sum(parts.values())
    waiting = [(j * period // parts[s], s, j) for s, j in first.items() if j < last[s]]
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    slot = start
    while waiting or ready:
        while waiting and (waiting[0][0] <= slot or not ready):
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[s]), s, j))
        _, s, j = heapq.heappop(ready)
        yield s, j, slot
        if j + 1 < last[s]:
            heapq.heappush(waiting, ((j + 1) * period // parts[s], s, j + 1))
        slot += 1


def window_size(parts: dict[str, int], size: int) -> int:
    """Slots a window: so many that every source has a block in each, and size at least. Then no rounding takes a block back."""
    return max(size, -(-sum(parts.values()) // min(parts.values())))


def windows(parts: dict[str, int], blocks: dict[str, int], size: int) -> int:
    """How many windows a schedule has; the last one takes up to twice the slots."""
    return max(1, sum(blocks.values()) // window_size(parts, size))


def scheduled(parts: dict[str, int], blocks: dict[str, int], n: int, size: int) -> Iterator[tuple[str, int, int]]:
    """Window n of the schedule of all blocks."""
    count, size = windows(parts, blocks, size), window_size(parts, size)
    if count == 1:
        return earliest_deadline_first(parts, blocks)
    return window(parts, done_before(parts, n * size), blocks if n == count - 1 else done_before(parts, (n + 1) * size), n * size)


def slot_table(spark: SparkSession, mixes: dict[int, tuple[dict[str, int], dict[str, int], bool]], size: int | None = None) -> DataFrame:
    """(mix_id, source, rest, k, slot): block k of a period (rest 0) or after the last whole period (rest 1); a task a window.

    mixes: the parts of each mix, its blocks after the last whole period and whether it has whole periods.
    """
    size = WINDOW if size is None else size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, text, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                parts, left, repeated = json.loads(text)
                for rest, rows in ((0, earliest_deadline_first(parts, parts if repeated and n == 0 else {})), (1, scheduled(parts, left, n, size))):
                    while some := list(islice(rows, 50_000)):
                        names, ks, slots = zip(*some)
                        k = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array([m] * k, pa.int64()), pa.array(names), pa.array([rest] * k, pa.int32()), pa.array(ks, pa.int64()), pa.array(slots, pa.int64())], names=["mix_id", "source", "rest", "k", "slot"])

    counts = {m: windows(parts, left, size) for m, (parts, left, _) in mixes.items()}
    specs = spark.createDataFrame([(m, json.dumps(x), counts[m] - 1) for m, x in mixes.items()], "mix_id bigint, spec string, last bigint")
    each = specs.select("mix_id", "spec", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("n")).repartition(min(sum(counts.values()), 10_000))
    return materialise(each.mapInArrow(run, "mix_id bigint, source string, rest int, k bigint, slot bigint"), "slots")


def plan(targets: list[dict], totals: dict[str, int], min_block: int = BLOCK, period: int = PERIOD) -> list[dict]:
    """Share, quota, block size, part of the period and whole periods of every (mix, source) that can supply; targets are rows of mix_targets."""
    out = []
    for mix in sorted({t["mix_id"] for t in targets if t["mix_id"] is not None}):
        merged: dict[str, dict] = {}
        for t in targets:
            if t["mix_id"] == mix and t["source"] is not None and (t["target_weight"] or 0) > 0 and (t["max_repeats"] or 0) > 0 and totals.get(t["source"], 0) > 0:
                m = merged.setdefault(t["source"], {"weight": 0.0, "exact": Fraction(0), "max_repeats": 0})
                m["weight"] += t["target_weight"]
                m["exact"] += Fraction(str(t["target_weight"]))
                m["max_repeats"] = max(m["max_repeats"], t["max_repeats"])
        if not merged:
            continue
        weight = sum(m["weight"] for m in merged.values())
        size = math.floor(min(totals[s] * m["max_repeats"] / (m["weight"] / weight) for s, m in merged.items()) + 1e-6)
        quotas = {s: int(round(size * (m["weight"] / weight))) for s, m in merged.items()}
        parts = whole_parts({s: m["exact"] for s, m in merged.items()})
        length = sum(parts.values())
        periods = min(-(-quotas[s] // min_block) // n for s, n in parts.items()) if length <= period else 0
        for s, m in merged.items():
            out.append({"mix_id": mix, "source": s, "share": m["weight"] / weight, "quota": quotas[s], "block": min_block, "part": parts[s], "period": length, "periods": periods, "max_repeats": int(m["max_repeats"]), "available": totals[s]})
    return out


def stream_places(sizes: DataFrame, seed: int, bucket: int = BUCKET) -> DataFrame:
    """doc_id, source, n_tokens and start: the tokens of the source that come before the document in its random order."""
    keyed = sizes.withColumn("h", hash60(F.concat_ws("/", F.lit(seed).cast("string"), "source", F.col("doc_id").cast("string"))))
    per = sizes.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / bucket)).cast("bigint").alias("n_buckets"))
    keyed = keyed.join(broadcast_if_small(per), "source").withColumn("bucket", F.pmod("h", "n_buckets"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    offsets = sums.select("source", "bucket", F.expr("sum(tokens) over (partition by source order by bucket rows between unbounded preceding and current row) - tokens").alias("offset"))
    inner = F.expr("sum(n_tokens) over (partition by source, bucket order by h, doc_id rows between unbounded preceding and current row) - n_tokens")
    return keyed.withColumn("inner", inner).join(broadcast_if_small(offsets), ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("offset") + F.col("inner")).alias("start"))


def prepare(sizes: DataFrame, targets: DataFrame, seed: int, min_block: int, period: int) -> tuple[list[dict], DataFrame | None]:
    """The plan of every (mix, source) that can supply, and the selected documents: mix_id, source, doc_id, repeat, n_tokens, at (where it begins in the source's stream)."""
    spark = sizes.sparkSession
    if not small_enough(targets, TARGETS):
        raise ValueError(f"more than {TARGETS} targets")
    sizes = sizes.select("doc_id", "source", "n_tokens").filter(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    sizes = materialise(sizes.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), "sizes")
    totals = {r["source"]: r["tokens"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}  # one row a listed source
    shares = plan([r.asDict() for r in targets.collect()], totals, min_block, period)
    if not shares:
        return [], None
    rows = [(p["mix_id"], p["source"], p["quota"], p["max_repeats"], p["available"]) for p in shares]
    plan_df = spark.createDataFrame(rows, "mix_id bigint, source string, quota bigint, max_repeats bigint, available bigint")
    placed = stream_places(sizes, seed).join(F.broadcast(plan_df), "source")  # as many rows as targets
    # Copy r starts r rounds after the first; only copies whose first half fits the quota.
    room = F.floor((F.col("quota") - F.col("start") - F.col("n_tokens") / 2) / F.col("available")) + 1
    copies = F.least(F.col("max_repeats"), F.greatest(F.lit(0), room)).cast("bigint")
    taken = placed.withColumn("copies", copies).filter("copies > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return shares, taken.select("mix_id", "source", "doc_id", "repeat", "n_tokens", (F.col("start") + F.col("repeat") * F.col("available")).alias("at"))


def interleave(documents: DataFrame, shares: list[dict]) -> DataFrame:
    """The selected documents cut by the blocks they touch, each part in the slot of its block. What hangs over the last block stays in it."""
    spark = documents.sparkSession
    mixes = {}
    for m in sorted({p["mix_id"] for p in shares}):
        own = [p for p in shares if p["mix_id"] == m]
        mixes[m] = ({p["source"]: p["part"] for p in own}, {p["source"]: -(-p["quota"] // p["block"]) - p["periods"] * p["part"] for p in own}, own[0]["periods"] > 0)
    # Parts of a period that isn't repeated may be of any size and aren't needed below.
    rows = [(p["mix_id"], p["source"], p["block"], -(-p["quota"] // p["block"]) - 1, p["periods"], *((p["part"], p["period"]) if p["periods"] else (1, 1))) for p in shares]
    plan_df = F.broadcast(spark.createDataFrame(rows, "mix_id bigint, source string, block bigint, last bigint, periods bigint, part bigint, period bigint"))
    slots = slot_table(spark, mixes).withColumnRenamed("slot", "slot_in")
    block_of = lambda at: F.least(F.floor(at / F.col("block")), F.col("last")).cast("bigint")
    end = F.col("at") + F.col("n_tokens")
    cut = documents.join(plan_df, ["mix_id", "source"]).withColumn("j", F.explode(F.sequence(block_of(F.col("at")), block_of(end - 1))))
    cut = cut.withColumn("from", F.greatest(F.col("at"), F.col("j") * F.col("block"))).withColumn("to", F.when(F.col("j") == F.col("last"), end).otherwise(F.least(end, (F.col("j") + 1) * F.col("block"))))
    whole = F.col("periods") * F.col("part")
    cut = cut.withColumn("rest", (F.col("j") >= whole).cast("int"))
    cut = cut.withColumn("k", F.when(F.col("rest") == 0, F.col("j") % F.col("part")).otherwise(F.col("j") - whole))
    before = F.when(F.col("rest") == 0, F.floor(F.col("j") / F.col("part"))).otherwise(F.col("periods")) * F.col("period")
    out = cut.join(broadcast_if_small(slots), ["mix_id", "source", "rest", "k"])
    return out.select("mix_id", (before + F.col("slot_in")).cast("bigint").alias("slot"), (F.col("from") - F.col("j") * F.col("block")).alias("offset"), "source", "doc_id", "repeat", (F.col("from") - F.col("at")).alias("first"), (F.col("to") - F.col("from")).alias("n_tokens"))


_PARTS = "mix_id bigint, slot bigint, offset bigint, source string, doc_id bigint, repeat bigint, first bigint, n_tokens bigint"
_DOCUMENTS = "mix_id bigint, source string, doc_id bigint, repeat bigint, n_tokens bigint"


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7, min_block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """(mix_id, slot, offset, source, doc_id, repeat, first, n_tokens): the selection, ordered within a mix by slot and offset.

    A row is the part of a document that lies in one block: its n_tokens tokens from the document's token first on; a
    document's parts are all there. At any row each source is less than two blocks, and at the very end half a document, off
    its share of the tokens so far. sizes: (doc_id, source, n_tokens). Rows with a null source or no tokens are never selected.
    A document is taken if at least half of it lies within the source's quota, so a source is off its share by less than a
    document. Empty tables give no rows; other columns of either table are ignored; a source listed twice in a mix has the
    sum of its weights and the larger max_repeats.
    """
    shares, documents = prepare(sizes, targets, seed, min_block, period)
    return interleave(documents, shares) if shares else sizes.sparkSession.createDataFrame([], _PARTS)


def select_documents(sizes: DataFrame, targets: DataFrame, seed: int = 7, min_block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """(mix_id, source, doc_id, repeat, n_tokens): the documents that mix takes, uncut."""
    shares, documents = prepare(sizes, targets, seed, min_block, period)
    return documents.drop("at") if shares else sizes.sparkSession.createDataFrame([], _DOCUMENTS)


def deviations(parts: DataFrame, aims: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(mix_id, source, largest_deviation): tokens by which a source is at most off its aim times all tokens so far, before and after any row.

    Running totals are two-level, over chunks of slots and within a chunk; aims: (mix_id, source, aim_share).
    """
    own = parts.select("mix_id", "source", "slot", "offset", F.col("n_tokens").alias("n"), F.floor(F.col("slot") / chunk).alias("chunk"))
    sums = own.groupBy("mix_id", "chunk", "source").agg(F.sum("n").alias("n"))
    every = sums.groupBy("mix_id", "chunk").agg(F.sum("n").alias("n")).select("mix_id", "chunk", F.expr("sum(n) over (partition by mix_id order by chunk rows between unbounded preceding and current row) - n").alias("all_base"))
    base = sums.select("mix_id", "chunk", "source", F.expr("sum(n) over (partition by mix_id, source order by chunk rows between unbounded preceding and current row) - n").alias("own_base"))
    base = base.join(every, ["mix_id", "chunk"]).join(F.broadcast(aims), ["mix_id", "source"])  # aims: as many rows as targets
    run = own.select("*", F.expr("sum(n) over (partition by mix_id, chunk order by slot, offset rows between unbounded preceding and current row)").alias("all_run"), F.expr("sum(n) over (partition by mix_id, chunk, source order by slot, offset rows between unbounded preceding and current row)").alias("own_run"))
    run = run.join(base, ["mix_id", "chunk", "source"])
    so_far, total = F.col("own_base") + F.col("own_run"), F.col("all_base") + F.col("all_run")
    off = F.greatest(F.abs(so_far - F.col("aim_share") * total), F.abs(so_far - F.col("n") - F.col("aim_share") * (total - F.col("n"))))
    return run.groupBy("mix_id", "source").agg(F.max(off).alias("largest_deviation"))


def shares_of(documents: DataFrame, targets: DataFrame, shares: list[dict]) -> DataFrame:
    """Target, aim and actual share of every row of targets that names a mix, those that got nothing included.

    target_share is the weight over all weights of the mix; aim_share the weight over those of the sources that can supply.
    """
    targets = targets.select("mix_id", "source", "target_weight", "max_repeats")
    aims = documents.sparkSession.createDataFrame([(p["mix_id"], p["source"], p["share"]) for p in shares], "mix_id bigint, source string, aim_share double")
    got = documents.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"), (F.max("repeat") + 1).alias("repeats_used"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    weights = targets.groupBy("mix_id").agg(F.sum(F.when(F.col("target_weight") > 0, F.col("target_weight"))).alias("weights"))
    t = targets.join(weights, "mix_id").join(F.broadcast(aims), ["mix_id", "source"], "left").join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return t.select("mix_id", "source", "max_repeats", (F.col("target_weight") / F.col("weights")).alias("target_share"), F.coalesce("aim_share", F.lit(0.0)).alias("aim_share"), F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("n_rows"), zero("repeats_used"))


def document_shares(sizes: DataFrame, targets: DataFrame, seed: int = 7, min_block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """shares_of the selected documents, without the order they come in."""
    shares, documents = prepare(sizes, targets, seed, min_block, period)
    return shares_of(documents if shares else sizes.sparkSession.createDataFrame([], _DOCUMENTS), targets, shares)


def report(sizes: DataFrame, targets: DataFrame, seed: int = 7, min_block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """document_shares and largest_deviation, in tokens, over all prefixes of the mix's rows, beside the block's size; 0 where nothing was taken."""
    spark = sizes.sparkSession
    shares, documents = prepare(sizes, targets, seed, min_block, period)
    if not shares:
        return shares_of(spark.createDataFrame([], _DOCUMENTS), targets, []).withColumn("largest_deviation", F.lit(0.0)).withColumn("block", F.lit(min_block).cast("bigint"))
    documents = materialise(documents, "documents")
    parts = materialise(interleave(documents, shares), "parts")
    aims = spark.createDataFrame([(p["mix_id"], p["source"], p["share"]) for p in shares], "mix_id bigint, source string, aim_share double")
    off = materialise(deviations(parts, aims), "deviations")
    release(parts)
    out = shares_of(documents, targets, shares).join(off, ["mix_id", "source"], "left")
    return out.withColumn("largest_deviation", F.coalesce("largest_deviation", F.lit(0.0))).withColumn("block", F.lit(min_block).cast("bigint"))
