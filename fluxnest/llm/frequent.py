"""Most frequent values by code-based identification.

Each value's 64-bit fingerprint is written as eight bytes and extended by four parity bytes of a
maximum-distance code over GF(256). Values are hashed to groups, a few times over; a group counts
each half-byte symbol at each position of its members' code words. A value that dominates its group
shows as the heaviest symbol at every position; up to two wrong bytes are corrected. Decoded
candidates are then counted exactly.

Memory is fixed: repeats x groups x 24 x 16 counters a column, whatever the data; tasks send them as narrow as they go. A missing frequent
value would leave a group's total unexplained in every repeat; while that is so, the rows of those groups
are sketched again with new hashes and twice the groups, so the result is complete.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, PARITY = 8, 4
WORD = DATA + PARITY
GROUPS, REPEATS = 1024, 3
_SCHEMA = pa.schema([("field", pa.string()), ("rep", pa.int32()), ("grp", pa.int32()), ("counts", pa.binary())])
#: Groups whose counters travel together.
BUNDLE = 16
#: Distinct fingerprints a block that are counted at a time; bounds memory.
BLOCK = 1_000_000


@lru_cache(None)
def _field() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms of GF(256) with the polynomial x^8 + x^4 + x^3 + x^2 + 1."""
    power, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x = x << 1 ^ (0x11D if x & 128 else 0)
    return power, log


def gf_mul(a, b):
    power, log = _field()
    return np.where((np.asarray(a) == 0) | (np.asarray(b) == 0), 0, power[log[a] + log[b]])


def gf_inv(a: int) -> int:
    power, log = _field()
    return int(power[255 - log[a]])


@lru_cache(None)
def generator() -> np.ndarray:
    """WORD x DATA: identity over a Cauchy matrix, so any DATA rows can be inverted."""
    cauchy = [[gf_inv((DATA + j) ^ i) for i in range(DATA)] for j in range(PARITY)]
    return np.vstack([np.eye(DATA, dtype=np.int64), np.array(cauchy, np.int64)])


@lru_cache(None)
def _products() -> np.ndarray:
    """PARITY x DATA x 256: products of each coefficient with each byte."""
    g = generator()[DATA:]
    return gf_mul(g[:, :, None], np.arange(256)[None, None, :]).astype(np.uint8)


def encode(fp: np.ndarray) -> np.ndarray:
    """n x WORD code words of 64-bit fingerprints."""
    data = np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(-1, DATA)
    t = _products()
    parity = np.zeros((len(data), PARITY), np.uint8)
    for j in range(PARITY):
        for i in range(DATA):
            parity[:, j] ^= t[j, i][data[:, i]]
    return np.hstack([data, parity])


@lru_cache(None)
def _inverse(rows: tuple[int, ...]) -> np.ndarray:
    """Inverse of the generator's given rows by elimination."""
    a = np.hstack([generator()[list(rows)], np.eye(DATA, dtype=np.int64)])
    for c in range(DATA):
        p = next(r for r in range(c, DATA) if a[r, c])
        a[[c, p]] = a[[p, c]]
        a[c] = gf_mul(a[c], gf_inv(int(a[c, c])))
        for r in range(DATA):
            if r != c and a[r, c]:
                a[r] ^= gf_mul(a[c], int(a[r, c]))
    return a[:, DATA:]


def decode(word: np.ndarray, trust: np.ndarray) -> int | None:
    """The fingerprint whose code word differs from word in at most two bytes; trust orders the bytes."""
    order = np.argsort(-trust, kind="stable")
    for left_out in combinations(range(WORD - 1, -1, -1), PARITY):
        rows = tuple(sorted(int(order[i]) for i in range(WORD) if i not in left_out))
        terms = gf_mul(_inverse(rows), word[list(rows)].astype(np.int64)[None, :])
        data = np.bitwise_xor.reduce(terms, axis=1).astype(np.uint8)
        fp = int(data.view("<u8")[0])
        if (encode(np.array([fp], np.uint64))[0] == word).sum() >= WORD - 2:
            return fp
    return None


def group_of(fp: np.ndarray, rep: int, groups: int, seed: int) -> np.ndarray:
    """Group of each fingerprint: a 64-bit mix, different for every repeat and seed."""
    with np.errstate(over="ignore"):
        x = fp.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + rep + 64 * seed)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(groups)).astype(np.int64)


#: For each field the rounds before: seed, number of groups, and the open groups of each repeat.
Only = dict[str, list[tuple[int, int, list[set[int]]]]]


def still_open(fp: np.ndarray, rounds: list[tuple[int, int, list[set[int]]]]) -> np.ndarray:
    """Which fingerprints lie in an open group of every repeat of every round."""
    keep = np.ones(len(fp), bool)
    for seed, groups, opened in rounds:
        for rep, some in enumerate(opened):
            keep &= np.isin(group_of(fp, rep, groups, seed), list(some))
    return keep


def pack(counts: np.ndarray) -> bytes:
    """Counters of BUNDLE groups in the fewest bytes each that hold the largest, deflated, after a byte that says how many."""
    top = int(counts.max())
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64).reshape(-1, 2 * WORD, 16)


def _count(fields: list[str], groups: int, repeats: int, seed: int, only: "Only"):
    """Counters of one task; only limits the rows to those that the rounds before left open."""

    def add(table: np.ndarray, fp: np.ndarray, n: np.ndarray) -> None:
        words = encode(fp)
        halves = np.stack([words >> 4, words & 15], axis=2).reshape(len(fp), 2 * WORD)
        for rep in range(repeats):
            g = group_of(fp, rep, groups, seed) * 16
            for pos in range(2 * WORD):
                table[rep, :, pos, :] += np.bincount(g + halves[:, pos], n, groups * 16).astype(np.int64).reshape(groups, 16)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {f: np.zeros((repeats, groups, 2 * WORD, 16), np.int64) for f in fields}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {f: [] for f in fields}

        def settle(f: str) -> None:
            if not held[f]:
                return
            fp, n = (np.concatenate(x) for x in zip(*held[f]))
            fp, at = np.unique(fp, return_inverse=True)
            add(tables[f], fp, np.bincount(at, n, len(fp)))
            held[f] = []

        for b in batches:
            for f in fields:
                fp = b.column(f).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
                fp = fp[still_open(fp, only.get(f, []))]
                if len(fp):
                    held[f].append(np.unique(fp, return_counts=True))
                    if sum(len(x) for x, _ in held[f]) >= BLOCK:
                        settle(f)
        for f in fields:
            settle(f)
            for rep in range(repeats):
                some = np.unique(np.flatnonzero(tables[f][rep, :, 0, :].any(axis=1)) // BUNDLE)
                if len(some):
                    blobs = [pack(tables[f][rep, g * BUNDLE : (g + 1) * BUNDLE]) for g in some]
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(some)), pa.array([rep] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], schema=_SCHEMA)

    return run


def read_group(counts: np.ndarray, least: float) -> set[int]:
    """Fingerprints that a group's counters spell: by the heaviest symbols, and by the second ones where they are heavy too."""
    order = np.argsort(counts, axis=1)
    top, second = order[:, -1], order[:, -2]
    at = np.arange(len(counts))
    weight, other = counts[at, top], counts[at, second]
    found = set()
    for symbols, trust in ((top, weight - other), (np.where(other >= least / 2, second, top), np.minimum(np.abs(other - least / 2), np.abs(weight - other)))):
        word = (symbols[0::2] << 4 | symbols[1::2]).astype(np.uint8)
        fp = decode(word, np.minimum(trust[0::2], trust[1::2]).astype(float))
        if fp is not None:
            found.add(fp)
    return found


def _decode_groups(least: float):
    schema = pa.schema([("field", pa.string()), ("rep", pa.int32()), ("grp", pa.int32()), ("total", pa.int64()), ("fp", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for b in batches:
            for f, rep, g, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                counts, key = unpack(blob), (f, rep, g)
                if key in sums:
                    sums[key] += counts
                else:
                    sums[key] = counts
        rows = []
        for (f, rep, g), counts in ((k, c) for (f, rep, bundle), many in sums.items() for k, c in (((f, rep, bundle * BUNDLE + i), c) for i, c in enumerate(many))):
            total = int(counts[0].sum())
            if total < least:
                continue
            fps = read_group(counts, least)
            for fp in fps or [None]:
                if fp is None:
                    rows.append((f, rep, g, total, None, None))
                else:
                    w = encode(np.array([fp], np.uint64))[0]
                    s = np.stack([w >> 4, w & 15], axis=1).reshape(-1)
                    rows.append((f, rep, g, total, int(np.array(fp, np.uint64).view(np.int64)), int(counts[np.arange(2 * WORD), s].min())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.types[i]) for i in range(len(schema))], schema=schema)

    return run


def heavy_values(df: DataFrame, fields: list[str], share: float, groups: int = GROUPS, repeats: int = REPEATS, max_rounds: int = 8) -> DataFrame:
    """(field, item, n, n_upper): values of string columns found in at least share of all rows.

    Two passes a round, one that sketches and one that counts the decoded values; the number of rows is the file footers'.

    n is exact, n_upper the sketch's count before the exact pass (never below n for a value's first sketch).
    Nulls and empty strings never count, though their rows count for the share. With fewer than 2 / share groups more
    rounds are needed. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    out = "field string, item string, n bigint, n_upper bigint"
    total = df.count()
    if not total:
        return spark.createDataFrame([], out)
    least = share * total
    prints = df.select(*(F.when(F.col(f) != "", F.xxhash64(f)).alias(f) for f in fields))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in fields))).alias("x")).select("x.*").filter(F.col("item") != "").withColumn("fp", F.xxhash64("item"))
    only: Only = {}
    active, upper = list(fields), {}
    exact: dict[tuple[str, int], int] = {}
    heavy: list[tuple[str, str, int, int]] = []
    for seed in range(max_rounds):
        counters = prints.select(*active).mapInArrow(_count(active, groups, repeats, seed, only), "field string, rep int, grp int, counts binary")
        # grp is a bundle of groups here. At most fields x repeats x groups x 2 rows come back, whatever the data.
        seen = counters.repartition("field", "rep", "grp").mapInArrow(_decode_groups(least), "field string, rep int, grp int, total bigint, fp bigint, low bigint").collect()
        fresh = []
        for r in seen:
            if r.fp is not None:
                if (r.field, r.fp) not in upper:
                    fresh.append((r.field, r.fp))
                upper[r.field, r.fp] = min(upper.get((r.field, r.fp), r.low), r.low)
        if fresh:
            wanted = F.broadcast(spark.createDataFrame(fresh, "field string, fp bigint"))
            by_item = long.join(wanted, ["field", "fp"]).groupBy("field", "fp", "item").agg(F.count(F.lit(1)).alias("n"))
            # Values that share a fingerprint are told apart here; of each fingerprint at most 1 / share are heavy.
            of_print = by_item.groupBy("field", "fp").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") >= least, F.struct("item", "n"))).alias("heavy"))
            for r in of_print.collect():
                exact[r.field, r.fp] = r.n
                heavy += [(r.field, x.item, x.n, upper[r.field, r.fp]) for x in r.heavy]
        still = []
        for f in active:
            opened: list[set[int]] = []
            known = [(fp, n) for (g, fp), n in exact.items() if g == f]
            fps = np.array([fp for fp, _ in known], np.int64).view(np.uint64)
            keep = still_open(fps, only.get(f, []))  # values outside the rows sketched this round explain nothing
            fps, known = fps[keep], [x for x, k in zip(known, keep) if k]
            for rep in range(repeats):
                rest = {r.grp: r.total for r in seen if r.field == f and r.rep == rep}
                for g, (_, n) in zip(group_of(fps, rep, groups, seed), known):
                    if int(g) in rest:
                        rest[int(g)] -= n
                opened.append({g for g, n in rest.items() if n >= least})
            if all(opened):
                only.setdefault(f, []).append((seed, groups, opened))
                still.append(f)
        active, groups = still, 2 * groups
        if not active:
            break
    else:
        raise ValueError(f"groups stayed unexplained after {max_rounds} rounds")
    return spark.createDataFrame(heavy, out)
