"""SimHash near-dedup by the generalised pigeonhole principle.

With m groups of bits and thresholds t_i (-1 and up) that sum to limit - m + 1, two fingerprints within `limit` bits
agree within t_i bits on some group i. Correlated bits share a group, so the groups differ in how much they tell
apart; a dynamic programme gives each group the threshold that makes the expected number of candidates smallest,
and -1 leaves a group out. Fingerprints are grouped by keys (a group's bits, with t_i of them masked out), compared
within the keys, and the links joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import connected_components, settle

#: Differing bits at which fingerprints link. links() relies on it being 2 where it uses shared neighbours.
LIMIT = 2
#: Fingerprints under one key that are compared with each other; the links of larger keys come from shared neighbours.
BUCKET = 4096

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ONES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None) -> int:
    """The 64 bits of a text's three-word shingles; 0 for a text without words or null."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not ws:
        return 0
    grams = map(b" ".join, zip(ws, ws[1:], ws[2:])) if len(ws) > 2 else [b" ".join(ws)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
    n = len(h)
    if n % 255:
        h = np.concatenate([h, np.zeros(255 - n % 255, np.uint64)])
    rows = h.reshape(-1, 255)
    out = 0
    for j in range(8):  # bit j of each byte: sums of up to 255 ones fit into a byte
        sums = ((rows >> np.uint64(j)) & _ONES).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.nonzero(sums * 2 > n)[0]:
            out |= 1 << (8 * int(byte) + j)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", of(F.col("text").cast("string")).alias("fp"))


def bit_statistics(fps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The share of ones of each bit and the bits' correlations, over all fingerprints: 4096 sums reach the driver."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((64, 64))
        for pdf in parts:
            bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += bits.T @ bits
        yield pd.DataFrame({"i": np.arange(64 * 64), "n": both.ravel()})

    n = max(fps.count(), 1)
    both = np.zeros(64 * 64)
    for r in fps.select("fp").mapInPandas(sums, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():
        both[r.i] = r.n
    both = both.reshape(64, 64) / n
    p = both.diagonal().copy()
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return p, (both - np.outer(p, p)) / np.outer(sd, sd)


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near equal size: each starts at the bit with the most correlation left and takes its closest."""
    left, out = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        rest = sorted(left)
        first = max(rest, key=lambda i: (np.abs(corr[i, rest]).sum(), -i))
        group = sorted(rest, key=lambda j: (j != first, -abs(corr[first, j]), j))[:size]
        out.append(sorted(group))
        left -= set(group)
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a group, that sum to total at the least cost: a dynamic programme over groups and sums."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, more in cost.items():
                if s + t not in nxt or c + more < nxt[s + t][0]:
                    nxt[s + t] = (c + more, [*ts, t])
        best = nxt
    return best[total]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def plan(fps: DataFrame, limit: int = LIMIT) -> list[int]:
    """The masks under which fingerprints are grouped, for the cheapest number of groups, bits and thresholds."""
    p, corr = bit_statistics(fps)
    n = max(fps.count(), 1)
    layouts = {m: group_bits(corr, m) for m in (2, 3, 4)}
    masks = [(m, i, _mask(g)) for m, gs in layouts.items() for i, g in enumerate(gs)]
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(k))).alias("v")) for m, i, k in masks])).alias("k"))
    pairs = {
        (r.m, r.i): r.pairs
        for r in keyed.groupBy("k").agg(F.count("*").alias("c")).groupBy("k.m", "k.i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    }
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-6, 1)
    best = None
    for m, gs in layouts.items():
        costs = []
        for i, g in enumerate(gs):
            odds = (1 - agree[g]) / agree[g]
            base = pairs.get((m, i), 0.0)
            one, two = odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2
            # pairs expected within t bits of the group, each found under every mask that hides its differences, and the keys made
            w = len(g)
            cost = {-1: 0.0, 0: base + n}
            cost[1] = base * (w + one) + n * w
            cost[2] = base * (w * (w - 1) / 2 + one * (w - 1) + two) + n * w * (w - 1) / 2
            costs.append({t: c for t, c in cost.items() if t <= limit})
        found = allocate(costs, limit - m + 1)
        if best is None or found[0] < best[0]:
            best = (*found, gs)
    _, ts, gs = best
    return [_mask(g) & ~_mask(list(hide)) for g, t in zip(gs, ts, strict=True) if t >= 0 for hide in combinations(g, t)]


def _forest(x: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Links within limit bits that join the same members as all such links do."""
    left = np.arange(len(x))
    u = x.view(np.uint64)
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(u[left] ^ u[i]) <= limit
            for j in left[near]:
                yield int(x[i]), int(x[j])
            todo.extend(left[near])
            left = left[~near]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect the same ones as all links within limit bits do."""
    limit = LIMIT
    masks = plan(fps, limit)
    keyed = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(k))) for k in masks])).alias("slot", "v")
    )
    sizes = settle(keyed.groupBy("slot", "v").agg(F.count("*").alias("c")).where("c > 1"))
    shared = settle(keyed.join(sizes, ["slot", "v"]))

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf["fp"].to_numpy(np.int64)
            cut = np.flatnonzero((np.diff(pdf["slot"].to_numpy()) != 0) | (np.diff(pdf["v"].to_numpy()) != 0)) + 1
            begin = np.concatenate([[0], cut]).astype(np.int64)
            size = np.diff(np.concatenate([begin, [len(x)]]))
            two = begin[size == 2]
            two = two[np.bitwise_count(x.view(np.uint64)[two] ^ x.view(np.uint64)[two + 1]) <= limit]
            out = list(zip(x[two].tolist(), x[two + 1].tolist()))
            for lo, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
                out.extend(_forest(x[lo : lo + n], limit))
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf["slot"] == pdf["slot"].iloc[-1]) & (pdf["v"] == pdf["v"].iloc[-1]) if len(pdf) else None
            if last is None:
                continue
            rest = pdf[last].reset_index(drop=True)  # its key may go on in the next batch; a key has `bucket` rows at most
            yield of(pdf[~last])
        if rest is not None:
            yield of(rest)

    near = (
        shared.where(F.col("c") <= bucket)
        .select("slot", "v", "fp")
        .repartition("slot", "v")
        .sortWithinPartitions("slot", "v", "fp")
        .mapInPandas(compare, "a long, b long")
    )
    # Larger keys: two fingerprints are within 2 bits just if they share a neighbour within 1 bit, so each is linked
    # to the least fingerprint at each of its neighbours; 65 rows a fingerprint whatever the group's size.
    hot = shared.where(F.col("c") > bucket).select("fp").distinct()
    if hot.isEmpty():
        return near
    around = hot.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])).alias("mid"))
    least = settle(around.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("c")).where("c > 1"))
    return near.union(around.join(least, "mid").where("a <> fp").select("a", F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Nulls: a null text, like one without words, has fingerprint zero and is linked like any other; a null doc_id
    is never a component's id unless no other is in it. Repeated rows stay, each with its component. Texts of any
    length are read whole. An empty table gives no rows. Other columns are ignored.
    """
    told = settle(fingerprints(docs.select("doc_id", "text")))
    fps = settle(told.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = connected_components(links(fps.select("fp")), "a", "b")
    named = fps.join(comp, fps.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = settle(named.join(ids, "component").select(F.col("fp").alias("f"), "component_id"))
    return told.join(of, told.fp == of.f).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
