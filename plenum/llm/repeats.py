"""Removal of repeated passages: every byte under a string of LENGTH bytes that also starts somewhere else.

The strings (windows) are ordered by most-significant-digit passes that end at depth LENGTH; groups that are still together there are
exactly the repeated windows.

1. The leading digit of a window is its least k-gram by hash (the leftmost such), so equal windows share it, at the same place. One
   occurrence of a k-gram, its anchor, leads some 70 windows that overlap each other; together they are the anchor's context. Only a
   number for the k-gram and one for the context move. A k-gram with a single context of a single occurrence has no repeated window;
   an equal context elsewhere makes all windows of both repeated.
2. What is left, contexts that share a k-gram and nowhere occur again as a whole, moves as bytes to its k-gram's task. There the
   windows are split by their place around the k-gram and then by eight bytes a pass; windows alone in their group drop out.
3. A k-gram found more than HOT times is kept out of both: its contexts are counted with partial sums, and the windows of those that
   occur once are counted by 128-bit numbers, as rows that any task can sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.llm.common import settle, small_enough

LENGTH = 200
#: Bytes of a k-gram.
GRAM = 64
#: Occurrences of a k-gram from which its windows are counted as rows.
HOT = 10_000
#: Hot k-grams that tasks are told by a list at most; more are joined by shuffling.
FEW = 10_000
#: Window starts of a text that are looked at together, and bytes of contexts that are ordered together.
PIECE = 1 << 20
TOGETHER = 4 << 20
#: Contexts that a task remembers having handed on.
REMEMBERED = 500_000

_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(200).integers(0, 2**64, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD to the powers 0 to n - 1 modulo 2**64, and their inverses."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 2**64)):
        steps = np.full(n, np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def gram_hashes(body: np.ndarray, k: int) -> np.ndarray:
    """A number for each k-gram of the bytes: a rolling sum modulo 2**64, its bits mixed."""
    up, down = _powers(1 << (len(body) - 1).bit_length())
    total = np.zeros(len(body) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[body] * up[: len(body)], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: len(body) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def least_in(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours: of the rest of one block and the start of the next."""
    whole = np.concatenate([v, np.full(-len(v) % width, np.iinfo(v.dtype).max, dtype=v.dtype)]).reshape(-1, width)
    upto = np.minimum.accumulate(whole, axis=1).ravel()
    onward = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - width + 1
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def anchors(body: bytes, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a text: each anchor's number, its place, and the first and last window that it leads. Windows go by their start."""
    low = np.uint64(0xFFFFFFFF)
    for at in range(0, len(body) - length + 1, PIECE):
        piece = np.frombuffer(body, dtype=np.uint8, offset=at, count=min(len(body) - at, PIECE + length - 1))
        h = gram_hashes(piece, k)
        lead = least_in((h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1) & low
        first = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
        last = np.concatenate([first[1:], [len(lead)]]) - 1
        place = lead[first].astype(np.int64)
        yield h[place].view(np.int64), place + at, first + at, last + at


def context_numbers(body: bytes, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(body[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64).view(np.int64)


def context_rows(length: int, k: int) -> Callable:
    """A task: (key, h, c) for each context c of k-gram h in its texts."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, grams, contexts = [], [], []
            for key, body in zip(frame["key"], frame["body"], strict=True):
                for h, _, first, last in anchors(body, length, k):
                    keys.append(np.full(len(h), key, dtype=np.int64))
                    grams.append(h)
                    contexts.append(context_numbers(body, first, last, length))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "h": np.concatenate(grams), "c": np.concatenate(contexts)})

    return task


#: What is known of a context: all its windows are repeated, and it may be looked up by others (told) or not; its windows must be looked up.
REPEATED, TOLD, OPEN, HOT_OPEN, HOT_TOLD = 1, 2, 3, 4, 5
#: Rows of the second reading.
DONE, WAITING, CONTEXT, WINDOW = 0, 1, 2, 3
_DECIDED = "kind int, doc_id long, key long, h long, c long, code int, place int, body binary, n_bytes long, spans array<long>, kept_sha256 string, open_c array<long>, open_first array<long>, d1 long, d2 long"


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in any of the spans."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:n]) > 0


def runs(covered: np.ndarray) -> list[int]:
    """start, end, start, end, .. of the True stretches."""
    return np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).tolist()


def finished(row: dict, body: bytes, spans: list[int], with_text: bool) -> dict:
    covered = cover(len(body), np.array(spans[::2], dtype=np.int64), np.array(spans[1::2], dtype=np.int64))
    kept = np.frombuffer(body, dtype=np.uint8)[~covered].tobytes() if spans else body
    return row | {"kind": DONE, "n_bytes": len(body), "spans": runs(covered), "kept_sha256": hashlib.sha256(kept).hexdigest(), "body": kept if with_text else None}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _DECIDED.split(", "))]))


def second_reading(length: int, k: int, with_text: bool, listed: list[int]) -> Callable:
    """A task: finished texts, texts that wait for looked-up windows, and the contexts and windows to look up."""
    hot = frozenset(listed)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for batch in batches:
            out, held = [], 0
            for doc_id, key, body, flags in zip(*[batch[c].to_pylist() for c in ("doc_id", "key", "body", "flags")], strict=True):
                row = {"doc_id": doc_id, "key": key}
                if not flags:
                    out.append(finished(row, body, [], with_text))
                    held += len(body) * with_text
                else:
                    # where texts share a key by accident, the numbers of contexts tell them apart
                    codes: dict[int, int] = {}
                    for f in flags:
                        codes[f["c"]] = max(codes.get(f["c"], 0), f["code"])
                    spans: list[int] = []
                    open_c, open_first = [], []
                    for h, place, first, last in anchors(body, length, k):
                        c = context_numbers(body, first, last, length)
                        for hi, pi, a, b, ci in zip(h.tolist(), place.tolist(), first.tolist(), last.tolist(), c.tolist(), strict=True):
                            code = codes.get(ci, REPEATED if hi in hot else 0)
                            if code in (REPEATED, TOLD, HOT_TOLD):
                                spans += (a, b + length)
                            elif code in (OPEN, HOT_OPEN):
                                open_c.append(ci)
                                open_first.append(a)
                            if code in (TOLD, HOT_TOLD):
                                if (hi, ci) in told:
                                    continue
                                told.add((hi, ci))
                            if code in (TOLD, OPEN):
                                out.append({"kind": CONTEXT, "key": key, "h": hi, "c": ci, "code": code, "place": pi - a, "body": body[a : b + length]})
                                held += b + length - a
                            elif code in (HOT_OPEN, HOT_TOLD):
                                for s in range(a, b + 1):
                                    both = xxhash.xxh3_128_intdigest(body[s : s + length])
                                    d1, d2 = (x - (x >> 63 << 64) for x in (both >> 64, both & (2**64 - 1)))
                                    out.append({"kind": WINDOW, "key": key, "c": ci, "code": code, "place": s - a, "d1": d1, "d2": d2})
                                    held += 64
                    if open_c:
                        out.append(row | {"kind": WAITING, "body": body, "spans": spans, "open_c": open_c, "open_first": open_first})
                        held += len(body)
                    else:
                        out.append(finished(row, body, spans, with_text))
                        held += len(body) * with_text
                if held > TOGETHER:
                    yield _batch(out)
                    out, held = [], 0
                if len(told) > REMEMBERED:
                    told.clear()
            if out:
                yield _batch(out)

    return task


def order_windows(contexts: list[bytes], groups: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the windows that also start elsewhere, among contexts that hold their k-gram at places.

    The first digit is the group and the window's place around its k-gram; then eight bytes a pass, through `length` bytes. A pass
    sorts only the groups that the digit tells apart.
    """
    sizes = np.array([len(x) for x in contexts])
    flat = np.frombuffer(b"".join(contexts) + bytes(8), dtype=np.uint8).astype(np.uint64)
    n = len(flat) - 8
    digit = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        digit |= flat[i : i + n] << np.uint64(56 - 8 * i)
    many = sizes - length + 1
    which = np.repeat(np.arange(len(contexts)), many)
    start = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    at = start + np.repeat(np.cumsum(sizes) - sizes, many)
    _, group = np.unique(groups, return_inverse=True)
    around = places[which] - start
    group = group[which] * (int(around.max(initial=0)) + 1) + around
    order = np.argsort(group, kind="stable")
    head, tail = _edges(group[order])
    order, head, tail = _several(order, head, tail)
    for depth in range(0, length, 8):
        if not len(order):
            break
        word = digit[at[order] + depth] >> np.uint64(8 * max(0, depth + 8 - length))
        change = np.concatenate([[False], word[1:] != word[:-1]])
        change[head] = False
        split = np.add.reduceat(change, head) > 0
        if not split.any():
            continue
        mixed = np.repeat(split, tail - head)
        group = np.repeat(np.arange(len(head)), tail - head)
        inner = np.lexsort((word[mixed], group[mixed]))
        order[mixed], word[mixed] = order[mixed][inner], word[mixed][inner]
        change = np.concatenate([[True], (word[1:] != word[:-1]) | (group[1:] != group[:-1])])
        head = np.flatnonzero(change)
        order, head, tail = _several(order, head, np.append(head[1:], len(order)))
    return which[order], start[order]


def _edges(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of equal values starts and ends."""
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
    return head, np.append(head[1:], len(group)).astype(np.int64)[: len(head)]


def _several(order: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the groups of one window."""
    size = tail - head
    order = order[np.repeat(size > 1, size)]
    tail = np.cumsum(size[size > 1])
    return order, tail - size[size > 1], tail


def look_up(length: int) -> Callable:
    """A task over contexts that come k-gram by k-gram: (key, c, starts), the repeated windows of the open ones."""

    def work(held: list[pd.DataFrame]) -> pd.DataFrame:
        f = pd.concat(held).reset_index(drop=True)
        which, start = order_windows(list(f["body"]), f["h"].to_numpy(np.int64), f["place"].to_numpy(np.int64), length)
        open_ = f["code"].to_numpy(np.int64) == OPEN
        told = pd.DataFrame({"i": which[open_[which]], "s": start[open_[which]]}).groupby("i")["s"].agg(list)
        return pd.DataFrame({"key": f["key"].to_numpy()[told.index], "c": f["c"].to_numpy()[told.index], "starts": told.to_list()})

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            h = frame["h"].to_numpy(np.int64)
            # a k-gram's contexts stay together: cut only where the k-gram changes
            borders = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.arange(0)
            for a, b in zip(borders, [*borders[1:], len(h)], strict=True):
                part = frame.iloc[a:b]
                if size > TOGETHER and held[-1]["h"].iloc[0] != part["h"].iloc[0]:
                    yield work(held)
                    held, size = [], 0
                held.append(part)
                size += int(part["body"].str.len().sum())
        if held:
            yield work(held)

    return task


def last_step(length: int, with_text: bool) -> Callable:
    """A task: the waiting texts, finished."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, key, body, spans, open_c, open_first, found in zip(*[batch[c].to_pylist() for c in ("doc_id", "key", "body", "spans", "open_c", "open_first", "found")], strict=True):
                all_spans = list(spans)
                starts = {f["c"]: f["starts"] for f in found or ()}
                for c, first in zip(open_c, open_first, strict=True):
                    for s in starts.get(c, ()):
                        all_spans += (first + s, first + s + length)
                out.append(finished({"doc_id": doc_id, "key": key}, body, all_spans, with_text))
            if out:
                yield _batch(out)

    return task


def known(texts: DataFrame, length: int, k: int, hot_from: int, few_hot: int) -> tuple[DataFrame, list[int]]:
    """(key, flags): for each text its contexts (c) of which something is known or must be looked up, with a code; and the hot k-grams, if few."""
    bodies = texts.where(F.length("body") >= length).select("key", "body")
    rows = settle(bodies.mapInPandas(context_rows(length, k), "key long, h long, c long"))
    hot = settle(rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot_from).select("h"))
    few = small_enough(hot, few_hot)
    listed = [r["h"] for r in hot.collect()] if few else []
    is_hot = F.col("h").isin(listed) if listed else F.lit(False)
    cold = (rows.where(~is_hot) if few else rows.join(hot, "h", "left_anti")).repartition("h")
    same, gram = Window.partitionBy("h", "c"), Window.partitionBy("h")
    cold = cold.withColumns({"times": F.count("*").over(same), "nth": F.row_number().over(same.orderBy("key"))})
    cold = cold.withColumn("contexts", F.count(F.when(F.col("nth") == 1, 1)).over(gram))
    several = F.col("contexts") > 1
    code = F.when((F.col("times") > 1) & several & (F.col("nth") == 1), TOLD).when(F.col("times") > 1, REPEATED).when(several, OPEN)
    flags = cold.select("key", "c", code.alias("code")).where("code is not null")
    if listed or not few:
        often = rows.where(is_hot) if few else rows.join(hot, "h", "left_semi")
        # the text of a context that occurs once, or one of those that hold it
        by_context = often.groupBy("h", "c").agg(F.count("*").alias("times"), F.min("key").alias("key"))
        flags = flags.unionByName(by_context.select("key", "c", F.when(F.col("times") > 1, HOT_TOLD).otherwise(HOT_OPEN).alias("code")))
        if few:  # what is not told of a listed k-gram's context is that it is repeated
            flags = flags.unionByName(often.select("key", F.lit(0).cast("long").alias("c"), F.lit(0).alias("code")))
        else:
            again = by_context.where("times > 1").select("h", "c")
            flags = flags.unionByName(often.join(again, ["h", "c"], "left_semi").select("key", "c", F.lit(REPEATED).alias("code")))
    return flags.groupBy("key").agg(F.collect_set(F.struct("c", "code")).alias("flags")), listed


def repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM, hot_from: int = HOT, few_hot: int = FEW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256[, kept]) of docs (doc_id, text): the removed stretches, as byte places [start, end), and what is left.

    A null text counts as empty; texts of fewer than `length` bytes keep all. Repeated rows repeat each other's windows, whatever their
    ids; null ids stay null. Strings are judged on the input, within and across documents, and never across a document's end. An empty
    table gives no rows. Other columns, whatever their names, are not read. Texts of any length are read in pieces of PIECE windows.
    Contexts are told apart by two 64-bit numbers, hot windows by 128 bits; open contexts are compared byte by byte.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).withColumn("key", F.xxhash64("body"))
    flags, listed = known(texts, length, k, hot_from, few_hot)
    flagged = texts.join(flags, "key", "left").select("doc_id", "key", "body", "flags")
    decided = settle(flagged.mapInArrow(second_reading(length, k, with_text, listed), _DECIDED))
    contexts = decided.where(F.col("kind") == CONTEXT).select("h", "c", "key", "code", "place", "body")
    found = contexts.repartition("h").sortWithinPartitions("h").mapInPandas(look_up(length), "key long, c long, starts array<int>")
    windows = decided.where(F.col("kind") == WINDOW).select("key", "c", "code", "place", "d1", "d2")
    if not windows.isEmpty():
        again = windows.groupBy("d1", "d2").agg(F.count("*").alias("times")).where("times > 1").select("d1", "d2")
        theirs = windows.where(F.col("code") == HOT_OPEN).join(again, ["d1", "d2"])
        found = found.unionByName(theirs.groupBy("key", "c").agg(F.collect_list("place").alias("starts")))
    by_text = found.groupBy("key").agg(F.collect_list(F.struct("c", "starts")).alias("found"))
    waiting = decided.where(F.col("kind") == WAITING).select("doc_id", "key", "body", "spans", "open_c", "open_first")
    ended = waiting.join(by_text, "key", "left").mapInArrow(last_step(length, with_text), _DECIDED)
    done = decided.where(F.col("kind") == DONE).unionByName(ended)
    at = F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))
    spans = F.when(F.size("spans") > 0, F.transform(at, lambda i: F.struct(F.get("spans", i).alias("start"), F.get("spans", i + 1).alias("end")))).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))
    kept = [F.col("body").alias("kept")] if with_text else []
    return done.select("doc_id", "n_bytes", spans.alias("spans"), "kept_sha256", *kept)
