"""Operators whose steps depend on the steps before: one meeting's rows at a time, which a meeting's length bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.intervals import overlapping


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns, one to one, of the largest total gain (shortest augmenting paths)."""
    n, m = gain.shape
    if n > m:
        return [(i, j) for j, i in assignment(gain.T)]
    cost = gain.max(initial=0.0) - gain
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        row_of[m], j0 = i, m
        least, back, used = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while row_of[j0] >= 0:
            used[j0] = True
            i0 = row_of[j0]
            free = ~used[:m]
            reduced = cost[i0] - u[i0] - v[:m]
            better = free & (reduced < least[:m])
            least[:m][better], back[:m][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(free, least[:m], np.inf)))
            delta = least[j1]
            for j in np.flatnonzero(used):
                u[row_of[j]] += delta
                v[j] -= delta
            least[:m][free] -= delta
            j0 = j1
        while j0 != m:
            row_of[j0] = row_of[back[j0]]
            j0 = back[j0]
    return sorted((int(row_of[j]), j) for j in range(m) if row_of[j] >= 0)


def solid(turns: DataFrame, by: list[str]) -> DataFrame:
    """The union of each group's intervals as intervals that don't touch."""
    w = Window.partitionBy(*by).orderBy("start_time", "end_time")
    reach = F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = turns.where("end_time > start_time").withColumn("__cut", F.coalesce((F.col("start_time") > reach).cast("int"), F.lit(1)))
    numbered = cut.withColumn("__i", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__i").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("__i")


def diarization_error(reference: DataFrame, hypothesis: DataFrame, width: float = 600.0) -> DataFrame:
    """Per meeting: reference speech, what the best one-to-one mapping of speakers gets right, and the error rate.

    The error is the integral of max(speakers in reference, speakers in hypothesis) less what is right, over the reference's speech.
    """
    r, h = solid(reference, ["meeting", "label"]), solid(hypothesis, ["meeting", "label"])
    pairs = overlapping(
        r.withColumnRenamed("label", "ref"), h.select("meeting", F.col("label").alias("hyp"), F.col("start_time").alias("s"), F.col("end_time").alias("e")), ["meeting"], ("start_time", "end_time"), ("s", "e"), width
    )
    shared = pairs.groupBy("meeting", "ref", "hyp").agg(F.sum(F.least("end_time", "e") - F.greatest("start_time", "s")).alias("seconds"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="ref", columns="hyp", values="seconds", aggfunc="sum", fill_value=0.0).sort_index()
        gain = table.to_numpy(float)
        return pd.DataFrame({"meeting": [pdf["meeting"].iloc[0]], "correct": [sum(gain[i, j] for i, j in assignment(gain))]})

    correct = shared.groupBy("meeting").applyInPandas(best, f"meeting {dict(reference.dtypes)['meeting']}, correct double")
    side = lambda df, a, b: df.select("meeting", F.explode(F.array(F.struct(F.col("start_time").alias("t"), F.lit(a).alias("r"), F.lit(b).alias("h")), F.struct(F.col("end_time").alias("t"), F.lit(-a).alias("r"), F.lit(-b).alias("h")))).alias("x")).select("meeting", "x.*")
    steps = side(r, 1, 0).unionByName(side(h, 0, 1)).groupBy("meeting", "t").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    w = Window.partitionBy("meeting").orderBy("t")
    running = steps.select("meeting", (F.lead("t").over(w) - F.col("t")).alias("dt"), F.sum("r").over(w).alias("r"), F.sum("h").over(w).alias("h"))
    sums = running.groupBy("meeting").agg(F.sum(F.col("dt") * F.col("r")).alias("speech"), F.sum(F.col("dt") * F.greatest("r", "h")).alias("most"))
    return sums.join(correct, "meeting", "left").select(
        "meeting", F.round("speech", 3).alias("speech"), F.round(F.coalesce("correct", F.lit(0.0)), 3).alias("correct"), F.round((F.col("most") - F.coalesce("correct", F.lit(0.0))) / F.col("speech"), 5).alias("der")
    )


def align_sets(left: list[set], right: list[set], least: float = 0.1) -> list[tuple[int, int, float]]:
    """Pairs of a monotone alignment with the largest sum of overlap coefficients; gaps are free, pairs of `least` or below go."""
    n, m = len(left), len(right)
    score = np.array([[len(a & b) / min(len(a), len(b)) if a and b else 0.0 for b in right] for a in left]).reshape(n, m)
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        diagonal = best[i, :-1] + score[i]
        row = np.maximum(best[i, 1:], diagonal)
        best[i + 1, 1:] = np.maximum.accumulate(row)
    out, i, j = [], n, m
    while i and j:
        if abs(best[i, j] - best[i - 1, j - 1] - score[i - 1, j - 1]) < 1e-12:
            if score[i - 1, j - 1] > least:
                out.append((i - 1, j - 1, float(score[i - 1, j - 1])))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(left: DataFrame, right: DataFrame, least: float = 0.1) -> DataFrame:
    """Both have grp, ordinal, words (an array). Output: grp, left_ordinal, right_ordinal, overlap of the aligned pairs."""

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"grp": [], "left_ordinal": [], "right_ordinal": [], "overlap": []})
        a, b = a.sort_values("ordinal"), b.sort_values("place")
        found = align_sets([set(x) for x in a["words"]], [set(x) for x in b["said"]], least)
        o, p = a["ordinal"].tolist(), b["place"].tolist()
        return pd.DataFrame([(a["grp"].iloc[0], o[i], p[j], round(s, 4)) for i, j, s in found], columns=["grp", "left_ordinal", "right_ordinal", "overlap"])

    other = right.select(F.col("grp").alias("g"), F.col("ordinal").alias("place"), F.col("words").alias("said"))
    return left.groupBy("grp").cogroup(other.groupBy("g")).applyInPandas(pair, "grp long, left_ordinal long, right_ordinal long, overlap double")


def shared_seconds(a: np.ndarray, b: np.ndarray) -> float:
    """Seconds that each interval of a shares with each of b, summed over all pairs: by running sums over b's sorted ends, not pair by pair.

    Times count as whole microseconds, so sums are exact and nothing shared is 0.
    """
    if not len(a) or not len(b):
        return 0.0
    a, b = (np.rint(x[x[:, 1] > x[:, 0]] * 1e6).astype(np.int64) for x in (a, b))

    def before(t: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of t - e over the ends e before t."""
        ends = np.sort(ends)
        n = np.searchsorted(ends, t)
        return n * t - np.concatenate(([0], np.cumsum(ends)))[n]

    until = lambda t: before(t, b[:, 0]) - before(t, b[:, 1])
    return float((until(a[:, 1]) - until(a[:, 0])).astype(float).sum()) / 1e6


def stitch(chunks: DataFrame, threshold: float = 0.75, least_speech: float = 3.0) -> DataFrame:
    """Labels that hold across chunks: meeting, window, local, global_label, by (overlap, voice or new).

    Needs meeting, window, owned_from, owned_to, local, start_time, end_time, and voice (array<double> or null) of the local speaker.
    Window by window, local speakers take the known speaker with whom they share most seconds, one to one, the largest
    (seconds, local, known) first; of the rest those with enough speech take the most similar voice of at least threshold; the
    rest are new. A known speaker's voice is the mean of its parts, weighted by speech.
    """
    kind = dict(chunks.dtypes)["meeting"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, list] = {}  # label -> [intervals, voice, weight]
        rows = []
        for window, part in pdf.sort_values(["window", "start_time"]).groupby("window", sort=True):
            local = {k: (g[["start_time", "end_time"]].to_numpy(float), g["voice"].iloc[0]) for k, g in part.groupby("local")}
            speech = {k: float((t[:, 1] - t[:, 0]).sum()) for k, (t, _) in local.items()}
            taken: dict[str, tuple[str, str]] = {}

            def greedy(scores: list[tuple[float, str, str]], how: str, taken=taken) -> None:
                used = {g for g, _ in taken.values()}
                for _, k, g in sorted(scores, reverse=True):
                    if k not in taken and g not in used:
                        taken[k] = (g, how)
                        used.add(g)

            greedy([(s, k, g) for k, (t, _) in local.items() for g, (v, *_) in known.items() if (s := shared_seconds(t, v)) > 0], "overlap")

            def alike(a, b) -> float:
                a, b = np.asarray(a, float), np.asarray(b, float)
                d = np.linalg.norm(a) * np.linalg.norm(b)
                return float(a @ b / d) if a.shape == b.shape and d > 0 else 0.0

            greedy([(s, k, g) for k, (_, v) in local.items() if k not in taken and v is not None and speech[k] >= least_speech for g, (_, w, _) in known.items() if w is not None and (s := alike(v, w)) >= threshold], "voice")
            for k in sorted(local):
                g, how = taken.get(k, (f"G{len(known):03d}", "new"))
                t, v = local[k]
                old = known.setdefault(g, [np.zeros((0, 2)), None, 0.0])
                if v is not None:
                    v = np.asarray(v, float)
                    old[1], old[2] = (v, speech[k]) if old[1] is None else ((old[1] * old[2] + v * speech[k]) / max(old[2] + speech[k], 1e-9), old[2] + speech[k])
                old[0] = t
                rows.append((pdf["meeting"].iloc[0], int(window), k, g, how))
        return pd.DataFrame(rows, columns=["meeting", "window", "local", "global_label", "by"])

    return chunks.groupBy("meeting").applyInPandas(run, f"meeting {kind}, window long, local string, global_label string, by string")


def match_in_order(rolls: Column, announced: Column, tolerance: int = 3) -> Column:
    """For each roll the place (1, 2, ...) of the next announcement after the last matched one whose counts differ by `tolerance` in sum at most, else null.

    Both are ordered arrays of structs with yeas and nays.
    """
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        near = F.transform(announced, lambda a, i: (i >= acc["last"]) & (F.abs(a["yeas"] - r["yeas"]) + F.abs(a["nays"] - r["nays"]) <= tolerance))
        place = F.nullif(F.array_position(near, True), F.lit(0)).cast("int")
        return F.struct(F.coalesce(place, acc["last"]).alias("last"), F.concat(acc["out"], F.array(place)).alias("out"))

    return F.aggregate(rolls, start, step, lambda acc: acc["out"])


def accept_spans(spans: Column, n_segments: Column) -> Column:
    """For each proposed span why it is refused, or null: range, order, or backwards past the latest accepted start.

    An ordered array of structs with first and last; the bar rises only with accepted spans, so this is a fold and no running maximum.
    """
    start = F.struct(F.lit(-1).cast("long").alias("bar"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        why = (
            F.when(s["first"].isNull() | s["last"].isNull(), "missing")
            .when((s["first"] < 0) | (s["last"] >= n_segments), "range")
            .when(s["last"] < s["first"], "order")
            .when(s["first"] < acc["bar"], "backwards")
        )
        return F.struct(F.when(why.isNull(), s["first"].cast("long")).otherwise(acc["bar"]).alias("bar"), F.concat(acc["out"], F.array(why)).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: acc["out"])
