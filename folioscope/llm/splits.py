"""Splits of given proportions that keep related records together.

Components of related papers are bundled by size and label profile; min-cost flows, one for each size, send the
components of each bundle to the splits so that papers and labels miss their quotas as little as possible; inside a
bundle the components go to their split in the order of a hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.graph import components
from folioscope.llm.names import people
from folioscope.session import cut_lineage

# What stands where a venue is missing.
NO_SERIES = ("", "-", "--", "n/a", "na", "none", "null", "nan", "unknown", "tba", "?")
# Fixed value: what people write around the name of a series.
_SERIES = r"^(?:proceedings of (?:the )?|proc\.? (?:of )?(?:the )?|in )+"
_NUMBER = r"[\s,'’-]*(?:\d{2,4}|vol\.? ?\d+|\(\d{4}\))$"


def series_key(venue: str):
    """The series of a venue as typed: form, case, "Proceedings of", years and volume numbers off; null where nothing is left."""
    from folioscope.llm.textform import consistent_form

    low = F.trim(F.regexp_replace(F.lower(consistent_form(venue)), r"\s+", " "))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"^(?:\d{4}|\d+(?:st|nd|rd|th)) ", ""), _SERIES, ""), _NUMBER, "")
    key = F.trim(bare)
    return F.when(~key.isin(*NO_SERIES), key)


def related_groups(papers: DataFrame, mentions: DataFrame, key: str = "id", venue: str = "venue") -> DataFrame:
    """(id, group_id): papers that share a person or a venue series, directly or through others, with the smallest id of each group."""
    base = papers.select(F.col(key).alias("id"), series_key(venue).alias("key"))
    _, joined, home = people(mentions, base)
    merged = components(joined)  # circles that nothing joins to another stay as they are
    final = home.join(merged, home.circle == merged.node, "left").select("id", F.coalesce("component", "circle").alias("group"))
    least = final.groupBy("group").agg(F.min("id").alias("group_id"))
    return final.join(least, "group").select("id", "group_id").distinct()


def _flow(supply: list[int], cost: np.ndarray, sink: Callable[[int, int], float]) -> np.ndarray:
    """Units of each source per split at the least cost, by successive shortest paths.

    ``cost`` is per unit from source to split; ``sink(split, n)`` is what the n-th further unit in a split costs and
    grows with n. A path may send a unit to a split and push another source's unit on from there, so it runs over the
    splits only; residual arcs can be negative, which Bellman-Ford allows, and no cycle is.
    """
    k = cost.shape[1]
    sent = np.zeros((len(supply), k), np.int64)
    for b, units in enumerate(supply):
        for _ in range(units):
            length, back = cost[b].copy(), [(-1, b)] * k  # the split a path comes from, and the source it pushes
            for _ in range(k - 1):
                for s, t in itertools.permutations(range(k), 2):
                    held = np.flatnonzero(sent[:, s])
                    if len(held):
                        push = held[np.argmin(cost[held, t] - cost[held, s])]
                        if length[s] + cost[push, t] - cost[push, s] < length[t] - 1e-15:
                            length[t], back[t] = length[s] + cost[push, t] - cost[push, s], (s, int(push))
            t = min(range(k), key=lambda i: length[i] + sink(i, int(sent[:, i].sum())))
            while True:
                s, push = back[t]
                sent[push, t] += 1
                if s < 0:
                    break
                sent[push, s] -= 1
                t = s
    return sent


def allocate(bundles: list[tuple[float, tuple[float, ...], int]], shares: list[float]) -> list[list[int]]:
    """Components of each bundle (size, label counts, components) per split: a min-cost flow, rounded to whole components.

    The cost is the squared deviation of papers, and of papers of each label, from the quotas of the splits, each over
    its quota. Bundles of one size make one flow, the largest size first: the fractional optimum sends a bundle to the splits by what
    their quotas still lack; it is rounded down, and the units left over go along shortest paths with the rising cost of each
    split's arc. What rounding leaves is met by the smaller sizes that follow. At last cycles of one bundle, and of two, are cancelled until
    none lowers the cost, which ends since each one lowers it.
    """
    k = len(shares)
    if not bundles:
        return []
    weight = np.array([(size, *labels) for size, labels, _ in bundles], float)
    count = np.array([n for _, _, n in bundles], np.int64)
    quota = np.outer(shares, weight.T @ count)
    scale = 1.0 / np.maximum(quota, 1e-9) / np.maximum(weight.T @ count, 1.0)
    gap = -quota  # how far each split is over its quotas
    flow = np.zeros((len(bundles), k), np.int64)
    price = lambda s, w: (scale[s] * (2 * w * gap[s] + w * w)).sum(-1)
    for size in sorted({w[0] for w in weight}, reverse=True):
        own = np.flatnonzero(weight[:, 0] == size)
        lack = np.maximum(-gap[:, 0], 0.0)
        part = lack / lack.sum() if lack.sum() > 0 else np.asarray(shares) / sum(shares)
        flow[own] = np.floor(count[own, None] * part[None, :] + 1e-9)
        gap += flow[own].T @ weight[own]
        cost = np.stack([(2 * scale[s, 1:] * gap[s, 1:] * weight[own, 1:]).sum(1) for s in range(k)], 1)
        more = _flow((count[own] - flow[own].sum(1)).tolist(), cost, lambda s, n, z=size: scale[s, 0] * (2 * z * (gap[s, 0] + n * z) + z * z))
        flow[own] += more
        gap += more.T @ weight[own]
    pairs = list(itertools.permutations(range(k), 2))
    while True:
        best = (-1e-12, None)
        for s, t in pairs:
            there, here = np.flatnonzero(flow[:, s]), np.flatnonzero(flow[:, t])
            if not len(there):
                continue
            one = price(s, -weight[there]) + price(t, weight[there])
            if one.min() < best[0]:
                best = (one.min(), (s, t, [there[one.argmin()]], []))
            for at in range(0, len(here) if s < t else 0, 512):
                some = here[at : at + 512]
                swap = weight[there][:, None, :] - weight[some][None, :, :]
                two = price(s, -swap) + price(t, swap)
                i, j = np.unravel_index(two.argmin(), two.shape)
                if two[i, j] < best[0]:
                    best = (two[i, j], (s, t, [there[i]], [some[j]]))
        if best[1] is None:
            return flow.tolist()
        s, t, out, back = best[1]
        turns = [(b, s, t) for b in out] + [(b, t, s) for b in back]
        step = weight[out].sum(0) - weight[back].sum(0)
        slope, bend = 2 * ((scale[t] * gap[t] - scale[s] * gap[s]) * step).sum(), ((scale[s] + scale[t]) * step * step).sum()
        units = max(1, min(round(-slope / (2 * bend)), *(int(flow[b, x]) for b, x, _ in turns), int(flow[out[0], s])))
        for b, x, y in turns:
            flow[b, x] -= units
            flow[b, y] += units
        gap[s] -= units * step
        gap[t] += units * step


def grouped_split(papers: DataFrame, mentions: DataFrame, shares: dict[str, float], key: str = "id", venue: str = "venue", label: str = "label", seed: int = 0, exact: int = 5, labels: int = 20) -> DataFrame:
    """(id, group_id, split): every paper once; papers of one group stand in one split.

    Components of up to ``exact`` papers are bundled by size and label counts; larger ones by size, from 10 papers by
    its two leading digits, and by label shares in fifths, counted as the mean of their bundle. So the number of
    bundles, and what the driver sees, is bounded by sizes and labels whatever the number of papers; what a split gets
    differs from its plan by the spread inside the bundles of larger components only. More than ``labels`` different
    labels raise. Null venues and missing authors tie nothing; a paper alone is its own group; null labels count as a
    label of their own; a repeated id counts once, with its smallest label; an empty table gives an empty result.
    """
    groups = cut_lineage(related_groups(papers, mentions, key, venue))
    seen = papers.select(F.col(label).alias("label")).distinct().limit(labels + 1).collect()
    if len(seen) > labels:
        raise ValueError(f"more than {labels} different labels")
    kinds = sorted((r["label"] for r in seen), key=lambda v: (v is not None, v))
    each = [f"l{i}" for i in range(len(kinds))]
    labelled = groups.join(papers.select(F.col(key).alias("id"), F.col(label).alias("label")).groupBy("id").agg(F.min("label").alias("label")), "id")
    sized = labelled.groupBy("group_id").agg(F.count("*").alias("size"), *[F.count_if(F.col("label").eqNullSafe(F.lit(v))).alias(c) for v, c in zip(kinds, each)])
    step = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10(F.col("size"))) - 1)).cast("long")
    profile = [F.when(F.col("size") <= exact, F.col(c)).otherwise(F.round(5 * F.col(c) / F.col("size")).cast("long")).alias(c) for c in each]
    sized = sized.withColumn("cls", F.struct((F.floor(F.col("size") / step) * step).alias("s"), *profile))
    sized = cut_lineage(sized.select("group_id", "size", "cls", *each))
    rows = sized.groupBy("cls").agg(F.count("*").alias("n"), F.avg("size").alias("size"), *[F.avg(c).alias(c) for c in each]).orderBy("cls").collect()
    names = list(shares)
    flow = allocate([(r["size"], tuple(r[c] for c in each), r["n"]) for r in rows], [shares[n] for n in names])
    spark = papers.sparkSession
    ends = [(r["cls"], names[s], sum(f[:s]), sum(f[: s + 1])) for r, f in zip(rows, flow) for s in range(len(names)) if f[s]]
    plan = spark.createDataFrame(ends, _plan_schema(sized))
    # rank of each component by hash inside its bundle, in two levels so that a large bundle is not sorted in one task
    hashed = sized.select("group_id", "cls", F.xxhash64("group_id", F.lit(seed)).alias("h")).withColumn("slot", F.shiftrightunsigned("h", 54))
    per = hashed.groupBy("cls", "slot").agg(F.count("*").alias("c"))
    offset = per.withColumn("base", F.sum("c").over(Window.partitionBy("cls").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).select("cls", "slot", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = hashed.join(offset, ["cls", "slot"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("cls", "slot").orderBy("h", "group_id")) - 1)
    chosen = ranked.join(F.broadcast(plan), "cls").filter("rank >= first and rank < last").select("group_id", "split")
    return groups.join(chosen, "group_id").select("id", "group_id", "split")


def _plan_schema(sized: DataFrame):
    """Schema of the allocation table."""
    return T.StructType([T.StructField("cls", sized.schema["cls"].dataType), T.StructField("split", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
