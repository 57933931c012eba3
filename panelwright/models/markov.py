"""Continuous-time Markov intensities from panel observations, and a person bootstrap.

The likelihood needs only weighted counts of (origin, destination, interval length). Spark
adds those up; what is fitted per group is a table of a few dozen rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from ..bounded import collect_bounded
from ..operators.quantiles import exact_quantiles
from ..operators.summaries import transition_totals
from ..sources.tables import stored

LOW, HIGH = -10.0, 3.0


def matrix_exponential(a: np.ndarray) -> np.ndarray:
    """Scaling and squaring with a Taylor series, for one small matrix or a stack of them."""
    norm = np.abs(a).sum(axis=-1).max()
    halvings = max(0, int(np.ceil(np.log2(norm))) + 2) if norm > 0 else 0
    scaled = a / 2**halvings
    term = out = np.broadcast_to(np.eye(a.shape[-1]), a.shape)
    for k in range(1, 15):
        term = term @ scaled / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def edges_of(states: int) -> list[tuple[int, int]]:
    """Moves between living states 0..states-1 and into the absorbing state ``states``."""
    return [(i, j) for i in range(states) for j in range(states + 1) if i != j]


def intensity_matrix(theta: np.ndarray, states: int) -> np.ndarray:
    q = np.zeros((states + 1, states + 1))
    for value, (i, j) in zip(np.exp(theta), edges_of(states)):
        q[i, j] = value
        q[i, i] -= value
    return q


def _probabilities(theta, states, lengths):
    """P(t) and its derivative by each log rate, for every interval length.

    The upper right block of the exponential of [[Q, D], [0, Q]] is the derivative along D.
    """
    q = intensity_matrix(theta, states)
    size, edges = states + 1, edges_of(states)
    blocks = np.zeros((len(edges), 2 * size, 2 * size))
    blocks[:, :size, :size] = blocks[:, size:, size:] = q
    for e, (value, (i, j)) in enumerate(zip(np.exp(theta), edges)):
        blocks[e, i, size + j] = value
        blocks[e, i, size + i] = -value
    out = {}
    for t in lengths:
        both = matrix_exponential(blocks * t)
        out[t] = (both[0, :size, :size], both[:, :size, size:])
    return out


def _loglik(theta, states, counts):
    lengths = np.array(list(counts))[:, None, None]
    p = matrix_exponential(intensity_matrix(theta, states)[None] * lengths)
    return float(np.sum(np.array(list(counts.values())) * np.log(np.maximum(p, 1e-12))))


def starting_rates(counts: Mapping[float, np.ndarray], states: int) -> np.ndarray:
    moves = sum(counts.values())
    time = sum(t * w.sum(axis=1) for t, w in counts.items())
    return np.log([max(moves[i, j] / max(time[i], 1.0), 0.002) for i, j in edges_of(states)])


def fit_intensities(
    counts: Mapping[float, np.ndarray], states: int, start: np.ndarray | None = None, max_rounds: int = 1000
) -> tuple[np.ndarray, float, bool]:
    """Maximum-likelihood log rates by scoring, within bounds.

    ``counts`` holds for each interval length the weighted moves as a square matrix.
    """
    theta = starting_rates(counts, states) if start is None else np.array(start, dtype=float)
    theta = np.clip(theta, LOW, HIGH)
    value = _loglik(theta, states, counts)
    damping = 1e-6
    for _ in range(max_rounds):
        score = np.zeros(len(theta))
        information = np.zeros((len(theta), len(theta)))
        for t, (p, slopes) in _probabilities(theta, states, counts).items():
            p = np.maximum(p, 1e-12)
            w = counts[t]
            score += np.einsum("eij,ij->e", slopes, w / p)
            at_risk = w.sum(axis=1)
            information += np.einsum("eij,fij,ij->ef", slopes, slopes, at_risk[:, None] / p)
        free = ~(((theta <= LOW) & (score < 0)) | ((theta >= HIGH) & (score > 0)))
        inside = information[np.ix_(free, free)]
        trial, new = theta, -np.inf
        # damped steps: the surface is nearly flat where rates are high against the spacing
        while damping < 1e12:
            step = np.zeros(len(theta))
            step[free] = np.linalg.solve(
                inside + (damping * np.diag(inside) + 1e-9).max() * np.eye(len(inside)), score[free]
            )
            trial = np.clip(theta + np.clip(step, -2, 2), LOW, HIGH)
            new = _loglik(trial, states, counts)
            if new >= value:
                damping = max(damping / 5, 1e-9)
                break
            damping *= 4
        # a small gain, or none, is a maximum only where the free slopes have vanished as well
        flat = bool(np.abs(score[free]).max(initial=0.0) <= 1e-4 * max(1.0, sum(w.sum() for w in counts.values())))
        if new < value:
            return theta, value, flat
        gain, theta, value = new - value, trial, new
        if flat and gain <= 1e-10 * max(1.0, abs(value)):
            return theta, value, True
    return theta, value, False


def counts_from(table: pd.DataFrame, origin, destination, length, weight, states) -> dict[float, np.ndarray]:
    """The table of one fit, as ``fit_intensities`` takes it."""
    counts: dict[float, np.ndarray] = {}
    for i, j, t, w in zip(table[origin], table[destination], table[length], table[weight]):
        counts.setdefault(float(t), np.zeros((states + 1, states + 1)))[int(i), int(j)] += float(w)
    return counts


def _stacked_slopes(theta: np.ndarray, states: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """P(t) of every fit of a stack, and its derivatives by each log rate, shapes (fits, s, s) and (fits, edges, s, s)."""
    size, edges = states + 1, edges_of(states)
    q = stacked_intensities(theta, states)
    blocks = np.zeros((len(theta), len(edges), 2 * size, 2 * size))
    blocks[:, :, :size, :size] = blocks[:, :, size:, size:] = q[:, None]
    for e, (i, j) in enumerate(edges):
        rate = np.exp(theta[:, e])
        blocks[:, e, i, size + j] = rate
        blocks[:, e, i, size + i] = -rate
    both = matrix_exponential(blocks * t)
    return both[:, 0, :size, :size], both[:, :, :size, size:]


def stacked_intensities(theta: np.ndarray, states: int) -> np.ndarray:
    q = np.zeros((len(theta), states + 1, states + 1))
    for e, (i, j) in enumerate(edges_of(states)):
        q[:, i, j] = np.exp(theta[:, e])
        q[:, i, i] -= q[:, i, j]
    return q


def _stacked_loglik(theta: np.ndarray, states: int, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    q = stacked_intensities(theta, states)
    p = matrix_exponential(q[:, None] * lengths[None, :, None, None])
    return (counts * np.log(np.maximum(p, 1e-12))).sum(axis=(1, 2, 3))


def fit_stack(
    counts: np.ndarray, lengths: np.ndarray, states: int, start: np.ndarray | None = None, max_rounds: int = 1000
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fit_intensities`` for many tables at once: the same steps, each fit with its own damping.

    ``counts`` has shape (fits, lengths, s, s), zero where a fit lacks a length. Returns log
    rates, log-likelihoods and whether each converged; fits leave the stack as they settle.
    """
    n, edges = len(counts), edges_of(states)
    if start is None:
        moves, time = counts.sum(axis=1), (counts.sum(axis=3) * lengths[None, :, None]).sum(axis=1)
        start = np.log(np.stack([np.maximum(moves[:, i, j] / np.maximum(time[:, i], 1.0), 0.002) for i, j in edges], axis=1))
    theta = np.clip(np.array(start, dtype=float), LOW, HIGH)
    value = _stacked_loglik(theta, states, counts, lengths)
    damping, converged, total = np.full(n, 1e-6), np.zeros(n, bool), counts.sum(axis=(1, 2, 3))
    active = np.arange(n)
    for _ in range(max_rounds):
        if not len(active):
            break
        now, own = theta[active], counts[active]
        score, information = np.zeros((len(active), len(edges))), np.zeros((len(active), len(edges), len(edges)))
        for at, t in enumerate(lengths):
            p, slopes = _stacked_slopes(now, states, t)
            p = np.maximum(p, 1e-12)
            w = own[:, at]
            score += np.einsum("geij,gij->ge", slopes, w / p)
            information += np.einsum("geij,gfij,gij->gef", slopes, slopes, w.sum(axis=2)[:, :, None] / p)
        free = ~(((now <= LOW) & (score < 0)) | ((now >= HIGH) & (score > 0)))
        score = score * free
        inside = information * free[:, :, None] * free[:, None, :]
        diagonal = np.einsum("gee->ge", inside)
        inside = inside + np.eye(len(edges)) * (~free)[:, None, :]
        flat = np.abs(score).max(axis=1) <= 1e-4 * np.maximum(1.0, total[active])
        better, pending = np.zeros(len(active), bool), np.arange(len(active))
        trial, new = now.copy(), np.full(len(active), -np.inf)
        while len(pending):
            ridge = damping[active[pending]] * diagonal[pending].max(axis=1) + 1e-9
            step = np.linalg.solve(inside[pending] + np.eye(len(edges)) * ridge[:, None, None], score[pending][:, :, None])[:, :, 0]
            trial[pending] = np.clip(now[pending] + np.clip(step * free[pending], -2, 2), LOW, HIGH)
            new[pending] = _stacked_loglik(trial[pending], states, own[pending], lengths)
            good = new[pending] >= value[active[pending]]
            better[pending[good]] = True
            damping[active[pending[good]]] = np.maximum(damping[active[pending[good]]] / 5, 1e-9)
            pending = pending[~good]
            damping[active[pending]] *= 4
            pending = pending[damping[active[pending]] < 1e12]
        gain = np.where(better, new - value[active], np.inf)
        theta[active[better]], value[active[better]] = trial[better], new[better]
        settled = flat & (gain <= 1e-10 * np.maximum(1.0, np.abs(value[active])))
        converged[active[settled]] = True
        converged[active[~better]] = flat[~better]
        active = active[better & ~settled]
    return theta, value, converged


def fit_groups(
    totals: DataFrame,
    groups: Sequence[str],
    states: int,
    origin: str = "functional_state",
    destination: str = "destination_state",
    length: str = "interval_years",
    weight: str = "weight",
    starts: Mapping[tuple, Sequence[float]] | None = None,
    start_by: Sequence[str] = (),
    stack: int = 256,
) -> DataFrame:
    """Intensities of every group from its transition totals.

    A group has at most origins x destinations x lengths rows, however large the panel was. A task fits
    its groups together, ``stack`` at a time. ``starts`` gives log rates to begin from, by the values of
    ``start_by``; other groups begin at their crude rates.
    """
    groups, start_by = list(groups), list(start_by)
    results = [("origin", IntegerType()), ("target", IntegerType()), ("rate", DoubleType()), ("loglik", DoubleType()), ("converged", BooleanType())]
    schema = StructType([*[totals.schema[c] for c in groups], *[StructField(n, t) for n, t in results]])
    known = dict(starts or {})
    size = states + 1

    def fitted(table: pd.DataFrame, codes: np.ndarray) -> Iterator[pd.DataFrame]:
        for at in range(0, int(codes.max(initial=-1)) + 1, stack):
            own = (codes >= at) & (codes < at + stack)
            part, code = table[own], codes[own] - at
            lengths, place = np.unique(part[length].to_numpy(dtype=float), return_inverse=True)
            counts = np.zeros((int(code.max()) + 1, len(lengths), size, size))
            np.add.at(counts, (code, place, part[origin].to_numpy(dtype=int), part[destination].to_numpy(dtype=int)), part[weight].to_numpy(dtype=float))
            names = part[groups].iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
            begin = None
            if known:
                given = [known.get(tuple(v.item() if hasattr(v, "item") else v for v in r)) for r in names[start_by].itertuples(index=False)]
                crude = [starting_rates(dict(zip(lengths, c)), states) for c in counts]
                begin = np.array([c if g is None else g for g, c in zip(given, crude)])
            theta, value, converged = fit_stack(counts, lengths, states, begin)
            edges = edges_of(states)
            out = names.loc[names.index.repeat(len(edges))].reset_index(drop=True)
            out["origin"] = np.tile([i for i, _ in edges], len(names)).astype(np.int32)
            out["target"] = np.tile([j for _, j in edges], len(names)).astype(np.int32)
            out["rate"] = np.exp(theta).ravel()
            out["loglik"], out["converged"] = np.repeat(value, len(edges)), np.repeat(converged, len(edges))
            yield out

    def fit(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last group met, which the next batch may continue
        for table in tables:
            table = table if held is None else pd.concat([held, table], ignore_index=True)
            if not len(table):
                continue
            codes = table.groupby(groups, dropna=False, sort=False).ngroup().to_numpy()
            last = codes == codes[-1]
            held = table[last]
            yield from fitted(table[~last], codes[~last])
        if held is not None and len(held):
            yield from fitted(held, np.zeros(len(held), int))

    return totals.repartition(*groups).sortWithinPartitions(*groups).mapInPandas(fit, schema)


def key_rates(
    rates: DataFrame, groups: Sequence[str], key: Mapping[str, Sequence[tuple[int, int]]]
) -> DataFrame:
    """Rates summed over the moves of each named transition."""
    entries = [
        F.struct(F.lit(label).alias("transition"), F.lit(i).alias("i"), F.lit(j).alias("j"))
        for label, moves in key.items()
        for i, j in moves
    ]
    long = rates.withColumn("e", F.explode(F.array(*entries))).filter(
        (F.col("origin") == F.col("e.i")) & (F.col("target") == F.col("e.j"))
    )
    return long.groupBy(*groups, F.col("e.transition").alias("transition")).agg(
        F.sum("rate").alias("rate"), F.min(F.col("converged").cast("int")).alias("converged")
    )


def rate_ratios(keyed: DataFrame, by: str, high, low, groups: Sequence[str] = ()) -> DataFrame:
    """Intensity of one group over another's for each transition."""
    out = keyed.groupBy(*groups, "transition").agg(
        F.max(F.when(F.col(by) == low, F.col("rate"))).alias("rate_low"),
        F.max(F.when(F.col(by) == high, F.col("rate"))).alias("rate_high"),
        F.min("converged").alias("converged"),
    )
    return out.withColumn("ratio", F.try_divide("rate_high", "rate_low"))


def hash_number(text: Column) -> Column:
    """The first 60 bits of a text's md5 as a whole number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def person_index(
    people: DataFrame, group: str, key: str, digits: int = 3
) -> tuple[DataFrame, dict]:
    """Number people 0..N-1 within each group, and N.

    People are put into 16**digits buckets by a hash of the key; positions are counted within
    a bucket and shifted by the sizes of the buckets before it. The numbering is a function
    of the keys, so a re-computed task gives the same one, and no task orders everybody.
    """
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, digits), 16, 10).cast("int")
    bucketed = people.withColumn("__bucket", bucket)
    sizes = collect_bounded(
        bucketed.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("n")), 1_000_000, "person buckets"
    )
    totals: dict = {}
    shifts = []
    for r in sorted(sizes, key=lambda r: (r[group], r["__bucket"])):
        shifts.append((r[group], r["__bucket"], totals.get(r[group], 0)))
        totals[r[group]] = totals.get(r[group], 0) + r["n"]
    schema = StructType([*bucketed.select(group, "__bucket").schema.fields, StructField("__shift", LongType())])
    table = people.sparkSession.createDataFrame(shifts, schema)  # one row per bucket, counted above
    place = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(key)) - 1
    numbered = bucketed.withColumn("__place", place).join(F.broadcast(table), [group, "__bucket"])
    indexed = numbered.withColumn("person_no", F.col("__place") + F.col("__shift"))
    return indexed.drop("__bucket", "__place", "__shift"), totals


def resample(
    spark, totals: Mapping, group: str, group_type: str, replicates: int, seed: int
) -> DataFrame:
    """How often each person number is drawn, with as many draws as people in every replicate."""
    parts = None
    for value, n in sorted(totals.items()):
        drawn = spark.range(n).select(
            F.lit(value).cast(group_type).alias(group),
            F.col("id").alias("draw"),
            F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"),
        )
        text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(value)), F.col("replicate").cast("string"), F.col("draw").cast("string"))
        picked = drawn.select(group, "replicate", (hash_number(text) % n).alias("person_no"))
        parts = picked if parts is None else parts.unionByName(picked)
    return parts.groupBy(group, "person_no", "replicate").agg(F.count(F.lit(1)).alias("times"))


def bootstrap_totals(
    df: DataFrame,
    key: str,
    group: str,
    replicates: int,
    seed: int,
    origin: str = "functional_state",
    destination: str = "destination_state",
    length: str = "interval_years",
    weight: str = "w",
) -> DataFrame:
    """Transition totals of every person-level bootstrap replicate.

    A person's intervals are added up to a few cells first, so a draw carries one row.
    """
    cells = transition_totals(df, origin, destination, length, weight, [group, key])
    people = cells.groupBy(group, key).agg(
        F.collect_list(F.struct(origin, destination, length, "weight")).alias("cells")
    )
    indexed, sizes = person_index(people, group, key)
    kind = df.schema[group].dataType.simpleString()
    drawn = resample(df.sparkSession, sizes, group, kind, replicates, seed)
    joined = drawn.join(indexed, [group, "person_no"]).select(
        "replicate", group, "times", F.explode("cells").alias("c")
    )
    return joined.groupBy("replicate", group, *[F.col(f"c.{c}").alias(c) for c in (origin, destination, length)]).agg(
        F.sum(F.col("times") * F.col("c.weight")).alias("weight")
    )


def pattern_draws(
    df: DataFrame,
    key: str,
    group: str,
    replicates: int,
    seed: int,
    origin: str = "functional_state",
    destination: str = "destination_state",
    length: str = "interval_years",
    weight: str = "w",
    buckets: int = 256,
) -> DataFrame:
    """Person-level resamples as counts of equal people: ``group``, ``pattern``, ``people``, ``times``.

    People of a group whose cells (origin, destination, length, weight) are all equal form a
    pattern, and only how often a pattern is drawn matters: ``times`` has one count per replicate,
    together as many as there are people. The counts are multinomial, split step by
    step: first over hash buckets of patterns on the driver (groups x ``buckets`` numbers a
    replicate), then within a bucket, pattern after pattern, as binomials of what is left. Work
    and shuffles grow with the patterns, not with people times replicates. Random streams belong to
    (seed, group, bucket), so a task that is run again draws the same.
    """
    cells = transition_totals(df, origin, destination, length, weight, [group, key])
    people = cells.groupBy(group, key).agg(
        F.sort_array(F.collect_list(F.struct(origin, destination, length, "weight"))).alias("pattern")
    )
    patterns = stored(
        people.groupBy(group, "pattern")
        .agg(F.count(F.lit(1)).alias("people"))
        .withColumn("h", F.xxhash64("pattern"))
        .withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")),
        "patterns",
    )
    sizes = collect_bounded(patterns.groupBy(group, "bucket").agg(F.sum("people").alias("n")), 1_000_000, "pattern buckets")
    by_group: dict = {}
    for r in sizes:
        by_group.setdefault(r[group], {})[r["bucket"]] = r["n"]
    rows = []
    for value, own in by_group.items():
        places = sorted(own)
        share = np.array([own[b] for b in places], dtype=float)
        drawn = np.random.default_rng([seed, _number(value)]).multinomial(int(share.sum()), share / share.sum(), size=replicates)
        rows += [(value, b, own[b], _number(value), drawn[:, i].tolist()) for i, b in enumerate(places)]
    fields = [patterns.schema[group], StructField("bucket", IntegerType()), StructField("n", LongType()), StructField("stream", LongType()), StructField("drawn", ArrayType(LongType()))]
    table = df.sparkSession.createDataFrame(rows, StructType(fields))
    met = patterns.alias("p").join(table.alias("t"), F.col(f"p.{group}").eqNullSafe(F.col(f"t.{group}")) & (F.col("p.bucket") == F.col("t.bucket")))
    dealt = met.select("p.*", "n", "stream", "drawn").repartition("stream", "bucket").sortWithinPartitions("stream", "bucket", "h", "pattern")
    kept = [patterns.schema[c] for c in (group, "pattern", "people")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rng, left, rest = None, None, None, 0
        for batch in batches:
            streams, places = batch.column("stream").to_pylist(), batch.column("bucket").to_pylist()
            sizes, totals, times = batch.column("people").to_pylist(), batch.column("n").to_pylist(), []
            for row in range(batch.num_rows):
                if (streams[row], places[row]) != at:
                    at = (streams[row], places[row])
                    rng = np.random.default_rng([seed, *at])
                    left, rest = np.array(batch.column("drawn")[row].as_py()), totals[row]
                taken = rng.binomial(left, min(1.0, sizes[row] / rest))
                left, rest = left - taken, rest - sizes[row]
                times.append(taken.tolist())
            if times:
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f.name) for f in kept], pa.array(times, pa.list_(pa.int64()))], names=[*[f.name for f in kept], "times"]
                )

    return dealt.mapInArrow(split, StructType([*kept, StructField("times", ArrayType(LongType()))]))


def _number(value) -> int:
    """A number for a random stream of a group, whatever the type of its name."""
    return zlib.crc32(repr(value).encode())


def pattern_totals(draws: DataFrame, group: str) -> DataFrame:
    """Transition totals of every replicate from ``pattern_draws``."""
    cells = draws.select(group, "times", F.explode("pattern").alias("c"))
    names = [f.name for f in draws.schema["pattern"].dataType.elementType.fields if f.name != "weight"]
    each = cells.select(group, *[F.col(f"c.{c}").alias(c) for c in names], F.col("c.weight").alias("w"), F.posexplode("times").alias("at", "k"))
    return (
        each.where("k > 0")
        .groupBy((F.col("at") + 1).alias("replicate"), group, *names)
        .agg(F.sum(F.col("k") * F.col("w")).alias("weight"))
    )


def percentile_interval(
    ratios: DataFrame, label: str = "transition", value: str = "ratio", level: float = 0.95
) -> dict[str, tuple[float, float]]:
    """Percentile interval of each label over the replicates that converged."""
    tail = (1 - level) / 2
    found = exact_quantiles(ratios.filter("converged = 1"), value, [tail, 1 - tail], by=[label])
    return {k[0]: (v[0], v[1]) for k, v in found.items()}
