"""Operational metrics: counters, deltas, rates, histograms, alerts, conditions over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BEAT_BOUNDS_SECONDS
from ..session import cut_lineage
from .ordered import Lane, lane, preceding, previous, running
from .sampling import due_rows

# --- counters -----------------------------------------------------------------------------------


def tagged_counters(increments: DataFrame) -> DataFrame:
    """Totals of ``increments(instrument, tag, tag_value, amount)``; the tag vocabularies are small and fixed."""
    return increments.groupBy("instrument", "tag", "tag_value").agg(F.sum("amount").cast("long").alias("total"))


def subscription_changes(events: DataFrame) -> DataFrame:
    """``events(feed, id, action, at_us)`` as +1 / -1 rows: the first open and the first close of each id."""
    firsts = events.groupBy("feed", "id", "action").agg(F.min("at_us").alias("at_us"))
    opened = firsts.where("action = 'open'").select("feed", "id", "at_us", F.lit(1).cast("long").alias("step"))
    closed = firsts.where("action = 'close'").select("feed", "id", "at_us", F.lit(-1).cast("long").alias("step"))
    return opened.unionByName(closed.join(opened.select("feed", "id"), ["feed", "id"], "left_semi"))


def open_subscriptions(events: DataFrame) -> DataFrame:
    """Subscriptions open at the end of the log, per feed; closing twice counts once."""
    return subscription_changes(events).groupBy("feed").agg(F.sum("step").alias("open_now"))


def open_subscriptions_over_time(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    changes = subscription_changes(events)
    on = lane("feed", ("at_us", "id", "step"), F.floor(F.col("at_us") / F.lit(seconds * 1_000_000)))
    return running(changes, on, open_now=("sum", F.col("step")))


def outcome_tally(events: DataFrame, outcome: str) -> DataFrame:
    return events.groupBy(outcome).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), outcome)


# --- histograms and quantiles -------------------------------------------------------------------


def bucket_bound(value: Column, bounds: Sequence[float] = BEAT_BOUNDS_SECONDS) -> Column:
    """Upper bound of the histogram bucket a value falls in; infinity past the last."""
    out = F.when(value <= bounds[0], F.lit(float(bounds[0])))
    for bound in bounds[1:]:
        out = out.when(value <= bound, F.lit(float(bound)))
    return out.otherwise(F.lit(float("inf")))


def beat_histogram(samples: DataFrame, keys: Sequence[str], seconds: Column) -> DataFrame:
    """Count and summed milliseconds per bucket."""
    return (
        samples.withColumn("le", bucket_bound(seconds))
        .withColumn("__ms", F.round(seconds * 1000).cast("long"))
        .groupBy(*keys, "le")
        .agg(F.count(F.lit(1)).alias("samples"), F.sum("__ms").alias("total_ms"))
    )


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], block_size: int
) -> DataFrame:
    """Exact order statistics of an integer column per key, for groups of any size, by digits.

    Values are counted by their highest digit, the digit that holds the rank is kept, and the rows with it are counted by the next one: rows are
    added up where they lie, and what is gathered for a rank is one count a digit, of which there are no more than ``block_size`` (rounded up to a power of
    two). ``ranks`` maps a name to a zero-based rank, written over the column ``n``; the number of rows ``n`` and their
    ``total`` come along. Null values are left out; a key's values lie less than 2^63 apart.
    """
    bits = max(1, (block_size - 1).bit_length())
    rows = cut_lineage(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("__v")))
    whole = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__v").alias("total"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).where("n > 0"))
    span = whole.agg(F.max(F.col("__hi") - F.col("__lo"))).first()[0] or 0
    levels = max(1, -(-int(span).bit_length() // bits))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("left")) for name, rank in ranks.items()]))
    want = whole.select(*keys, "n", "total", "__lo", asked.alias("r")).select(*keys, "n", "total", "__lo", "r.*", F.lit(0).cast("long").alias("__upper"))
    same = [F.col(f"__k_{k}").eqNullSafe(F.col(k)) for k in keys]
    few = F.broadcast if not keys else lambda small: small  # one row a rank
    for level in reversed(range(levels)):
        sought = few(want.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__lo", F.col("__upper").alias("__sought")).distinct())
        above = F.shiftright(F.col("__v") - F.col("__lo"), bits * (level + 1)) if bits * (level + 1) < 63 else F.lit(0)
        met = rows.join(sought, [above == F.col("__sought"), *same])
        digit = F.shiftright(F.col("__v") - F.col("__lo"), bits * level).bitwiseAND((1 << bits) - 1)
        counted = met.groupBy(*[f"__k_{k}" for k in keys], "__sought", digit.alias("__digit")).agg(F.count(F.lit(1)).alias("__times"))
        spread = want.join(counted, [F.col("__upper") == F.col("__sought"), *same])
        upto = F.sum("__times").over(Window.partitionBy(*keys, "name").orderBy("__digit"))
        placed = spread.withColumn("__upto", upto).where((F.col("__upto") > F.col("left")) & (F.col("__upto") - F.col("__times") <= F.col("left")))
        want = cut_lineage(
            placed.select(*keys, "n", "total", "__lo", "name", (F.col("left") - F.col("__upto") + F.col("__times")).alias("left"), (F.shiftleft("__upper", bits) + F.col("__digit")).alias("__upper"))
        )
    return want.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("total").alias("total"), *[F.max(F.when(F.col("name") == name, F.col("__lo") + F.col("__upper"))).alias(name) for name in ranks]
    )


# --- deltas and rates ---------------------------------------------------------------------------


def interval_deltas(totals: DataFrame, on: Lane, counters: Sequence[str]) -> DataFrame:
    """Running totals as the change since the previous row; the first row reports its whole total."""
    before = previous(totals, on, **{f"__b_{c}": F.col(c) for c in counters})
    return before.select(
        *[c for c in totals.columns if c not in counters],
        *[(F.col(c) - F.coalesce(f"__b_{c}", F.lit(0))).alias(c) for c in counters],
    )


def fleet_feed(deltas: DataFrame, counters: Sequence[str], at_us: str, window_us: int = 2_000_000) -> DataFrame:
    """Per-stream deltas summed over the fleet per window; a counter that did not move reports nothing."""
    slot = (F.floor(F.col(at_us) / F.lit(window_us)) * window_us).alias("window_us")
    wide = deltas.groupBy(slot).agg(*[F.sum(c).cast("long").alias(c) for c in counters])
    return wide.unpivot("window_us", list(counters), "counter", "amount").where("amount <> 0")


def throughput_bps(totals: DataFrame, on: Lane, total: str = "bytes", at_us: str = "at_us") -> DataFrame:
    """Bits a second since the previous sample; null for the first, a reset, or no time passed."""
    before = previous(totals, on, __bytes=F.col(total), __at=F.col(at_us))
    seconds = (F.col(at_us) - F.col("__at")) / 1e6
    moved = F.col(total) - F.col("__bytes")
    rate = F.when((seconds > 0) & (moved >= 0), moved * 8 / F.when(seconds > 0, seconds))
    return before.withColumn("bits_per_second", rate).drop("__bytes", "__at")


def observed_rate(samples: DataFrame, on: Lane, packets: str = "packets", at_us: str = "at_us", least_seconds: float = 1.0) -> DataFrame:
    """Packets a second over each sampling window, reported as the smaller of it and the one before.

    ``on`` is keyed by stream and connection.  A window closes with the first poll at least ``least_seconds`` after the
    poll that closed the one before; polls in between repeat what was last reported and have no ``window_rate``.  The
    first row of a connection only sets the mark, and its first window reports zero.  With ``least_seconds`` 0 every
    poll closes a window; one without length has an infinite rate, or NaN if nothing came.
    """
    spot = [*on.keys, *on.order]
    timed = samples.select(*spot, F.col(packets).alias("__p"), F.col(at_us).alias("__us"), (F.col(at_us) / 1e6).alias("__s"))
    closing = due_rows(timed, on, "__s", 1 / least_seconds if least_seconds > 0 else float("inf"))
    marked = previous(closing, on, __bp=F.col("__p"), __bus=F.col("__us"))
    came, lasted = F.col("__p") - F.col("__bp"), (F.col("__us") - F.col("__bus")) / 1e6
    rate = F.when(lasted == 0, came * F.lit(float("inf"))).otherwise(came / F.when(lasted != 0, lasted))
    measured = marked.select(*spot, rate.alias("window_rate"))
    again = previous(measured, on, __before=F.col("window_rate"))
    rate = F.least(F.col("window_rate"), F.coalesce("__before", F.lit(0.0)))
    closed = again.select(*spot, "window_rate", F.coalesce(F.when(F.col("window_rate").isNotNull(), rate), F.lit(0.0)).alias("__rate"))
    every = samples.join(closed, spot, "left")
    told = previous(every, on, where=F.col("__rate").isNotNull(), inclusive=True, observed_rate=F.col("__rate"))
    return told.drop("__rate")


def snapshot_delta(before: DataFrame, after: DataFrame, seconds: float) -> DataFrame:
    """Streams in both snapshots: bytes and packets between them, and the rate."""
    earlier = before.select("name", F.col("bytes").alias("b0"), F.col("packets").alias("p0"))
    bits = (F.col("bytes") - F.col("b0")) * 8
    return after.join(earlier, "name").select(
        "name",
        (F.col("bytes") - F.col("b0")).alias("bytes"),
        (F.col("packets") - F.col("p0")).alias("packets"),
        (bits / F.lit(float(seconds))).alias("bits_per_second"),
    )


def delivery_report(rates: DataFrame, offered_bps: float) -> DataFrame:
    """Median, 95th percentile, slowest and delivered share of per-stream rates (whole bits a second)."""
    last = F.col("n") - 1
    ranks = {"median": F.floor(F.col("n") / 2), "p95": F.least(F.floor(F.col("n") * 0.95), last), "slowest": last}
    spread = nearest_rank(rates, [], "bps", ranks, 1 << 14)
    share = F.col("total") / (F.col("n") * F.lit(float(offered_bps)))
    return spread.select(
        F.col("n").alias("streams"), "median", "p95", "slowest", F.col("total").alias("total_bps"), share.alias("delivered_share")
    )


# --- alerts and conditions ----------------------------------------------------------------------


def sliding(df: DataFrame, at_us: str, window_us: int, slide_us: int, keys: Sequence[str], partials: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """Sliding-window aggregates from one pre-aggregated row per slide, so rows are not copied per window."""
    if window_us % slide_us:
        raise ValueError("the window must be a whole number of slides")
    slot = F.floor(F.col(at_us) / F.lit(slide_us)) * slide_us
    slots = df.groupBy(*keys, slot.alias("__slot")).agg(*[c.alias(n) for n, c in partials.items()])
    back = window_us - slide_us
    starts = F.sequence(F.col("__slot") - back, F.col("__slot"), F.lit(slide_us).cast("long"))
    return slots.withColumn("window_us", F.explode(starts)).groupBy(*keys, "window_us").agg(
        *[c.alias(n) for n, c in merge.items()]
    )


def error_increase_alert(samples: DataFrame, window_us: int = 30_000_000, slide_us: int = 2_000_000, min_beats: int = 15) -> DataFrame:
    """Windows in which a pod's error counter rose over at least ``min_beats`` beats.

    ``samples(pod, at_us, errors)``; windows with fewer beats cannot be judged and are left out.
    """
    wide = sliding(
        samples, "at_us", window_us, slide_us, ["pod"],
        {"lo": F.min("errors"), "hi": F.max("errors"), "n": F.count(F.lit(1))},
        {"lo": F.min("lo"), "hi": F.max("hi"), "beats": F.sum("n")},
    )
    judged = wide.where(F.col("beats") >= min_beats)
    return judged.select("pod", "window_us", "beats", (F.col("hi") - F.col("lo")).alias("increase")).where("increase > 0")


def slow_beat_alert(samples: DataFrame, limit: float = 2.0, window_us: int = 30_000_000, slide_us: int = 2_000_000) -> DataFrame:
    """Windows whose 99th percentile beat takes ``limit`` seconds or more. ``samples(pod, at_us, seconds)``."""
    wide = sliding(
        samples, "at_us", window_us, slide_us, ["pod"],
        {"fast": F.count_if(F.col("seconds") < limit), "n": F.count(F.lit(1))},
        {"fast": F.sum("fast"), "beats": F.sum("n")},
    )
    return wide.where(F.col("fast") * 100 < F.col("beats") * 99).select("pod", "window_us", "beats", "fast")


def changed_only(rows: DataFrame, on: Lane, watched: Column) -> DataFrame:
    """Rows that differ from the one before them in their lane (the first always does)."""
    marked = rows.withColumn("__w", F.struct(watched.alias("v")))
    before = previous(marked, on, __before=F.col("__w"))
    return before.where(F.col("__before").isNull() | ~F.col("__w").eqNullSafe(F.col("__before"))).drop("__w", "__before")


def condition_since(rows: DataFrame, on: Lane, holds: Column, at_us: str, name: str = "since_us") -> DataFrame:
    """When the condition that holds on a row began without a break; null where it does not hold."""
    flagged = rows.withColumn("__h", F.coalesce(holds, F.lit(False)))
    # The first row of the current run is the first holding row after the last clear one.
    cleared = running(flagged, on, __island=("count", F.when(~F.col("__h"), 1)))
    begun = cleared.where("__h").groupBy(*on.keys, "__island").agg(F.min(at_us).alias(name))
    return (
        cleared.join(begun, [*on.keys, "__island"], "left")
        .withColumn(name, F.when(F.col("__h"), F.col(name)))
        .select(*rows.columns, name)
    )


def stream_health(beats: DataFrame, on: Lane) -> DataFrame:
    """Interrupted, Lost (in this or the two beats before), Dropped, or Healthy.

    ``beats(state, lost, dropped, startable, ceiling_binding)``.
    """
    recent = preceding(beats, on, 2, "__recent", F.col("lost"))
    lost = F.greatest(F.col("lost"), F.coalesce(F.array_max("__recent"), F.lit(0)))
    health = (
        F.when(F.col("state") == "Interrupted", "Interrupted")
        .when(lost > 0, "Lost")
        .when((F.col("dropped") > 0) | ~F.col("startable") | F.col("ceiling_binding"), "Dropped")
        .otherwise("Healthy")
    )
    return recent.withColumn("health", health).drop("__recent")
