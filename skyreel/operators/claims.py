"""Who holds a stream over time: detector leases and name claims, as rules over ordered events.

The rules are small state machines.  A claim that comes after every earlier lease has run out is granted
whatever came before, so the log falls apart there and the pieces run in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Lane, running, sessions
from .sequential import replay

LEASE_US = 10_000_000
BEAT_US = 2_000_000
GRACE_US = 30_000_000


class Lease:
    """A detector's hold on one stream."""

    def __init__(self, lease_us: int = LEASE_US):
        self.lease_us, self.worker, self.seen_us = lease_us, None, None

    def apply(self, action: str, worker: str | None, at_us: int) -> bool:
        """Whether the event did what it asked for."""
        if action == "claim":
            live = self.worker is not None and at_us - self.seen_us <= self.lease_us
            if live and self.worker != worker:
                return False
            self.worker, self.seen_us = worker, at_us
            return True
        if action == "release":
            if self.worker is None or self.worker != worker:
                return False
        self.worker = None  # released, or detection switched off
        return True

    def holder(self, at_us: int) -> str | None:
        return self.worker if self.worker is not None and at_us - self.seen_us <= self.lease_us else None


class NameClaim:
    """One stream name among replicas that keep beating while they own it."""

    def __init__(self, beat_us: int = BEAT_US, grace_us: int = GRACE_US):
        self.alive_us, self.grace_us = 3 * beat_us, grace_us
        self.owner, self.beat_at, self.started, self.live = None, None, None, False

    def hold(self, owner: str, beat_at: int, started: int, live: bool) -> None:
        """What the registry says of the name: whose it is, and whether it is live or only waits for its feed."""
        self.owner, self.beat_at, self.started, self.live = owner, beat_at, started, live

    def apply(self, owner: str, at_us: int) -> str:
        age = None if self.owner is None else at_us - self.beat_at
        if age is not None and self.live and self.owner != owner and age <= self.alive_us:
            return "refused"
        resumed = age is not None and age <= self.grace_us
        if not resumed:
            self.started = at_us
        self.owner, self.beat_at, self.live = owner, at_us, True
        return "resumed" if resumed else "taken"


def detector_leases(events: DataFrame, on: Lane, lease_us: int = LEASE_US) -> DataFrame:
    """``events(stream, seq, at_us, action, worker)`` with what each achieved and who holds the stream then."""
    claim_at = F.when(F.col("action") == "claim", F.col("at_us"))
    seen = running(events, on, inclusive=False, __claimed=("max", claim_at))
    quiet = (F.col("action") == "claim") & (F.col("__claimed").isNull() | (F.col("at_us") - F.col("__claimed") > lease_us))
    pieces = sessions(seen, on, quiet, "__piece").drop("__claimed")
    keys, order = list(on.keys), list(on.order)
    types = dict(events.dtypes)
    fields = ", ".join(f"{c} {types[c]}" for c in [*keys, "seq", "at_us", "action", "worker"])
    columns = [*keys, "seq", "at_us", "action", "worker"]
    return replay(
        pieces.select(*columns, "__piece"), [*keys, "__piece"], order,
        lambda: _Leases(lease_us), f"{fields}, granted boolean, holder string",
    )


class _Leases:
    def __init__(self, lease_us: int):
        self.lease = Lease(lease_us)

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for *event, _piece in rows:
            at, action, worker = event[-3:]
            out.append((*event, self.lease.apply(action, worker, at), self.lease.holder(at)))
        return out

    def finish(self) -> list[tuple]:
        return []


def name_claims(attempts: DataFrame, on: Lane, beat_us: int = BEAT_US, grace_us: int = GRACE_US, held: DataFrame | None = None) -> DataFrame:
    """``attempts(name, seq, at_us, owner)`` with their outcome and the start time the stream then has.

    ``held(name, owner, state, heartbeat_us, started_us)``, a row a name, is the registry as it stood before: only a live holder refuses others.
    """
    seen = running(attempts, on, inclusive=False, __before=("max", F.col("at_us")))
    keys, order = list(on.keys), list(on.order)
    columns = [*keys, "seq", "at_us", "owner"]
    if held is None:
        seen = seen.withColumn("__held", F.lit(None).cast("struct<owner: string, heartbeat_us: bigint, started_us: bigint, live: boolean>"))
    else:
        was = held.select(*keys, F.struct("owner", "heartbeat_us", "started_us", (F.col("state") == "Live").alias("live")).alias("__held"))
        seen = seen.join(was, keys, "left")
    before = F.greatest("__before", F.when(F.col("__before").isNotNull(), F.col("__held.heartbeat_us")))
    rested = before.isNull() | (F.col("at_us") - before > max(grace_us, 3 * beat_us))
    pieces = sessions(seen, on, rested, "__piece")
    first = F.when(F.col("__piece") == 1, F.col("__held"))  # later pieces began when no earlier holder counted any more
    rows = pieces.select(*columns, *[first[c].alias(f"__{c}") for c in ("owner", "heartbeat_us", "started_us", "live")], "__piece")
    types = dict(attempts.dtypes)
    fields = ", ".join(f"{c} {types[c]}" for c in columns)
    return replay(rows, [*keys, "__piece"], order, lambda: _Claims(beat_us, grace_us), f"{fields}, outcome string, started_us long")


class _Claims:
    def __init__(self, beat_us: int, grace_us: int):
        self.claim, self.fresh = NameClaim(beat_us, grace_us), True

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for *attempt, holder, heartbeat, started, live, _piece in rows:
            if self.fresh and holder is not None:
                self.claim.hold(holder, heartbeat, started, live)
            self.fresh = False
            at, owner = attempt[-2:]
            out.append((*attempt, self.claim.apply(owner, at), self.claim.started))
        return out

    def finish(self) -> list[tuple]:
        return []
