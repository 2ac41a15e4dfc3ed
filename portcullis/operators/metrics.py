"""Telemetry over the audit view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(events: DataFrame, *keys: Column | str) -> DataFrame:
    """Counts by key; null and empty keys are left out."""
    keyed = events.groupBy(*keys).agg(F.count("*").alias("n"))
    for name in keyed.columns[:-1]:
        keyed = keyed.where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return keyed


#: Bins of the histogram for each e-fold of a value: the values of a bin differ by a hundred-thousandth.
BINS = 100_000


def _bin(value: Column) -> Column:
    """The bin of a value, in the order of values; infinities and NaN have the outermost."""
    size = F.abs(value.cast("double"))
    inside = (F.signum(value.cast("double")) * F.floor(F.log1p(size) * BINS)).cast("long")
    return F.when(F.isnan(size), 1 << 62).when(size == float("inf"), F.signum(value.cast("double")).cast("long") * (1 << 61)).otherwise(inside)


def _at_places(values: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Count and the values at places (from 0) of each key's sorted values.

    A histogram of each key tells the bin that holds a place and how many values stand before it; then the
    values of that bin alone are counted and ranked. Bins and equal values are counted before the shuffle, so a
    key with any share of the rows brings its bins, and nothing sorts or holds its values.
    """
    rows = values.where(F.col(value).isNotNull()).select(key, F.col(value).alias("__v"), _bin(F.col(value)).alias("__bin"))
    bins = rows.groupBy(key, "__bin").agg(F.count("*").alias("__n"))
    own = Window.partitionBy(key)
    ranked = bins.withColumns({"__before": F.sum("__n").over(own.orderBy("__bin")) - F.col("__n"), "__all": F.sum("__n").over(own)})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("__all")).cast("long").alias("place")) for name, place in places.items()])).alias("__x")
    held = ranked.select(key, "__bin", "__before", "__n", "__all", wanted).where("__x.place between __before and __before + __n - 1")
    # A row for each key and place; null keys are a key like others.
    sought = held.select(F.col(key).alias("__key"), F.col("__bin").alias("__in"), F.col("__x.name").alias("__name"), (F.col("__x.place") - F.col("__before")).alias("__place"), F.col("__all"))
    inside = rows.join(sought.select("__key", "__in").distinct(), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bin") == F.col("__in")), "left_semi").groupBy(key, "__bin", "__v").agg(F.count("*").alias("__n"))
    to = F.sum("__n").over(Window.partitionBy(key, "__bin").orderBy("__v"))
    counted = inside.withColumn("__to", to)
    met = counted.join(sought, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bin") == F.col("__in")) & F.col("__place").between(F.col("__to") - F.col("__n"), F.col("__to") - 1))
    return met.groupBy(key).agg(F.max("__all").alias("n"), *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in places])


def nearest_even_percentiles(values: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """The value at place round(q (n - 1)), halves to the even place, rounded to 3 places."""
    places = {f"p{int(q * 100)}": (lambda n, q=q: F.bround(F.lit(q) * (n - 1))) for q in shares}
    found = _at_places(values, key, value, places)
    return found.select(key, "n", *[F.round(p, 3).alias(p) for p in places])


def nearest_rank_percentiles(values: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """The value at place ceil(q n) - 1."""
    return _at_places(values, key, value, {f"p{int(q * 100)}": (lambda n, q=q: F.greatest(F.lit(0), F.ceil(F.lit(q) * n) - 1)) for q in shares})


def half_up_percentiles(values: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """The value at place round(q n + 0.5) - 1, kept inside the list."""
    places = {f"p{int(q * 100)}": (lambda n, q=q: F.greatest(F.lit(0), F.least(n - 1, F.bround(F.lit(q) * n + 0.5) - 1))) for q in shares}
    return _at_places(values, key, value, places)


def top_and_other(counted: DataFrame, key: str, n: int) -> DataFrame:
    """The n - 1 largest and the sum of the rest as ``Other``; ties go to the smaller key."""
    heads = counted.orderBy(F.col("n").desc(), key).limit(n - 1).withColumn("__head", F.lit(True))
    marked = counted.join(F.broadcast(heads.select(key, "__head")), key, "left")
    return marked.groupBy(F.when(F.col("__head"), F.col(key)).otherwise("Other").alias(key)).agg(F.sum("n").alias("n"))


def filtered(audit: DataFrame, *, since: Column | None = None, until: Column | None = None, action: str | None = None, identity: str | None = None, endpoint: str | None = None, severity: str | None = None) -> DataFrame:
    """The filters that are set, both ends of the time range included."""
    if since is not None:
        audit = audit.where(F.col("ts") >= since)
    if until is not None:
        audit = audit.where(F.col("ts") <= until)
    for column, value in (("final_action", action), ("identity", identity), ("endpoint", endpoint), ("severity", severity)):
        if value is not None:
            audit = audit.where(F.col(column) == value)
    return audit


# Fixed value: actions that a console knows by name.
KNOWN_ACTIONS = ("allow", "flag", "redact", "require_approval", "block")


def console_filter(events: DataFrame, **wanted: str) -> DataFrame:
    """Every filter of the console that is set and not empty: ``action`` (``unknown``: none that is known), ``type``,
    ``severity``, ``identity``, ``endpoint``, ``policy_version``, ``control`` and ``threat`` (among the event's lists
    control_ids and threat_ids), and ``q``, a part of the request's, session's or event's id in any case."""
    for name, value in wanted.items():
        if not value:
            continue
        if name == "q":
            q = value.strip().lower()
            has = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(q)) for c in ("request_id", "session_id", "event_id")]
            events = events.where(has[0] | has[1] | has[2] | F.lit(q == ""))
        elif name in ("control", "threat"):
            events = events.where(F.array_contains(f"{name}_ids", value))
        elif name == "action":
            own = F.col("final_action") == value
            events = events.where(F.coalesce(own | ~F.col("final_action").isin(*KNOWN_ACTIONS), F.lit(True)) if value == "unknown" else own)
        elif name in ("type", "severity", "identity", "endpoint", "policy_version"):
            events = events.where(F.col(name) == value)
        else:
            raise ValueError(f"no filter {name}")
    return events


def slowest(values: DataFrame, key: str, value: str, share: float = 0.95, most: int = 12) -> DataFrame:
    """I8: the keys with the highest percentile, the highest first; of equal ones the smaller key."""
    name = f"p{int(share * 100)}"
    return nearest_rank_percentiles(values, key, value, (share,)).orderBy(F.col(name).desc(), key).limit(most)


def stack_report(cases: DataFrame) -> DataFrame:
    """(category, lang, attacks, detected, benign, false_positives, errors) by category, by language and in
    all. ``cases`` has category, lang, expect (block, allow) and outcome (block, allow, error)."""
    n = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
    attack, benign, blocked = F.col("expect") == "block", F.col("expect") == "allow", F.col("outcome") == "block"
    grouped = cases.groupingSets([[F.col("category")], [F.col("lang")], []], "category", "lang")
    return grouped.agg(n(attack, "attacks"), n(attack & blocked, "detected"), n(benign, "benign"), n(benign & blocked, "false_positives"), n(F.col("outcome") == "error", "errors"))


def caught_by(cases: DataFrame) -> DataFrame:
    """What each control stopped, the most first."""
    return cases.where("outcome = 'block'").groupBy("control").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "control")


def newest(audit: DataFrame, limit: int) -> DataFrame:
    """Newest first, 1 to 5000 of them."""
    return audit.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(max(1, min(limit, 5000)))


def detection_report(cases: DataFrame, key: str) -> DataFrame:
    """Detection rate over negative cases (must be stopped), false positives over positive ones."""
    stopped = F.col("stopped").cast("int")
    share = lambda kind: F.round(F.avg(F.when(F.col("kind") == kind, stopped)), 6)
    return cases.groupBy(key).agg(
        F.count(F.when(F.col("kind") == "negative", 1)).alias("negatives"),
        F.count(F.when(F.col("kind") == "positive", 1)).alias("positives"),
        share("negative").alias("detection_rate"),
        share("positive").alias("false_positive_rate"),
    )
