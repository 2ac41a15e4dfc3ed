"""Signature feeds and pattern controls."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.functions.columns import SEVERITIES, severity_rank

# What a signature adds to a request's risk.
RISK = {"low": 0.2, "medium": 0.5, "high": 0.8, "critical": 1.0}


def merge_feeds(feeds: DataFrame, order: tuple[str, ...] = ("feed",)) -> DataFrame:
    """Of a repeated id the entry that sorts first by ``order``."""
    others = [c for c in feeds.columns if c != "id"]
    first = feeds.groupBy("id").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__first"))
    return first.select("id", *[F.col(f"__first.`{c}`").alias(c) for c in others])


def java(pattern: str) -> str:
    """Unicode classes and case in Java's dialect, as the patterns mean them."""
    return "(?U)" + pattern.replace("(?i)", "(?iu)")


def hits(text: Column, signatures: Iterable[dict], least: str = "low", decoded: Column | None = None) -> Column:
    """array<struct<id, severity>>: each pattern a literal, so that it is compiled once and needs no join.

    A signature counts once for a text and all the texts that are ``decoded`` from it (array<struct<text, codec>>).
    """
    none = F.lit(None).cast("struct<id:string,severity:string>")
    floor = SEVERITIES.index(least)

    def found(pattern: str) -> Column:
        own = F.coalesce(text.rlike(pattern), F.lit(False))
        return own if decoded is None else own | F.coalesce(F.exists(decoded, lambda d: d["text"].rlike(pattern)), F.lit(False))

    each = [
        F.when(found(java(s["pattern"])), F.struct(F.lit(s["id"]).alias("id"), F.lit(s["severity"]).alias("severity"))).otherwise(none)
        for s in signatures
        if SEVERITIES.index(s["severity"]) >= floor
    ]
    return F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<struct<id:string,severity:string>>")


def _decoded(segments: DataFrame) -> Column | None:
    return F.col("decoded") if "decoded" in segments.columns else None


def views(segments: DataFrame) -> DataFrame:
    """``segments`` once for each of its texts: ``view`` is text, norm, decoded or args, ``seen`` the text."""
    kinds = [("text", "text"), ("norm", "norm"), ("args", "args")]
    plain = F.array(*[F.struct(F.lit(view).alias("view"), F.col(c).alias("seen")) for view, c in kinds if c in segments.columns])
    decoded = _decoded(segments)
    every = plain if decoded is None else F.concat(plain, F.transform(decoded, lambda d: F.struct(F.lit("decoded").alias("view"), d["text"].alias("seen"))))
    return segments.withColumn("__view", F.explode(every)).withColumns({"view": F.col("__view.view"), "seen": F.col("__view.seen")}).drop("__view").where("seen is not null")


def signature_hits(segments: DataFrame, request: str, signatures: list[dict], least: str = "low") -> DataFrame:
    """(request, id, severity, view), once for each signature and kind of view."""
    found = views(segments).withColumn("hit", F.explode(hits(F.col("seen"), signatures, least)))
    return found.select(request, F.col("hit.id").alias("id"), F.col("hit.severity").alias("severity"), "view").distinct()


# What tells of code that is to be run, by family.
CODE = {
    "shell_metachar_chain": [
        r"(?i)(?:^|[;&|\n`$])\s*(?:rm\s+-[rf]{1,2}|sh\s+-c|bash\s+-c|cat\s+/etc/shadow|cat\s+/etc/passwd|chmod\s+[0-7]{3,4})\b",
        r"(?i)[;&|`]\s*(?:/bin/)?(?:bash|sh|zsh|dash)\b",
        r"(?i)\$\((?:/bin/)?(?:bash|sh|curl|wget|nc|python)\b",
        r"(?i);\s*(?:rm|reboot|shutdown|mkfs|dd\s+if=)\b",
    ],
    "eval_exec": [
        r"(?i)\b(?:eval|exec)\s*\([^)]*?\b(?:__import__|os\.|subprocess\.|open\s*\(|compile\s*\()",
        r"(?i)\b__import__\s*\(\s*['\"](?:os|subprocess|pty|socket)['\"]\s*\)",
        r"(?i)\bgetattr\s*\(\s*__builtins__\s*,\s*['\"](?:eval|exec)['\"]\s*\)",
        r"(?i)\bcompile\s*\(.*?['\"](?:exec|eval)['\"]\s*\)",
    ],
    "curl_pipe_sh": [
        r"(?i)\bcurl\s+[^|\n]+?\|\s*(?:/bin/)?(?:ba|z|da)?sh\b",
        r"(?i)\bwget\s+[^|\n]+?\|\s*(?:/bin/)?(?:ba|z|da)?sh\b",
        r"(?i)\bcurl\s+[^|\n]+?-[oO]\s+[^|\n]+?&&\s*(?:/bin/)?(?:ba|z|da)?sh\b",
        r"(?i)\bcurl\s+[^|\n]+?\|\s*(?:/bin/)?python\b",
    ],
    "reverse_shell": [
        r"(?i)(?:/bin/)?(?:ba|z)?sh\s+-i\s+>(?:&|/dev/tcp/)",
        r"(?i)\b(?:nc|ncat|netcat)\s+(?:-e\s+|-c\s+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}\s+[0-9]{2,5})",
        r"(?i)/dev/tcp/(?:[0-9]{1,3}\.){3}[0-9]{1,3}/[0-9]{2,5}",
        r"(?is)\bsocket\.socket\b.*?\bconnect\s*\(.*?\bexec\b",
        r"(?i)\bmkfifo\s+/tmp/.*?/bin/(?:ba)?sh",
    ],
}


def code_execution(segments: DataFrame, request: str, feed: Iterable[dict] = ()) -> DataFrame:
    """(request, families): families of code in text, decoded texts and arguments (the norm, which has lost its
    lines, isn't looked at), and signatures of a feed, as array<string> in the order of their names."""
    named = [{"id": family, "severity": "critical", "pattern": p} for family, patterns in CODE.items() for p in patterns]
    found = views(segments).where("view <> 'norm'").withColumn("hit", F.explode(hits(F.col("seen"), [*named, *feed])))
    return found.groupBy(request).agg(F.array_sort(F.collect_set("hit.id")).alias("families"))


def pattern_control(segments: DataFrame, request: str, signatures: list[dict], least: str = "low", origins: tuple[str, ...] = ("user", "tool_result", "retrieved", "artifact")) -> DataFrame:
    """E5: risk once for each (segment, signature), whether in its norm or in what is decoded, at most 1; the strongest severity, the first three ids
    and how many more."""
    scanned = segments.where(F.col("origin").isin(*origins)).withColumn("hit", F.explode(hits(F.col("norm"), signatures, decoded=_decoded(segments))))
    risk = F.element_at(F.create_map(*[F.lit(x) for kv in RISK.items() for x in kv]), F.col("hit.severity"))
    order = F.array_sort(F.collect_set(F.struct((-severity_rank(F.col("hit.severity"))).alias("r"), F.col("hit.id").alias("id"))))
    found = scanned.groupBy(request).agg(
        F.least(F.lit(1.0), F.round(F.sum(risk), 6)).alias("risk"),
        F.max(severity_rank(F.col("hit.severity"))).alias("rank"),
        F.max((F.col("origin") != "user").cast("int")).alias("indirect"),
        F.transform(order, lambda x: x["id"]).alias("ids"),
    )
    reason = F.concat(F.array_join(F.slice("ids", 1, 3), ", "), F.when(F.size("ids") > 3, F.concat(F.lit(" +"), (F.size("ids") - 3).cast("string"), F.lit(" more"))).otherwise(""))
    return found.select(
        request,
        "risk",
        F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank") + 1).alias("severity"),
        F.when(F.col("indirect") == 1, "TH-02").otherwise("TH-01").alias("threat"),
        reason.alias("reason"),
        F.when(F.col("rank") >= SEVERITIES.index(least), "block").otherwise("allow").alias("action"),
    )


def canary(segments: DataFrame, tokens: list[str]) -> DataFrame:
    """Segments that hold a planted token in their text, norm, decoded texts or arguments."""
    held = lambda t: F.coalesce(F.array_contains(F.array(*[F.contains(t, F.lit(x)) for x in tokens]), True), F.lit(False))
    sides = [held(F.col(c)) for c in ("text", "norm", "args") if c in segments.columns]
    if (decoded := _decoded(segments)) is not None:
        sides.append(F.coalesce(F.exists(decoded, lambda d: held(d["text"])), F.lit(False)))
    return segments.where(F.greatest(*sides, F.lit(False))) if tokens else segments.limit(0)


def weighted_score(text: Column, weights: dict[str, float]) -> Column:
    """The largest weight of the patterns that match."""
    return F.greatest(F.lit(0.0), *[F.when(text.rlike(java(p)), w).otherwise(0.0) for p, w in weights.items()], F.lit(0.0))
