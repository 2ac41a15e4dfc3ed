"""Scalar functions of the gateway's analytics as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Precedence of actions, severities, window lengths in seconds.
ACTIONS = ("allow", "flag", "redact", "require_approval", "block")
SEVERITIES = ("low", "medium", "high", "critical")
WINDOWS = {"minute": 60, "hour": 3600, "day": 86400}
# Words that hint at a rotated text.
ROT13_HINTS = "the and you ignore previous instructions system prompt password secret reveal print forget all rules key token admin execute command delete".split()
# Function words that tell English from other European languages.
ENGLISH = (
    "a about all also an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its just me more my new no not "
    "now of on one only or our out please she should so some than that the their them then there these they this to up us was we were what when where which who will with "
    "would you your"
).split()
OTHER = frozenset(
    """
    w z na nie się że jak co jest mi po od za czy ale tak dla tylko jeśli proszę mój moje mojej mnie
    der das und ist nicht ich du sie es mit zu den von für auf ein eine dem bitte wie was mir mein meine meiner
    el la los las y es en de que por para con una un del al lo como pero tu mis
    le les et est pas je il elle des du une pour avec qui dans sur ce mon ma mes
    lo gli è che di della come ma os é não um uma da em mas meu het een niet ik je dat voor met op te wat
    je se v že jak pro jsem och är det att som på för jag inte ve bir bu da için ile ne ben sen değil
    im wurde zusammen e quanto minha seu sua jako bez dla
    """.split()
) - {*ENGLISH, "die", "men", "son", "dim", "ten", "pas", "con", "pro"}
ROTATED = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm")
DIACRITICS = "[ąćęłńśźżäöüßñáéíóúàèìòùçãõřěůšžčýğışåøæ]"


def _rank(value: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), value).cast("int") - 1


def action_rank(action: Column) -> Column:
    """allow 0 .. block 4; -1 for anything else."""
    return _rank(action, ACTIONS)


def severity_rank(severity: Column) -> Column:
    return _rank(severity, SEVERITIES)


def action_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACTIONS)), rank + 1)


def mask(text: Column) -> Column:
    """The first four characters and stars, 24 characters at most; short texts are stars alone."""
    size = F.least(F.length(text), F.lit(24))
    return F.when(F.length(text) <= 4, F.repeat(F.lit("*"), F.length(text))).otherwise(F.rpad(F.substring(text, 1, 4), size, "*"))


def round_double(value: Column, digits: int) -> Column:
    """A double rounded as the number that it is, halves away from zero; ``round`` takes the shortest decimal that
    stands for it, which may lie on a half where the number lies below."""
    scaled = value * 10**digits
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 10**digits


def window_bucket(epoch: Column, name: str) -> Column:
    """``day:20364``: windows aligned to the epoch, in UTC (C14)."""
    return F.concat(F.lit(f"{name}:"), F.floor(epoch / WINDOWS[name]).cast("long").cast("string"))


def window_expiry(epoch: Column, name: str) -> Column:
    return (F.floor(epoch / WINDOWS[name]).cast("long") + 1) * WINDOWS[name]


def tokens_of_segment(text: Column) -> Column:
    """A quarter of the characters, rounded down for each segment."""
    return F.floor(F.length(text) / 4).cast("long")


def chunks(text: Column, size: int = 2000, overlap: int = 200, most: int = 8) -> Column:
    """Overlapping pieces; of too many the first ones and the text's end."""
    step = size - overlap
    number = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    kept = F.concat(F.slice(pieces, 1, most - 1), F.array(F.right(text, F.lit(size))))
    return F.when(number > most, kept).otherwise(pieces)


def truncate_middle(text: Column, limit: int) -> Column:
    """The first 70 % and the last 30 % of the limit."""
    head = limit * 7 // 10
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(limit - head))))


def spread_windows(text: Column, limit: int, n: int) -> Column:
    """``n`` windows of ``limit`` characters at even distances; the whole text if it is short."""
    last = F.length(text) - limit
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, F.floor(i * last / max(1, n - 1)).cast("int") + 1, F.lit(limit)))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(places)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 0)


def is_prose(text: Column, least: int = 12, share: float = 0.6) -> Column:
    """At least twelve tokens that are words, and these at least 60 % of all (C20)."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: F.length(t) > 0)
    good = F.size(F.filter(tokens, lambda t: t.rlike(r"^[(\"']*\p{L}[\p{L}'-]*[.,;:!?)\"']*$")))
    return (good >= least) & (good >= share * F.size(tokens))


def is_english(text: Column) -> Column:
    """Mostly Latin letters, and no more foreign words than English function words."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    beyond = F.length(F.regexp_replace(text, r"[\P{L}\u0000-ɏ]+", ""))
    whole = lambda names: rf"(?:{'|'.join(sorted(names))})(?!\p{{L}})"
    en = F.regexp_count(F.lower(text), F.lit(rf"(?<!\p{{L}}){whole(ENGLISH)}"))
    foreign = F.regexp_count(F.lower(text), F.lit(rf"(?<!\p{{L}})(?:{whole(OTHER)}|\p{{L}}*{DIACRITICS}\p{{L}}*)"))
    return (letters > 0) & (beyond <= 0.2 * letters) & (foreign <= en)


def scrub(text: Column, limit: int = 200) -> Column:
    """One line of at most ``limit`` characters; addresses, long tokens and numbers masked."""
    line = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)
    line = F.regexp_replace(line, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>")
    line = F.regexp_replace(line, r"[A-Za-z0-9+/_-]{16,}", "<token>")
    return F.regexp_replace(line, r"[0-9]{6,}", "<number>")


def rot13_of(text: Column) -> Column:
    """The letters of the alphabet turned by 13."""
    return F.translate(text, *ROTATED)


def rot13(text: Column) -> Column:
    """The rotated text if it has at least two hint words and more than before, else null."""
    rotated = rot13_of(text)
    count = lambda t: F.regexp_count(F.lower(t), F.lit(rf"(?<![a-z])(?:{'|'.join(ROT13_HINTS)})(?![a-z])"))
    return F.when((count(rotated) >= 2) & (count(rotated) > count(text)), rotated)


def severity_band(score: Column) -> Column:
    """.95 critical, .85 high, .65 medium."""
    return F.when(score >= 0.95, "critical").when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")


def change(now: Column, before: Column) -> tuple[Column, Column]:
    """Difference and ratio; no ratio to zero."""
    return now - before, F.try_divide(now - before, before)


def budget_level(used: Column, limit: Column) -> Column:
    """exceeded, high, warning, ok or unlimited; a limit of zero is a limit."""
    share = F.when(limit == 0, F.when(used > 0, 1.0).otherwise(0.0)).otherwise(used / limit)
    return F.when(limit.isNull(), "unlimited").when(share >= 1, "exceeded").when(share >= 0.9, "high").when(share >= 0.7, "warning").otherwise("ok")


def visible_text(html: Column) -> Column:
    """Comments unwrapped, tags dropped, entities of spaces and brackets read, one line."""
    text = F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<!--", " "), r"-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


def hidden_text(html: Column) -> Column:
    """What readers of a page don't see: comments and descriptive attributes."""
    comments = F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"))
    return F.concat(comments, F.regexp_extract_all(html, F.lit(r'(?:alt|title|aria-label)="([^"]*)"')))


def iso_time(text: Column) -> Column:
    """An instant as ``2024-01-01T00:00:00.000Z``. Numbers below 1e11 are seconds, others milliseconds; texts
    without a zone are in UTC; null for what is neither."""
    number = text.try_cast("decimal(24,6)")
    micros = F.when(number < 100_000_000_000, number * 1_000_000).otherwise(number * 1000)
    at = F.coalesce(F.timestamp_micros(F.floor(micros).cast("long")), F.try_to_timestamp(F.when(number.isNull(), text)))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# Keys of a record that a display never shows.
CREDENTIAL_KEYS = ("api_key", "authorization", "password", "secret", "token")


def display_safe(fields: Column) -> Column:
    """map<string,string> without credentials, and with the values of bearer headers masked."""
    shown = F.map_filter(fields, lambda k, _: ~F.lower(k).isin(*CREDENTIAL_KEYS))
    return F.transform_values(shown, lambda _, v: F.regexp_replace(v, "(?i)bearer +[^ ]+", "Bearer ***"))
