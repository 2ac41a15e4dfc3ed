"""Personal data of all kinds in texts, with numbers planted that are right or wrong by one digit."""

from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.functions import checksums
from portcullis.functions.text import let
from portcullis.operators import detectors as D
from portcullis.plans import register
from portcullis.sources.tables import table

KINDS = ("email", "phone_pl", "pesel", "nip", "regon", "id_card_pl", "iban", "credit_card", "ip_address")
COUNTRIES = list(checksums.IBAN_LENGTHS.items())


def _weighted(text: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"CAST(substr({text}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def _double(text: str) -> str:
    """The Luhn sum of fifteen digits before their check digit."""
    each = lambda i: f"CAST(substr({text}, {i + 1}, 1) AS INT)"
    return "(" + " + ".join(f"{each(i)} * 2 - CASE WHEN {each(i)} > 4 THEN 9 ELSE 0 END" if i % 2 == 0 else each(i) for i in range(15)) + ")"


_ACCOUNT = "substr(d || d || d, 1, CAST(account AS INT) - 4)"
# The numbers are written in SQL that both engines read, from a customer's key: ``ok`` says whether the check digit is right.
PLANTED = f"""SELECT k, d, ok, country, CASE k % 9
  WHEN 0 THEN 'u' || d || CASE WHEN ok THEN '@mail.example' ELSE '@mail' END
  WHEN 1 THEN CASE WHEN ok THEN '+48 ' || substr(d, 1, 3) || ' ' || substr(d, 4, 3) || ' ' || substr(d, 7, 3) ELSE '48 ' || substr(d, 1, 2) || ' ' || substr(d, 3, 2) END
  WHEN 2 THEN d || CAST((10 - {_weighted("d", checksums.PESEL)} % 10 + CASE WHEN ok THEN 0 ELSE 1 END) % 10 AS STRING)
  WHEN 3 THEN substr(d, 1, 9) || CAST(({_weighted("d", checksums.NIP)} % 11 + CASE WHEN ok THEN 0 ELSE 1 END) % 10 AS STRING)
  WHEN 4 THEN substr(d, 1, 8) || CAST(({_weighted("d", checksums.REGON)} % 11 + CASE WHEN ok THEN 0 ELSE 1 END) % 10 AS STRING)
  WHEN 5 THEN 'ABC' || CAST((10 * 7 + 11 * 3 + 12 + {_weighted("d", checksums.ID_CARD[4:])} + CASE WHEN ok THEN 0 ELSE 1 END) % 10 AS STRING) || substr(d, 1, 5)
  WHEN 6 THEN country || substr('0' || CAST(CAST(98 - CAST({_ACCOUNT} || CAST(ascii(substr(country, 1, 1)) - 55 AS STRING) || CAST(ascii(substr(country, 2, 1)) - 55 AS STRING) || '00' AS DECIMAL(38, 0)) % 97 AS INT) + CASE WHEN ok THEN 0 ELSE 1 END AS STRING), -2) || {_ACCOUNT}
  WHEN 7 THEN '4' || substr(e, 1, 14) || CAST((10 - {_double("('4' || substr(e, 1, 14))")} % 10 + CASE WHEN ok THEN 0 ELSE 1 END) % 10 AS STRING)
  ELSE CAST(k % 223 + 1 AS STRING) || '.' || CAST(k % 256 AS STRING) || '.7.' || CASE WHEN ok THEN '9' ELSE '256' END END AS number, said
FROM (SELECT *, CASE k % 14 {" ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(COUNTRIES))} END AS country, CASE k % 14 {" ".join(f"WHEN {i} THEN {n}" for i, (_, n) in enumerate(COUNTRIES))} END AS account
  FROM (SELECT c_custkey AS k, lpad(CAST((c_custkey * 7919 + 1234567) % 10000000000 AS STRING), 10, '3') AS d, lpad(CAST((c_custkey * 7919 + 1234567) * 977 % 100000000000000 AS STRING), 14, '5') AS e, CAST(floor(c_custkey / 9) AS INT) % 2 = 0 AS ok, c_mktsegment AS said FROM customer) x) y"""
#: A remainder of ten has no check digit that is right.
RIGHT = f"(ok AND NOT (k % 9 = 3 AND {_weighted('d', checksums.NIP)} % 11 = 10))"


def _planted(spark, sf_dir):
    # Dealt anew by key: the table is small beside the work on its rows, and comes in few pieces.
    rows = PLANTED.replace("FROM customer", "FROM {customer}")
    made = spark.sql(f"SELECT *, {RIGHT} AS right FROM ({rows}) z", customer=table(spark, sf_dir, "customer")).withColumn("text", F.concat(F.lit("Please note "), "number", F.lit(" for "), "said", F.lit(".")))
    return made.repartition("k")


@register("planted_personal_data", f"""WITH z AS ({PLANTED}) SELECT k % 9 AS kind_no, {RIGHT} AS right, CASE WHEN k % 9 = 6 THEN country END AS country, count(*) AS texts,
CAST(count(*) FILTER ({RIGHT} AND k % 9 <> 8) AS BIGINT) AS inbound, CAST(count(*) FILTER ({RIGHT}) AS BIGINT) AS outbound FROM z GROUP BY ALL""")
def planted_personal_data(spark, sf_dir):
    """Numbers of nine kinds, of fourteen countries for accounts, right or wrong in their last digit:
    those of its own kind that the detectors of requests and of answers find."""
    texts = _planted(spark, sf_dir)
    own = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 9 + 1).cast("int"))
    found_own = F.filter(D.matches(F.col("text"), D.OUTBOUND), lambda m: (m["kind"] == own) & (m["value"] == F.col("number")))
    hits = let(found_own, lambda found: F.struct(F.exists(found, lambda m: m["kind"].isin(*D.INBOUND)).alias("i"), (F.size(found) > 0).alias("o")))
    found = texts.select((F.col("k") % 9).alias("kind_no"), "right", F.when(F.col("k") % 9 == 6, F.col("country")).alias("country"), hits.alias("h")).select("kind_no", "right", "country", "h.i", "h.o")
    return found.groupBy("kind_no", "right", "country").agg(F.count("*").alias("texts"), F.count_if("i").alias("inbound"), F.count_if("o").alias("outbound"))


@register("labelled_personal_data", f"""WITH z AS ({PLANTED}), n AS (SELECT *, CASE k % 9 {" ".join(f"WHEN {i} THEN '<{kind.upper()}>'" for i, kind in enumerate(KINDS))} END AS label FROM z WHERE {RIGHT})
SELECT k, 'Please note ' || label || ' for ' || said || '.' AS labelled, 'Please note for ' || said || '.' AS stripped FROM n""")
def labelled_personal_data(spark, sf_dir):
    """What a judge is shown instead of personal data and secrets: a label, or nothing."""
    texts = _planted(spark, sf_dir).where("right")
    return texts.select("k", D.labelled(F.col("text")).alias("labelled"), D.stripped(F.col("text")).alias("stripped"))


@register("unredactable_decisions", """SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 OR o_totalprice > 300000 OR o_custkey % 50 >= 20 + o_orderkey % 40 THEN 'block' ELSE 'redact' END AS action FROM orders""")
def unredactable_decisions(spark, sf_dir):
    """Redactions whose spans are missing, end beyond the text or before they begin become blocks."""
    orders = table(spark, sf_dir, "orders")
    length = F.lit(60) + 0 * F.col("o_orderkey")
    end = F.when(F.col("o_totalprice") > 300000, length + 1).otherwise(F.lit(20) + F.col("o_orderkey") % 40)
    start = F.when(F.col("o_totalprice") > 300000, F.lit(0)).otherwise(F.col("o_custkey") % 50)
    span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    spans = F.when(F.col("o_custkey") % 4 > 0, F.array(span)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return orders.select("o_orderkey", F.when(D.unredactable(spans, length), "block").otherwise("redact").alias("action"))
