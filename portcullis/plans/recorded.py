"""Queries over recorded requests, texts and policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from portcullis.functions import text as T
from portcullis.operators import approvals as P
from portcullis.operators import readings as N
from portcullis.operators import segments as G
from portcullis.plans import register
from portcullis.plans.audit_view import values
from portcullis.sources import policy as Y
from portcullis.sources import requests as R
from portcullis.sources.tables import table



@register("folded_documents", "SELECT doc_id, md5(lower(trim(regexp_replace(replace(text, 'ß', 'ss'), '\\s+', ' ', 'g')))) AS norm_md5 FROM documents")
def folded_documents(spark, sf_dir):
    """The normal form; these texts have no characters that only compatibility forms change."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold("text")).alias("norm_md5"))


@register("decoded_fragments")
def decoded_fragments(spark, sf_dir):
    """What is encoded in documents, by codec."""
    found = T.segments(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("decoded").alias("f")).groupBy(F.col("f.codec").alias("codec")).agg(F.count("*").alias("fragments"), F.countDistinct("doc_id").alias("documents"))


@register("classifier_texts", r"""WITH s AS (SELECT conv_id, turn, text, lower(trim(regexp_replace(replace(text, 'ß', 'ss'), '\s+', ' ', 'g'))) AS norm FROM conversations),
v AS (SELECT conv_id, turn, 0 AS k, text AS t FROM s UNION ALL SELECT conv_id, turn, 1, norm FROM s WHERE norm <> lower(replace(text, 'ß', 'ss')) UNION ALL SELECT conv_id, turn, 2, reverse(event) FROM (SELECT conv_id, turn, text AS event FROM s WHERE turn % 3 = 0)),
c AS (SELECT conv_id, turn, k, i, CASE WHEN n > 3 AND i = 2 THEN right(t, 300) ELSE substr(t, i * 100 + 1, 300) END AS piece FROM (SELECT *, CAST(CASE WHEN length(t) <= 300 THEN 1 ELSE ceil((length(t) - 200) / 100.0) END AS INTEGER) AS n FROM v), range(0, 3) x(i) WHERE i < n),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, k, i) AS place FROM c WHERE NOT regexp_full_match(piece, '\s*'))
SELECT conv_id, CAST(place AS INTEGER) AS place, turn AS segment, md5(piece) AS text_md5 FROM r WHERE place <= 6""")
def classifier_texts(spark, sf_dir):
    """C17: what a classifier reads of each conversation: the latest turns' texts, normal forms and decoded fragments
    (here every third turn's from its end), in chunks of 300, three of a text and six of a conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("segment"), "text")
    fragments = F.when(F.col("segment") % 3 == 0, F.array(F.struct(F.reverse("text").alias("text"), F.lit("made").alias("codec"))))
    read = N.texts_for(T.with_fold(turns).withColumn("decoded", fragments), "conv_id", 300, 3, 6)
    return read.select("conv_id", "place", "segment", F.md5("text").alias("text_md5"))


@register("new_fragments", r"""WITH f AS (SELECT conv_id, turn, lower(replace(text, 'ß', 'ss')) AS a, CASE turn % 4 WHEN 0 THEN reverse(upper(replace(text, 'ß', 'ss'))) WHEN 1 THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) WHEN 2 THEN left(text, length(text) // 2) ELSE translate(text, 'aeo', '430') END AS fragment FROM conversations),
h AS (SELECT *, lower(replace(fragment, 'ß', 'ss')) AS b, length(regexp_replace(fragment, '[^\p{L}\s]', '', 'g')) AS wordish FROM f),
m AS (SELECT *, list_histogram(string_split(a, '')) AS ha, list_histogram(string_split(b, '')) AS hb FROM h),
s AS (SELECT *, coalesce(list_sum(list_transform(map_keys(hb), lambda c: least(hb[c], coalesce(ha[c], 0)))), 0) AS common FROM m)
SELECT conv_id, turn, coalesce(fragment IS NOT NULL AND trim(fragment) <> '' AND wordish >= 0.7 * length(fragment) AND 2.0 * common / (length(a) + length(b)) < 0.8, false) AS shown FROM s""")
def new_fragments(spark, sf_dir):
    """Which readings of a turn say something new: its reversal, the turn before it, its first half, or digits for letters."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
    kind, text = F.col("turn") % 4, F.col("text")
    fragment = F.when(kind == 0, F.reverse(F.upper(F.replace(text, F.lit("ß"), F.lit("ss"))))).when(kind == 1, F.col("before")).when(kind == 2, F.left(text, F.floor(F.length(text) / 2).cast("int"))).otherwise(F.translate(text, "aeo", "430"))
    return turns.select("conv_id", "turn", N.new_fragment(text, fragment).alias("shown"))


@register("content_parts", """SELECT conv_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn % 4 < 3), '')) AS said_md5 FROM conversations GROUP BY 1""")
def content_parts(spark, sf_dir):
    """A conversation's turns as content parts: texts, refusals, and parts that are neither."""
    none = F.lit(None).cast("string")
    part = F.struct("turn", F.when(F.col("turn") % 4 < 2, F.col("text")).otherwise(none).alias("text"), F.when(F.col("turn") % 4 == 2, F.col("text")).otherwise(none).alias("refusal"))
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return parts.select("conv_id", F.md5(G.part_text(F.col("parts"))).alias("said_md5"))


@register("data_urls", """SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE md5(left(text, 100000)) END AS text_md5 FROM documents WHERE text IS NOT NULL""")
def data_urls(spark, sf_dir):
    """Texts in data: addresses, as base64, with parameters, or with escapes; those of images have none."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    coded, kind = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", ""), F.col("doc_id") % 4
    escaped = F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(..)", "%$1")
    url = F.when(kind == 0, F.concat(F.lit("data:text/plain;base64,"), coded)).when(kind == 1, F.concat(F.lit("data:text/html;charset=utf-8;base64,"), coded)).when(kind == 2, F.concat(F.lit("data:application/json,"), escaped)).otherwise(F.concat(F.lit("data:image/png;base64,"), coded))
    return docs.select("doc_id", F.md5(G.data_url_text(url)).alias("text_md5"))


@register("description_leaves", """SELECT p_partkey, path, text FROM (SELECT p_partkey, 'description' AS path, p_name AS text FROM part UNION ALL SELECT p_partkey, 'inputSchema.properties.x.title', p_brand FROM part
UNION ALL SELECT p_partkey, 'inputSchema.properties.x.description', p_type FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'inputSchema.anyOf[1].description', p_type || '!' FROM part)""")
def description_leaves(spark, sf_dir):
    """Parts as definitions of tools: descriptions and titles at any depth."""
    size = F.col("p_size")
    x = F.struct(F.col("p_brand").alias("title"), F.when(size % 2 == 0, F.col("p_type")).alias("description"), F.lit("string").alias("type"))
    either = F.array(F.struct(F.lit(" ").alias("description")), F.struct(F.concat("p_type", F.lit("!")).alias("description")))
    tool = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_name").alias("description"), F.struct(F.struct(x.alias("x")).alias("properties"), either.alias("anyOf"), F.lit("titles").alias("kind")).alias("inputSchema")))
    leaves = table(spark, sf_dir, "part").select("p_partkey", tool.alias("tool")).lateralJoin(R.JsonLeaves(F.col("tool").outer()))
    return leaves.where(R.is_description(F.col("path"))).select("p_partkey", "path", "text")


@register("proposed_calls", """WITH e AS (SELECT event_id, event_type, props, user_id FROM events)
SELECT event_id, 0 AS nth, event_type AS name, props AS arguments FROM e UNION ALL SELECT event_id, 1, 'u' || user_id, '{"_unparsed":"{broken ' || event_id || '"}' FROM e WHERE user_id % 2 = 0
UNION ALL SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END, 'legacy', props FROM e WHERE event_id % 3 = 0""")
def proposed_calls(spark, sf_dir):
    """Calls that answers propose, with arguments that don't parse, and in the older form."""
    call = lambda name, args: F.struct(F.struct(name.alias("name"), args.alias("arguments")).alias("function"))
    calls = F.filter(F.array(call(F.col("event_type"), F.col("props")), F.when(F.col("user_id") % 2 == 0, call(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("{broken "), "event_id")))), lambda c: c.isNotNull())
    legacy = F.when(F.col("event_id") % 3 == 0, F.struct(F.lit("legacy").alias("name"), F.col("props").alias("arguments")))
    message = F.to_json(F.struct(F.lit("assistant").alias("role"), calls.alias("tool_calls"), legacy.alias("function_call")))
    answers = table(spark, sf_dir, "events").select("event_id", message.alias("message"))
    return answers.select("event_id", F.posexplode(R.proposed_calls(F.col("message"))).alias("nth", "call")).select("event_id", "nth", "call.name", "call.arguments")


@register("request_leaves", "SELECT event_id, 'note' AS path, 'event ' || event_type AS text FROM events UNION ALL SELECT event_id, 'items[1].title', 'n' || user_id FROM events")
def request_leaves(spark, sf_dir):
    """Strings of each event's arguments (built here), with their paths."""
    events = table(spark, sf_dir, "events")
    nested = F.array(F.struct(F.lit(" ").alias("title")), F.struct(F.concat(F.lit("n"), F.col("user_id")).alias("title")))
    document = F.to_json(F.struct(F.concat(F.lit("event "), "event_type").alias("note"), nested.alias("items"), F.col("value").alias("n")))
    return events.select("event_id", document.alias("doc")).lateralJoin(R.JsonLeaves(F.col("doc").outer())).select("event_id", "path", "text")


@register("argument_values", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, sha256('{\"k\":' || regexp_extract(props, '[0-9]+') || '}') AS args_hash FROM events")
def argument_values(spark, sf_dir):
    """A tool's arguments and their canonical digest."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), R.arguments_hash("props").alias("args_hash"))


@register("parsed_requests", """SELECT CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'model' WHEN 2 THEN 'messages' ELSE 'not a JSON object' END AS outcome, count(*) AS n FROM events GROUP BY 1""")
def parsed_requests(spark, sf_dir):
    """Bodies (built here) that are whole, lack a model, lack messages, or are no JSON."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content")))
    body = (
        F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.lit("m").alias("model"), message.alias("messages"))))
        .when(F.col("event_id") % 4 == 1, F.to_json(F.struct(message.alias("messages"))))
        .when(F.col("event_id") % 4 == 2, F.to_json(F.struct(F.lit("m").alias("model"))))
        .otherwise("[broken")
    )
    _, error = R.parse_chat(F.col("body"))
    return table(spark, sf_dir, "events").select(body.alias("body")).groupBy(F.coalesce(error, F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@register("judge_verdicts", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN true ELSE false END AS injection, CASE event_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 ELSE 0.0 END AS score FROM events""")
def judge_verdicts(spark, sf_dir):
    """Replies (built here) without a score, with one over 1, and with fences."""
    replies = ['Sure: {"injection": "yes"} ok', '{"injection": false, "score": 7}', '```json\n{"injection": 0}\n```']
    reply = F.element_at(F.array(*map(F.lit, replies)), (F.col("event_id") % 3 + 1).cast("int"))
    said = R.parse_verdict(reply)
    return table(spark, sf_dir, "events").select("event_id", said["injection"].alias("injection"), said["score"].alias("score"))


@register("identity_profiles", "SELECT CAST(user_id AS VARCHAR) AS identity, CASE WHEN user_id % 3 = 0 THEN 'strict' ELSE 'balanced' END AS profile, count(*) AS n FROM events GROUP BY ALL")
def identity_profiles(spark, sf_dir):
    """D3."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("identity"))
    own = users.distinct().withColumn("profile", F.when(F.col("identity").cast("int") % 3 == 0, "strict"))
    return Y.resolve_profile(users, own, "balanced").groupBy("identity", "profile").agg(F.count("*").alias("n"))


@register("corpus_problems", "SELECT 'duplicate id' AS problem, CAST(label AS VARCHAR) AS name FROM embeddings GROUP BY label HAVING count(*) > 1 UNION ALL SELECT 'no example', 'benign'")
def corpus_problems(spark, sf_dir):
    """A10, with labels as ids and no benign example."""
    return Y.corpus_problems(table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.lit("attack").alias("label")))


@register("approval_outcomes", """WITH e AS (SELECT user_id AS approval_id, epoch_us(ts) // 1000000 AS t, event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')),
s AS (SELECT approval_id, min(t) FILTER (event_type = 'view') AS created, min_by(event_type, t) FILTER (event_type IN ('click', 'signup')) AS verdict, min(t) FILTER (event_type IN ('click', 'signup')) AS decided FROM e GROUP BY 1),
r AS (SELECT e.approval_id, e.t, CASE WHEN created IS NULL THEN 'unknown' WHEN verdict IS NULL OR decided > t THEN 'pending' WHEN verdict = 'signup' THEN 'rejected' WHEN t >= created + 864000 THEN 'expired' END AS reason FROM e JOIN s USING (approval_id) WHERE event_type = 'purchase')
SELECT approval_id, t AS ts, coalesce(reason, CASE WHEN coalesce(bool_or(reason IS NULL) OVER (PARTITION BY approval_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'used' ELSE 'ok' END) AS outcome FROM r""")
def approval_outcomes(spark, sf_dir):
    """Views ask, clicks approve, sign-ups reject, purchases use; ten days to live."""
    kinds = F.create_map(*[F.lit(x) for kv in {"view": "request", "click": "approve", "signup": "reject", "purchase": "consume"}.items() for x in kv])
    events = table(spark, sf_dir, "events").where("event_type <> 'error'")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    rows = events.select(F.col("user_id").alias("approval_id"), seconds.alias("ts"), F.element_at(kinds, F.col("event_type")).alias("kind"), F.lit("i").alias("identity"), F.lit("f").alias("fingerprint"))
    return P.consumptions(rows, 864_000)
