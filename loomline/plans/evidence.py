"""Retrieval, judging, classification and safety queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import numbers, text
from loomline.operators import classify, judging, packets, retrieval, safety

from .data import M, memory, table
from .packets import AT, ORDER, TRUST

TERMS = ["current", "trusted", "risk", "origin", "state 3", "spending"]
SEARCHED = ["importance", "memory_value", "signal_type", "status", "topic", "trust_level"]
_ROW = "concat('{', " + ", ', ', ".join(f"'\"{c}\": \"', {c}, '\"'" for c in SEARCHED) + ", '}')"
FIELDS = retrieval.FIELDS


def keyword_hits(spark, sf_dir):
    return retrieval.keyword_hits(memory(spark, sf_dir), retrieval.row_text(SEARCHED), TERMS, 40, ORDER).select("event_id", F.col("hits").cast("long").alias("hits"))


def overlap_rows(spark, sf_dir):
    query = F.concat(F.lit("topic current active trusted risk origin "), F.col("topic").cast("string"))
    told = F.concat_ws(" ", *[F.col(c).cast("string") for c in SEARCHED])
    out = retrieval.overlap_per_topic(memory(spark, sf_dir), ["topic"], told, query, 5, ORDER)
    return out.select("topic", "event_id", "overlap", "rank")


def _answers(rows):
    return retrieval.one_row_answer(rows, ["topic"])


def raw_answer(spark, sf_dir):
    return _answers(retrieval.newest_preferred(memory(spark, sf_dir), ["topic"], F.lit(True), ORDER, ["signal_type", "memory_value"]))


def keyword_answer(spark, sf_dir):
    told = F.lower(F.concat_ws(" ", "status", "signal_type", "memory_value"))
    return _answers(retrieval.newest_preferred(memory(spark, sf_dir), ["topic"], text.any_of(told, ["current", "urgent", "active"]), ORDER, ["signal_type", "memory_value"]))


def vivid_answer(spark, sf_dir):
    return _answers(retrieval.newest_preferred(memory(spark, sf_dir), ["topic"], F.col("importance").isin("high", "medium"), ORDER, ["signal_type", "memory_value"]))


def fragments_answer(spark, sf_dir):
    from loomline.operators.ranking import last_per_group

    return retrieval.fill_from_fragments(last_per_group(memory(spark, sf_dir), ["topic"], ORDER, 10), ["topic"], ORDER)


_FIELD = "CASE signal_type " + " ".join(f"WHEN '{r}' THEN '{f}'" for r, f in retrieval.FIELD_OF_ROLE.items()) + " END"
_ONE_ROW = ", ".join(f"CASE WHEN {_FIELD} = '{f}' THEN memory_value END AS {f}" for f in FIELDS)
_NEWEST = "row_number() OVER (PARTITION BY topic ORDER BY {p} DESC, ts DESC, event_id DESC) = 1"


def _one_row_sql(preferred: str) -> str:
    return f"{M}SELECT topic, {_ONE_ROW} FROM m QUALIFY {_NEWEST.format(p=preferred)}"


ROLE_OF = {"current_state": "current_state", "old_state": "origin", "problem": "human_context", "latent_risk": "risk_signal", "lineage_reason": "counter_evidence"}


def _truth(spark, sf_dir):
    return packets.latest_by_role(packets.trusted_rows(memory(spark, sf_dir)), ["topic"], ORDER, {f: (r,) for f, r in ROLE_OF.items()})


_TRUTH = ", ".join(f"arg_max(memory_value, {AT}) FILTER (WHERE signal_type = '{r}') AS {f}" for f, r in ROLE_OF.items())


def judged(spark, sf_dir):
    return judging.judge(_truth(spark, sf_dir), fragments_answer(spark, sf_dir), ["topic"], FIELDS)


def accuracy(spark, sf_dir):
    return judging.total_score(judged(spark, sf_dir))


_FRAGMENTS = ", ".join(f"arg_max(memory_value, {AT}) FILTER (WHERE {_FIELD} = '{f}') AS {f}" for f in FIELDS)
_JUDGED = f"""{M}, t AS (SELECT topic, {_TRUTH} FROM m WHERE {TRUST} GROUP BY topic),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY topic ORDER BY ts DESC, event_id DESC) <= 10), a AS (SELECT topic, {_FRAGMENTS} FROM l GROUP BY topic),
j AS (SELECT t.topic, {', '.join(f't.{f} IS NOT DISTINCT FROM a.{f} AS {f}_ok' for f in FIELDS)}, ({' + '.join(f'(t.{f} IS NOT DISTINCT FROM a.{f})::INT' for f in FIELDS)}) / 5 AS score FROM t LEFT JOIN a USING (topic))"""


def method_costs(spark, sf_dir):
    rows = memory(spark, sf_dir)
    told = rows.select(F.lit("raw").alias("method"), retrieval.row_text(SEARCHED).alias("payload"))
    packet = _truth(spark, sf_dir).select(F.lit("packet").alias("method"), F.concat_ws("|", *FIELDS).alias("payload"))
    return judging.method_costs(told.unionByName(packet), "method", "payload", "raw")


def label_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    guess = docs.select("doc_id", F.when(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")) >= 50, 1).otherwise(0).alias("quality"))
    return judging.label_accuracy(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), guess, "doc_id", "quality", F.col("toxic") == 1)


def account_labels(spark, sf_dir):
    return classify.with_action(classify.evidence_flags(packets.trusted_rows(memory(spark, sf_dir)), ["topic"], fields={"risk": "risk_signal", "human": "human_context", "counter": "counter_evidence", "action": "review_action"}))


def plain_labels(spark, sf_dir):
    return memory(spark, sf_dir).select("event_id", classify.plain_label(F.lower("memory_value")).alias("label"))


def ends_labels(spark, sf_dir):
    return classify.ends_label(memory(spark, sf_dir), ["topic"], ORDER)


def evidence_rows(spark, sf_dir):
    return classify.evidence(packets.trusted_rows(memory(spark, sf_dir)), ["topic"], ["event_id"])


_FIELD_ROLE = {"risk": "risk_signal", "human": "human_context", "counter": "counter_evidence", "action": "review_action"}


def _rules_sql() -> str:
    def hit(field: str, phrase: str) -> str:
        return f"bool_or(lower(memory_value) LIKE '%{phrase}%'" + ("" if field == "all" else f" AND signal_type = '{_FIELD_ROLE[field]}'") + ")"

    cases = " ".join(f"WHEN {' OR '.join('(' + ' AND '.join(hit(*x) for x in parts) + ')' for parts in alternatives)} THEN '{label}'" for label, alternatives in classify.PACKET_RULES)
    return f"{M}, l AS (SELECT topic, CASE {cases} ELSE '{classify.OTHER}' END AS label FROM m WHERE {TRUST} GROUP BY topic)"


def _case(mapping: dict, default: str) -> str:
    return "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


_ACTION = _case(classify.ACTIONS, "human_review_required")
_PLAIN = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(t, '{p}')''' for p in ps)} THEN '{label}'" for label, ps in classify.PLAIN_RULES) + f" ELSE '{classify.OTHER}' END"
FORBIDDEN = ["license", "confidential", "password", "guarantee"]


def document_scan(spark, sf_dir):
    return safety.scan(table(spark, sf_dir, "documents"), "doc_id", "text", FORBIDDEN)


_SECRET = " OR ".join(f"regexp_matches(coalesce(text, ''), '{s}')" for s in safety.SECRET_SHAPES)
_FOUND = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{t}') THEN '{t}' END" for t in FORBIDDEN) + ")"


def customer_leaks(spark, sf_dir):
    reports = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order of Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(", shipped")).alias("report"))
    known = table(spark, sf_dir, "customer").select("c_name")
    return safety.leaked_values(reports, "o_orderkey", "report", known, "c_name")


def masked_names(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return rows.select(
        "s_suppkey", text.masked(F.col("s_name")).alias("masked"), text.last_four(F.col("s_name")).alias("preview"), text.fingerprint(F.col("s_name")).alias("fingerprint"),
        text.scope_key(F.lit("a"), F.col("s_name"), F.col("s_nationkey").cast("string")).alias("scope"), text.slug(F.concat(F.lit("Team / "), F.col("s_name"))).alias("slug"),
    )


def conversation_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    tokens = text.token_list(F.col("text"))
    return rows.select("conv_id", "turn", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"), numbers.tokens_rounded(F.length("text")).alias("estimate"), text.json_string_size(F.col("text")).cast("long").alias("json_size"))


def benchmark_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.explode(text.token_set(F.col("text"))).alias("term"))
    found = retrieval.terms_found(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")), terms, "term")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))


_EDGE = text.EDGE.replace("'", "''")
_TOKENS = "list_filter(list_transform(regexp_split_to_array({t}, '\\s+'), lambda w: lower(trim(w, '" + _EDGE + "'))), lambda w: w <> '')"
_MASK = "CASE WHEN length(s_name) <= 12 THEN 'hidden' ELSE concat(left(s_name, 8), '...', right(s_name, 6)) END"

QUERIES = {
    "K7_keyword_hits": (
        keyword_hits,
        f"{M}SELECT event_id, CAST({' + '.join(f'''contains(t, '{w}')::INT''' for w in TERMS)} AS BIGINT) AS hits FROM (SELECT *, lower({_ROW}) AS t FROM m) WHERE hits > 0 ORDER BY hits DESC, ts DESC, event_id DESC LIMIT 40",
    ),
    "C11_overlap_rows": (
        overlap_rows,
        f"{M}, o AS (SELECT topic, event_id, ts, list_distinct({_TOKENS.replace("{t}", 'concat_ws(chr(32), ' + ', '.join(SEARCHED) + ')')}) AS a, list_distinct({_TOKENS.replace("{t}", '''concat('topic current active trusted risk origin ', topic)''')}) AS b FROM m), "
        "s AS (SELECT topic, event_id, ts, len(list_intersect(a, b)) / greatest(len(b), 1) AS overlap FROM o) SELECT topic, event_id, overlap, row_number() OVER (PARTITION BY topic ORDER BY overlap DESC, ts DESC, event_id DESC) AS rank FROM s QUALIFY rank <= 5",
    ),
    "K6_newest_answer": (raw_answer, _one_row_sql("true")),
    "K6_keyword_answer": (keyword_answer, _one_row_sql("regexp_matches(lower(concat_ws(' ', status, signal_type, memory_value)), 'current|urgent|active')")),
    "K6_vivid_answer": (vivid_answer, _one_row_sql("importance IN ('high', 'medium')")),
    "F11_fragments_answer": (fragments_answer, f"{M}, l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY topic ORDER BY ts DESC, event_id DESC) <= 10) SELECT topic, {_FRAGMENTS} FROM l GROUP BY topic"),
    "K9_judged": (judged, f"{_JUDGED} SELECT * FROM j"),
    "K9_accuracy": (accuracy, f"{_JUDGED} SELECT round_even(avg(score) * 100, 2) AS accuracy, count(*) AS n FROM j"),
    "K10_method_costs": (
        method_costs,
        f"{M}, p AS (SELECT 'raw' AS method, {_ROW} AS payload FROM m UNION ALL SELECT 'packet', concat_ws('|', {', '.join(FIELDS)}) FROM (SELECT topic, {_TRUTH} FROM m WHERE {TRUST} GROUP BY topic)), "
        "s AS (SELECT method, CAST(sum(length(payload)) AS BIGINT) AS chars FROM p GROUP BY method), k AS (SELECT *, greatest(1, CAST(round_even(chars / 4, 0) AS BIGINT)) AS tokens FROM s) "
        "SELECT method, chars, tokens, round_even(tokens * 1000 / 1000000 * 0.15, 6) AS usd_per_1000, round_even((1 - tokens / (SELECT tokens FROM k WHERE method = 'raw')) * 100, 2) AS reduction FROM k",
    ),
    "K13_label_accuracy": (
        label_accuracy,
        "WITH p AS (SELECT l.quality = CASE WHEN len(regexp_extract_all(coalesce(text, ''), '\\S+')) >= 50 THEN 1 ELSE 0 END AS ok, toxic FROM labels l LEFT JOIN documents USING (doc_id)) "
        "SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS n_right, round_even(count(*) FILTER (WHERE ok) * 100 / count(*), 2) AS accuracy, bool_and(ok OR toxic <> 1) AS guarded_right FROM p",
    ),
    "K11_K16_account_labels": (
        account_labels,
        f"{_rules_sql()} SELECT topic, label, {_ACTION} AS action, {_case(classify.CONFIDENCE, 'high')} AS confidence, {_ACTION} IN ({', '.join(repr(p) for p in classify.PUNITIVE)}) AS punitive FROM l",
    ),
    "K12_plain_labels": (plain_labels, f"{M}SELECT event_id, {_PLAIN} AS label FROM (SELECT event_id, lower(memory_value) AS t FROM m)"),
    "K12_ends_labels": (
        ends_labels,
        f"{M}SELECT topic, CASE WHEN contains(t, 'ordinary') THEN 'normal_user' WHEN contains(t, 'malicious') OR contains(t, 'mule pattern confirmed') OR contains(t, 'close account') THEN 'fraud_investigation_needed' ELSE '{classify.OTHER}' END AS label "
        f"FROM (SELECT topic, concat_ws(' ', lower(arg_min(memory_value, {AT})), lower(arg_max(memory_value, {AT}))) AS t FROM m GROUP BY topic)",
    ),
    "K15_evidence": (
        evidence_rows,
        f"{M}SELECT topic, event_id, CASE WHEN signal_type IN ('current_state', 'risk_signal') THEN 'supporting' WHEN signal_type = 'counter_evidence' THEN 'weakening' ELSE 'human' END AS kind, "
        "concat(CASE signal_type WHEN 'current_state' THEN 'Current state: ' WHEN 'risk_signal' THEN 'Risk signal: ' WHEN 'human_context' THEN 'Human context: ' WHEN 'counter_evidence' THEN 'Counter-evidence: ' ELSE 'Recommended review action: ' END, memory_value) AS evidence "
        f"FROM m WHERE {TRUST} AND signal_type <> 'origin'",
    ),
    "K21_document_scan": (
        document_scan,
        f"WITH s AS (SELECT doc_id, {_FOUND} AS terms, {_SECRET} AS has_secret, len(regexp_extract_all(coalesce(text, ''), '{safety.EMAIL_SHAPE}')) AS n_emails FROM documents) SELECT doc_id, terms, has_secret, n_emails, terms = '' AND NOT has_secret AND n_emails = 0 AS clean FROM s",
    ),
    "K32_customer_leaks": (customer_leaks, "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey"),
    "S8_S10_masking": (
        masked_names,
        f"SELECT s_suppkey, {_MASK} AS masked, concat('...', right(s_name, 4)) AS preview, substr(sha256(s_name), 1, 12) AS fingerprint, concat_ws('::', 'a', s_name, s_nationkey) AS scope, left(regexp_replace(lower(concat('Team / ', s_name)), '[ /]', '_', 'g'), 24) AS slug FROM supplier",
    ),
    "S3_S13_tokens": (
        conversation_tokens,
        f"SELECT conv_id, turn, len(k) AS n_tokens, len(list_distinct(k)) AS n_distinct, greatest(1, CAST(round_even(length(text) / 4, 0) AS BIGINT)) AS estimate, "
        "length(text) + 2 + len(regexp_extract_all(text, '[\"\\\\\\n\\r\\t\\x08\\x0C]')) + 5 * len(regexp_extract_all(text, '[\\x00-\\x07\\x0B\\x0E-\\x1F\\x7F-\\x{FFFF}]')) + 11 * len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS json_size "
        f"FROM (SELECT *, {_TOKENS.replace("{t}", "text")} AS k FROM conversations)",
    ),
    "C10_benchmark_terms": (
        benchmark_terms,
        f"WITH b AS (SELECT DISTINCT unnest({_TOKENS.replace("{t}", "text")}) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_TOKENS.replace("{t}", '''coalesce(text, '')''')}) AS term FROM documents) "
        "SELECT doc_id, count(*) AS n_terms FROM d JOIN b USING (term) GROUP BY doc_id",
    ),
}
