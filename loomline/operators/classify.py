"""Labels from ordered phrase rules, and what follows from a label: wording, action, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import lowered

#: Rules in order; each is (label, alternatives), an alternative being (field, phrase) pairs that must all hold.
PACKET_RULES = (
    ("normal_user", ((("all", "ordinary spending continues"),), (("all", "no fraud escalation"),))),
    ("likely_false_positive", ((("counter", "documented student finance"),), (("action", "likely false positive"),))),
    ("possible_account_takeover_victim", ((("risk", "device continuity broke"),), (("action", "account takeover"),), (("human", "did not authorize"),))),
    ("possible_scam_victim", ((("human", "coached by caller"),), (("action", "scam victim support"),))),
    ("fraud_investigation_needed", ((("risk", "coordinated pattern"), ("counter", "no clear victim")),)),
    ("possible_coercion_or_pressured_mule", ((("human", "messages suggest pressure"),), (("human", "being instructed by another person"),), (("action", "safeguarding assessment"),), (("action", "coercion and safeguarding"),))),
)
#: Phrases of the plain rule baseline, in order.
PLAIN_RULES = (
    ("fraud_investigation_needed", ("money mule", "mule risk", "suspicious deposits", "rapid dispersal", "large unusual incoming payment", "new recipient", "repeated transfers", "device change", "password reset")),
    ("normal_user", ("ordinary spending",)),
)
OTHER = "needs_human_review"
#: The mild action of each label.
ACTIONS = {
    "normal_user": "no_escalation",
    "possible_scam_victim": "protect_and_support",
    "possible_coercion_or_pressured_mule": "safeguarding_review",
    "possible_account_takeover_victim": "protect_account_access",
    "likely_false_positive": "avoid_punitive_label",
    "fraud_investigation_needed": "investigation_review",
}
CONFIDENCE = {"normal_user": "medium", "fraud_investigation_needed": "medium", OTHER: "low"}
PUNITIVE = ("investigation_review", "punitive_escalation", "close_or_restrict_without_review")


def phrase_label(texts: dict[str, Column], rules=PACKET_RULES) -> Column:
    """The label of the first rule one of whose alternatives holds; texts are lower-cased columns by field name."""
    out = F
    for label, alternatives in rules:
        found = F.lit(False)
        for parts in alternatives:
            all_of = F.lit(True)
            for field, phrase in parts:
                all_of = all_of & texts[field].contains(phrase)
            found = found | all_of
        out = out.when(found, label)
    return out.otherwise(OTHER)


def packet_label(packets: DataFrame, current: str = "current_state", risk: str = "risk_signals", human: str = "human_context", counter: str = "counter_evidence", action: str = "review_action") -> DataFrame:
    """Adds `label` to packets whose list fields are joined texts."""
    texts = {"current": lowered(F.col(current)), "risk": lowered(F.col(risk)), "human": lowered(F.col(human)), "counter": lowered(F.col(counter)), "action": lowered(F.col(action))}
    texts["all"] = F.concat_ws(" ", *texts.values())
    return packets.withColumn("label", phrase_label(texts))


def evidence_flags(rows: DataFrame, keys: list[str], role: str = "signal_type", value: str = "memory_value", fields: dict[str, str] | None = None, rules=PACKET_RULES) -> DataFrame:
    """One row per key with the label of its packet, without gathering its texts: every phrase is looked for row by row and OR-ed.

    A phrase never spans two rows, so this equals looking in the joined text.
    """
    fields = fields or {"risk": "risk_signal", "human": "human_context", "counter": "counter_evidence"}
    named = sorted({(f, p) for _, alternatives in rules for parts in alternatives for f, p in parts})
    low = lowered(F.col(value))
    flags = []
    for i, (field, phrase) in enumerate(named):
        where = F.lit(True) if field == "all" else F.col(role) == fields.get(field, field)
        flags.append(F.max(where & low.contains(phrase)).alias(f"_p{i}"))
    found = rows.groupBy(*keys).agg(*flags)
    at = {x: F.col(f"_p{i}") for i, x in enumerate(named)}
    out = F
    for label, alternatives in rules:
        any_ = F.lit(False)
        for parts in alternatives:
            all_of = F.lit(True)
            for x in parts:
                all_of = all_of & at[x]
            any_ = any_ | all_of
        out = out.when(any_, label)
    return found.select(*keys, out.otherwise(OTHER).alias("label"))


def plain_label(text: Column, rules=PLAIN_RULES) -> Column:
    """Label of the first rule any of whose phrases a text holds."""
    out = F
    for label, phrases in rules:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        out = out.when(hit, label)
    return out.otherwise(OTHER)


def ends_label(rows: DataFrame, keys: list[str], order: list[str], value: str = "memory_value") -> DataFrame:
    """Label from the first and last row alone."""
    ends = rows.groupBy(*keys).agg(F.concat_ws(" ", lowered(F.min_by(value, F.struct(*order))), lowered(F.max_by(value, F.struct(*order)))).alias("_t"))
    return ends.select(*keys, plain_label(F.col("_t"), (("normal_user", ("ordinary",)), ("fraud_investigation_needed", ("malicious", "mule pattern confirmed", "close account")))).alias("label"))


def with_action(labelled: DataFrame) -> DataFrame:
    """Adds the mild action, the confidence and whether the action is punitive."""
    look = lambda m, d: F.coalesce(F.create_map(*[F.lit(x) for p in m.items() for x in p])[F.col("label")], F.lit(d))
    out = labelled.withColumn("action", look(ACTIONS, "human_review_required")).withColumn("confidence", look(CONFIDENCE, "high"))
    return out.withColumn("punitive", F.col("action").isin(*PUNITIVE))


def evidence(rows: DataFrame, keys: list[str], order: list[str], role: str = "signal_type", value: str = "memory_value") -> DataFrame:
    """Every row as a piece of evidence: supporting, weakening or for a human, with its wording."""
    told = {"current_state": ("supporting", "Current state: "), "risk_signal": ("supporting", "Risk signal: "), "human_context": ("human", "Human context: "), "counter_evidence": ("weakening", "Counter-evidence: "), "review_action": ("human", "Recommended review action: ")}
    kind, words = F, F
    for r, (k, w) in told.items():
        kind, words = kind.when(F.col(role) == r, k), words.when(F.col(role) == r, w)
    return rows.where(F.col(role).isin(*told)).select(*keys, *order, kind.alias("kind"), F.concat(words, F.coalesce(value, F.lit(""))).alias("evidence"))
