"""Properties and edge cases of the library's operators."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.operators import access, classify, delta, encoding, packets, replay, retrieval, rules, safety, usage
from loomline.operators.neighbours import numbered, with_previous
from loomline.sources import json_data, store
from loomline.streaming import packets as streams

quiet = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
cell = st.one_of(st.none(), st.sampled_from(["a", "b", "", "é", 'q"\\\n', "\x7f", "😀"]))


@quiet
@given(rows=st.lists(st.tuples(st.integers(0, 2), cell, cell), max_size=25))
def test_delta_round_trip(spark, rows):
    df = spark.createDataFrame([(k, i, a, b) for i, (k, a, b) in enumerate(rows)], "k int, i int, a string, b string")
    bucket = F.floor(F.col("i") / 3)
    back = delta.decode(delta.encode(df, ["k"], ["i"], ["a", "b"], bucket), ["k"], ["i"], ["a", "b"], bucket)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert delta.mismatches(df, back, ["k", "i"], ["a", "b"]).count() == 0


def test_mismatches_are_found(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, v string")
    b = spark.createDataFrame([(1, "y"), (3, None)], "i int, v string")
    assert sorted(r[0] for r in delta.mismatches(a, b, ["i"], ["v"]).collect()) == [1, 2, 3]


def test_positions_cross_buckets_and_null_keys(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(10)], "k string, i int")
    got = with_previous(numbered(df, ["k"], ["i"], F.floor(F.col("i") / 4)), ["k"], ["i"], ["i"], F.floor(F.col("i") / 4)).collect()
    assert all(r["position"] == r["i"] + 1 and (r["previous"]["i"] if r["previous"] else None) == (r["i"] - 1 if r["i"] else None) for r in got)
    assert len(got) == 20


def _discovered(spark, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, c {kind}")
    cells = rules.long_form(df, F.lit("d"), F.col("i"), ["c"])
    found = rules.discover(cells)
    return found.first(), [r["text"] for r in rules.values(found).orderBy("idx").collect()]


@pytest.mark.parametrize(
    ("values", "kind", "wanted"),
    [
        ([5, 5, 5], "long", "constant"),
        ([3, 1, -1, -3], "long", "linear"),
        ([1, 2, 1, 2], "long", "cycle"),
        ([1, 2], "long", None),
        (["x", "y", "x", "y", "x"], "string", "cycle"),
        (["x", "y", "x"], "string", None),
        (["Atlas 7", "Atlas 8", "Atlas 9", "Atlas 10"], "string", "template"),
        (["v008b", "v009b", "v010b"], "string", "template"),
        (["t2", "t1", "t0", "t-1"], "string", "template"),
        (["a1", "b2", "c3"], "string", None),
        ([None, None], "string", "constant"),
        ([str(i % 21) for i in range(42)], "string", None),
    ],
)
def test_rules(spark, values, kind, wanted):
    rule, back = _discovered(spark, values, kind)
    assert rule["type"] == wanted
    if wanted:
        assert back == [None if v is None else str(v) for v in values]


def test_sizes_are_those_of_compact_json(spark):
    rows = [(0, 'é"\n', 1), (1, "😀\x7f", 2), (2, None, 2), (3, 'é"\n', 4)]
    df = spark.createDataFrame(rows, "i long, t string, n long")
    cells = rules.long_form(df, F.lit("d"), F.col("i"), ["t", "n"])
    plain = [{"t": t, "n": n} for _, t, n in rows]
    size = lambda x: len(json.dumps(x, separators=(",", ":")))
    changes = [{k: v for k, v in now.items() if before[k] != v} for before, now in zip(plain, plain[1:], strict=False)]
    got = encoding.row_form_sizes(cells).first()
    assert (got["raw_size"], got["transform_size"]) == (size(plain), size({"m": "transform", "o": plain[0], "d": changes}))
    columns = {"t": {"t": "dict", "v": ['é"\n', "😀\x7f", None], "i": [0, 1, 2, 0]}, "n": {"t": "dict", "v": [1, 2, 4], "i": [0, 1, 1, 2]}}
    assert encoding.dictionary_sizes(cells).first()["dictionary_size"] == size({"m": "dictionary", "n": 4, "o": ["t", "n"], "c": columns})


def test_policy_keeps_noise_raw_and_takes_rules(spark):
    noise = spark.createDataFrame([(i, f"random {i * 7919 % 1009}", "none") for i in range(40)], "i long, message string, importance string")
    ruled = spark.createDataFrame([(i, i * 3, f"step {i}") for i in range(40)], "i long, a long, b string")
    cells = rules.long_form(noise, F.lit("noise"), F.col("i"), ["message", "importance"]).unionByName(rules.long_form(ruled, F.lit("ruled"), F.col("i"), ["a", "b"]))
    got = {r["dataset"]: r for r in encoding.decide(cells, {"message": 0, "importance": 1, "a": 0, "b": 1}).collect()}
    assert (got["noise"]["policy_mode"], got["noise"]["reason"]) == ("raw", "noise")
    assert (got["ruled"]["policy_mode"], got["ruled"]["rule_possible"]) == ("rule", True)
    assert got["noise"]["failed_field"] == "message"


def test_row_sizes_meet_rows_before_without_gathering(spark, monkeypatch):
    """Rows across bucket borders and gaps, nulls too; no aggregate sorts all cells."""
    monkeypatch.setattr(encoding, "BUCKET_ROWS", 4)
    values = [(0, "a", 1), (1, "a", 1), (3, "a", 2), (4, "a", 2), (5, None, 2), (13, None, 2), (14, 'q"\u00e9\U0001f600', 3), (15, "a", 3), (16, "a", 3)]
    df = spark.createDataFrame(values, "i int, t string, n int")
    wide = rules.wide_form(df, F.lit("d"), F.col("i"), ["t", "n"])
    sizes = encoding.wide_form_sizes(encoding.with_pairs(wide, ["t", "n"]))
    size = lambda x: len(json.dumps(x, separators=(",", ":")))
    plain = [{"t": t, "n": n} for _, t, n in values]
    deltas = [{k: v for k, v in row.items() if i == 0 or plain[i - 1][k] != v} for i, row in enumerate(plain)]
    wanted = (size(plain), size({"m": "transform", "o": plain[0], "d": deltas[1:]}))
    for got in (sizes.first(), encoding.row_form_sizes(rules.cells_of(wide)).first()):
        assert (got["n"], got["raw_size"], got["transform_size"]) == (len(values), *wanted)
    assert "SortAggregate" not in sizes._jdf.queryExecution().executedPlan().toString()


def test_columns_whose_head_breaks_all_rules_are_not_checked(spark, monkeypatch):
    """Only columns that may still follow a rule meet their candidates; a late break still counts."""
    tables, plain = {}, rules.written
    monkeypatch.setattr(rules, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    rows = [(i, f"x{i * i % 97}", i, f"n{i:03d}" if i < 150 else "late", i % 20) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a string, b int, c string, d int")
    got = {r["field"]: r["type"] for r in rules.discover(rules.long_form(df, F.lit("d"), F.col("i"), ["a", "b", "c", "d"])).collect()}
    assert got == {"a": None, "b": "linear", "c": None, "d": "cycle"}
    heads = {r["field"]: (r["may_linear"], r["may_template"], r["periods"]) for r in tables["heads"].collect()}
    assert heads == {"a": (False, False, []), "b": (True, False, []), "c": (False, True, []), "d": (False, False, [20])}


def test_newest_takes_the_later_row_among_equal_times(spark):
    df = spark.createDataFrame([("t", 1, 0, "a"), ("t", 1, 1, "b"), ("t", 0, 2, "c")], "topic string, ts int, ord int, memory_value string")
    assert df.groupBy("topic").agg(packets.newest(F.col("memory_value"), ["ts", "ord"]).alias("v")).first()["v"] == "b"


def test_entity_without_active_rows(spark):
    schema = "e string, ts int, status string, event_type string, signal_type string, state_before string, state_after string"
    df = spark.createDataFrame([("x", 1, "stale", "click", "s", "open", "held"), ("x", 2, "stale", "click", "s", "held", "shut")], schema)
    got = packets.entity_packet(df, ["e"], ["ts"], ("click",)).first()
    assert (got["current_state"], got["previous_state"], got["n_changes"], got["active_signals"], got["stale_signals"]) == (None, "open", 0, "", "s")


def test_packet_plan_has_one_shuffle_and_no_python(spark, sf_dir):
    from loomline.plans.packets import continuity_packet_per_user

    plan = continuity_packet_per_user(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_quota_fold_admits_what_still_fits(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([2, 3, 1, 1])], "i int, count long").selectExpr("'c' client_id", "'v' vault_id", "'n' namespace", "'report_read' operation", "'allowed' reason", "200 status_code", "true allowed", "i", "count")
    limits = spark.createDataFrame([("c", 9, 9, 3)], "client_id string, max_events long, max_packets long, max_reports long")
    got = access.admit(rows, limits, ["i"]).orderBy("i").collect()
    assert [r["allowed"] for r in got] == [True, False, True, False]
    assert [r["status_code"] for r in got] == [200, 429, 200, 429]


def test_quota_gathers_no_scope_and_equals_a_plain_loop(spark, monkeypatch):
    import random

    rng, limit = random.Random(5), {"a": 60, "b": 7, "c": None, "d": 40}
    calls = [(c, i, rng.choice([0, 1, 2, 3, 5, 9, 50, None])) for i in range(400) for c in limit]
    calls += [("d", 400, -20), ("d", 401, 5)]
    rows = spark.createDataFrame(calls, "client_id string, i int, count long").selectExpr("client_id", "'v' vault_id", "'n' namespace", "'report_read' operation", "'allowed' reason", "200 status_code", "true allowed", "i", "count")
    limits = spark.createDataFrame([(c, 9, 9, n) for c, n in limit.items()], "client_id string, max_events long, max_packets long, max_reports long")
    wanted, used = {}, dict.fromkeys(limit, 0)
    for c, i, n in sorted(calls, key=lambda x: x[:2]):
        wanted[c, i] = limit[c] is None or (n is not None and used[c] + n <= limit[c])
        used[c] += n if wanted[c, i] and n else 0
    assert {(r["client_id"], r["i"]): r["allowed"] for r in access.admit(rows, limits, ["i"]).collect()} == wanted
    monkeypatch.setattr(F, "collect_list", None)
    steady = access.admit(rows.where("client_id <> 'd'"), limits, ["i"])
    assert {(r["client_id"], r["i"]): r["allowed"] for r in steady.collect()} == {k: v for k, v in wanted.items() if k[0] != "d"}


def test_bearer(spark):
    df = spark.createDataFrame([("Bearer abc",), ("Basic abc",), (None,), ("Bearer ",)], "h string")
    assert [r[0] for r in df.select(access.bearer(F.col("h"))).collect()] == ["abc", None, None, None]


def test_counts_with_zeros(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    assert {tuple(r) for r in usage.counts_with_zeros(df, "s", ["a", "b"]).collect()} == {("a", 2), ("b", 0)}


def test_text_replay(spark):
    edits = [(0, "add", " two", None), (1, "replace", "two", "2"), (2, "remove", "", None), (3, "remove", "o", None)]
    df = spark.createDataFrame([("d", *e) for e in edits], "doc string, i int, op string, a string, b string")
    assert replay.text_replay(df, ["doc"], ["i"], F.lit("one")).first()["text"] == "ne 2"


def test_walk_finds_origin_and_refuses_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "state long, parent long")
    got = {r["state"]: (r["origin"], r["depth"]) for r in replay.origins(chain).collect()}
    assert got == {i: (0, i) for i in range(1, 40)}
    path = replay.path_to(chain, spark.createDataFrame([(5,)], "state long")).orderBy("depth").collect()
    assert [r["state"] for r in path] == [5, 4, 3, 2, 1]
    with pytest.raises(ValueError, match="cycle"):
        replay.origins(spark.createDataFrame([(1, 2), (2, 1)], "state long, parent long"), max_rounds=6)


def test_tokens_and_masks(spark):
    df = spark.createDataFrame([("  Hello, (World)! hello  ''",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.token_list(F.col("t"))).collect()] == [["hello", "world", "hello"], None, []]
    assert [r[0] for r in df.select(text.masked(F.col("t"))).collect()][1:] == [None, "hidden"]
    parts = df.limit(1).select(text.scope_parts(F.lit("a::b::c::d")).alias("p")).first()["p"]
    assert tuple(parts) == ("a", "b", "c::d")


def test_substrings_count_as_hits(spark):
    df = spark.createDataFrame([("untrusted", 1), ("plain", 2)], "t string, i int")
    assert [r["t"] for r in retrieval.keyword_hits(df, F.col("t"), ["trusted"], 5, ["i"]).collect()] == ["untrusted"]


def test_best_overlaps_pair_no_repeats(spark, monkeypatch):
    """Rows that differ only in tokens of no term are one set; null and empty texts overlap with nothing."""
    sizes, plain = {}, retrieval.written

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(retrieval, "written", counted)
    texts = [f"red {w} x{i}" for i in range(200) for w in ("bolt", "ring")] + [None, "", "x1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    terms = spark.createDataFrame([(t,) for t in ["red bolt", "bolt red", "red bolt", "blue ring nut", "Red, red", "zebra", "", None]], "term string")
    got = {r["term"]: (round(r["overlap"], 6), r["hit"]) for r in retrieval.best_overlaps(rows, F.col("t"), terms, "term").collect()}
    assert got == {"red bolt": (1.0, True), "bolt red": (1.0, True), "blue ring nut": (0.333333, False), "Red, red": (1.0, True), "zebra": (0.0, False), "": (0.0, False), None: (0.0, False)}
    assert sizes == {"terms": 7, "sets": 2}


def test_label_cascade_respects_order_and_negation(spark):
    schema = "current_state string, risk_signals string, human_context string, counter_evidence string, review_action string"
    rows = [
        ("Ordinary spending continues", "coordinated pattern", "", "", ""),
        ("", "coordinated pattern", "messages suggest pressure", "No clear victim-coaching, coercion", ""),
        ("", "coordinated pattern", "messages suggest pressure", "", ""),
        (None, None, None, None, None),
    ]
    got = [r["label"] for r in classify.packet_label(spark.createDataFrame(rows, schema)).collect()]
    assert got == ["normal_user", "fraud_investigation_needed", "possible_coercion_or_pressured_mule", "needs_human_review"]


def test_paths_and_versions(spark):
    df = spark.createDataFrame([("reports/a_v041.json",), ("reports/private/a.json",), ("x/a.md",), ("reports/b.txt",)], "p string")
    got = df.select(safety.public_report(F.col("p")), safety.version_of(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, 41), (False, 9999), (False, 9999), (False, 9999)]


def test_json_datasets(spark, tmp_path):
    good = tmp_path / "in.json"
    good.write_text(json.dumps({"datasets": [{"name": "a", "description": "d", "rows": [{"x": 1}, {"x": 2}]}]}))
    got = json_data.read_datasets(spark, str(good), "x long").orderBy("ordinal").collect()
    assert [(r["dataset"], r["ordinal"], r["x"]) for r in got] == [("a", 0, 1), ("a", 1, 2)]
    good.write_text(json.dumps({"datasets": [{"name": "a", "description": "d"}]}))
    with pytest.raises(Exception, match="without rows"):
        json_data.read_datasets(spark, str(good), "x long").collect()


def test_payload_problems(spark):
    payloads = ["{", "[1]", "{}", '{"datasets": 3}', '{"datasets": [{"name": "a", "description": "d", "rows": []}, {"name": "b"}]}', '{"datasets": [{"name": "a", "description": "d", "rows": [{"x": 1}]}]}']
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    assert [r[0] for r in df.select(json_data.payload_problem(F.col("p"))).collect()] == ["not JSON", "not an object", "no list of datasets", "no list of datasets", "dataset 1 lacks a part", None]


def test_reports_and_logs(spark, tmp_path):
    out = str(tmp_path / "report")
    json_data.write_report(spark.createDataFrame([(2, None)], "b int, a string"), out, sort_keys=True)
    assert spark.read.text(out).first()[0] == '{"a":null,"b":2}'
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "one.json").write_text('{"ok": 1}')
    (tmp_path / "logs" / "two.json").write_text("{broken")
    assert json_data.recent_logs(spark, str(tmp_path / "logs")).count() == 1
    assert sorted(r["parses"] for r in json_data.report_files(spark, str(tmp_path / "logs")).collect()) == [False, True]


def test_store(spark, tmp_path):
    base = spark.createDataFrame([("c", "k1", "h", 1), ("c", "k2", "h", 1)], "client_id string, key_id string, key_hash string, seq int")
    batch = spark.createDataFrame([("c", "k1", "new", 2)], base.schema)
    rows = store.upserted(base, batch, ["key_id"], "seq")
    assert {(r["key_id"], r["key_hash"]) for r in rows.collect()} == {("k1", "new"), ("k2", "h")}
    shown = store.snapshot({"keys": rows})["keys"]
    assert shown.columns == ["client_id", "key_id", "seq"]
    path = str(tmp_path / "keys")
    store.append(base, path, ["client_id"])
    store.append(batch, path, ["client_id"])
    assert store.newest_rows(spark.read.parquet(path), ["key_id"], "seq").count() == 2
    assert store.lookup(rows, key_id="k1").count() == 1 and store.scan(rows, ["key_id"], client_id=None).count() == 2


def test_stream_drops_repeated_deliveries(spark, tmp_path):
    folder = str(tmp_path / "events")
    spark.createDataFrame([(1, 5), (2, 6)], "event_id long, s long").selectExpr("event_id", "timestamp_seconds(s) ts").write.parquet(folder)
    spark.createDataFrame([(2, 6), (3, 7)], "event_id long, s long").selectExpr("event_id", "timestamp_seconds(s) ts").write.mode("append").parquet(folder)
    rows = streams.once_seen(streams.event_stream(spark, folder, "event_id long, ts timestamp"), ["event_id"])
    assert sorted(r["event_id"] for r in streams.drained(rows, "seen").collect()) == [1, 2, 3]
