"""Roles from phrases that run over line breaks."""

from callflow.operators import roles
from callflow.plans import label_roles


def test_phrases_run_over_line_breaks(spark):
    said = [
        ("speaker_0", "Sure, I can take your "), ("speaker_1", "Hello, I'm"), ("speaker_0", " information"), ("speaker_1", "with Talk Loop"),
        ("speaker_0", "what is"), ("speaker_0", "this regarding"), ("speaker_1", "a calling"), ("speaker_1", "card"),
    ]
    sample = spark.createDataFrame([(1, i, *line) for i, line in enumerate(said)], "call_id long, line_no long, speaker string, text string")
    signals = roles.speaker_signals(sample.repartition(3))
    got = {r.speaker: r for r in signals.collect()}
    assert [(got[s].customer_signal, got[s].agent_signal, got[s].customer_hits, got[s].agent_hits) for s in ("speaker_0", "speaker_1")] == [(True, False, 2, 0), (False, True, 0, 1)]
    assert {r.speaker: r.role for r in roles.rule_roles(signals).collect()} == {"speaker_0": "Customer", "speaker_1": "Agent"}
    # speaker_0 comes first and is the Agent until both contradict it
    assert {r.speaker: r.role for r in roles.validate_roles(roles.fallback_roles(signals)).collect()} == {"speaker_0": "Customer", "speaker_1": "Agent"}


def test_answers_are_parsed_once(spark):
    words = spark.createDataFrame([(c, i, t, s, r) for c in range(3) for i, (t, s, r) in enumerate([("hello", "speaker_0", 0), ("there.", "speaker_0", 0), ("hi", "speaker_1", 1)])], "call_id long, word_idx long, text string, speaker string, run_idx long")
    raw = """CASE WHEN call_id = 0 THEN '{"has_ivr": false, "ivr_text": "", "speaker_roles": {"speaker_0": "Customer", "speaker_1": "Agent"}}' ELSE 'no' END"""
    labelled = label_roles.label_roles(words, words.select("call_id").distinct().selectExpr("call_id", f"{raw} AS raw"))
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan  # neither for every word nor for every branch
    got = {r.call_id: r.transcript for r in label_roles.role_documents(labelled).collect()}
    assert got == {0: "[Customer] hello there.\n[Agent] hi", 1: "[Agent] hello there.\n[Customer] hi", 2: "[Agent] hello there.\n[Customer] hi"}
