"""Salvage and normalisers on the shapes models answer with."""

import json

import pytest
from pyspark.sql import functions as F

from callflow.functions import records
from callflow.operators import evaluation as ev
from callflow.operators import responses
from callflow.operators.responses import salvage_text


@pytest.mark.parametrize(
    "raw, found",
    [
        ('{"tasks": [{"title": "a"}]}', True),
        ('```json\n{"tasks": [{"title": "a"}]}\n```', True),
        ('Sure! {"tasks": [{"title": "a"}]} // done', True),
        ("", False),
        ("no json here", False),
        ('{"tasks": [', False),
        ('{"other": 1}', False),
    ],
)
def test_salvage_shapes(raw, found):
    got = salvage_text(raw, "tasks")
    assert (got is not None) == found
    if found:
        assert json.loads(got)["tasks"][0]["title"] == "a"


def test_salvage_longest_and_large():
    small, large = '{"tasks": []}', '{"tasks": [{"title": "x"}, {"title": "y"}]}'
    assert len(json.loads(salvage_text(small + large, "tasks"))["tasks"]) == 2
    many = '{"a": 1} ' * 20000 + large + "{" * 5000
    assert len(json.loads(salvage_text(many, "tasks"))["tasks"]) == 2
    assert salvage_text("{" * 50000, "tasks") is None


def test_salvage_wrappers_and_depth():
    deep = {"ai_analysis": {"a": {"b": {"c": {"d": {"e": 1}}}}}}
    assert json.loads(salvage_text("x " + json.dumps(deep) + " y", "analysis")) == deep["ai_analysis"]
    assert json.loads(salvage_text('{"overall_score": 5}', "scoring")) == {"overall_score": 5}
    assert json.loads(salvage_text('{"fraud_detection": {"fraud_detected": true}}', "fraud")) == {"fraud_detected": True}
    assert json.loads(salvage_text('{"tasks": [], "x": NaN}', "tasks"))["x"] is None


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_task_normalisers(spark):
    kinds = ["call back", "Call-Back", "callback", "follow up", "follow-up", "Follow_Up", "escalate", "document", "null", "N/A", "something_random", None]
    assert column(spark, kinds, records.task_type) == [
        "callback", "callback", "callback", "follow_up", "follow_up", "follow_up", "escalation", "documentation", "follow_up", "follow_up", "other", "follow_up",
    ]
    assert column(spark, ["urgent", "critical", "URGENT", "high", "HIGH", "low", "null", "something"], records.task_priority) == [
        "urgent", "urgent", "urgent", "high", "high", "low", "medium", "medium",
    ]
    doc = '{"tasks": [' + ",".join(f'{{"confidence": {c}}}' for c in ("1.5", "-0.3", '"0.85"', '"bad"')) + "]}"
    got = column(spark, [doc], lambda v: records.tasks_record(responses.parse(v, "tasks")))[0]
    assert [t.confidence for t in got.tasks] == [1.0, 0.0, 0.85, 0.5] and got.task_count == 4
    empty = column(spark, ['{"tasks": []}', None], lambda v: records.tasks_record(responses.parse(v, "tasks")))
    assert empty[0].fallback_reason == records.NO_TASKS and empty[0].task_count == 0
    assert not empty[1].data_sufficient


def test_scores_beyond_cap_are_errors(spark):
    docs = ['{"overall_score": 71, "metrics": {"greeting": 11}}', '{"overall_score": "300", "metrics": {"greeting": "7", "clarity": 7.9}, "flags": ["b", "a", "b"]}']
    bad, good = column(spark, docs, lambda v: records.scoring_record(responses.parse(v, "scoring")))
    assert bad.overall_score == -1 and bad.flags == ["parse_error"] and bad.metrics.clarity == -1
    assert good.overall_score == 100 and good.metrics.greeting == 7 and good.metrics.clarity == 7 and good.flags == ["a", "b"]


def test_fraud_default_is_insufficient(spark):
    got = column(spark, ['{"fraud_category": "weird", "fraud_detected": true}'], lambda v: records.fraud_record(responses.parse(v, "fraud")))[0]
    assert not got.valid and not got.fraud_detected and not got.data_sufficient and got.risk_level == "Low"


def test_known_fields_override(spark):
    df = spark.sql(
        "SELECT array(named_struct('task_type','a','title','t','description','d','priority','p','due_date_relative','','due_date_estimated','',"
        "'assigned_to','wrong','name','keep','number','wrong','source_action_item','','confidence',0.5D)) AS tasks, '1003' AS ext, '' AS name, '' AS src, '555' AS phone"
    )
    got = df.select(records.inject_known(F.col("tasks"), F.col("ext"), F.col("name"), F.col("src"), F.col("phone")).alias("t")).first().t[0]
    assert (got.assigned_to, got.name, got.number) == ("1003", "keep", "555")


def test_published_evaluation_figures(spark):
    """A matrix with the published supports and hits gives the published scores."""
    names = ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]
    cells = [(0, 1, 1), (1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 13), (3, 3, 1), (3, 1, 5), (3, 2, 17), (3, 4, 1), (4, 4, 3), (4, 1, 1)]
    rows = [(names[p], names[a]) for a, p, n in cells for _ in range(n)]
    table = ev.confusion(ev.clean_labels(spark.createDataFrame(rows, "predicted string, actual string")))
    overall = ev.accuracy(table).first()
    assert overall.total == 50 and round(overall.accuracy, 2) == 0.38
    scores = {r.label: r for r in ev.class_scores(table).collect()}
    assert [round(scores[n].recall, 2) for n in names] == [0.0, 0.4, 0.81, 0.04, 0.75]
    assert [round(scores[n].precision, 2) for n in names] == [0.0, 0.17, 0.39, 1.0, 0.75]
    mean = ev.averages(ev.class_scores(table)).first()
    assert (round(mean.macro_precision, 2), round(mean.macro_recall, 2), round(mean.macro_f1, 2)) == (0.46, 0.40, 0.32)
    assert (round(mean.weighted_precision, 2), round(mean.weighted_recall, 2), round(mean.weighted_f1, 2)) == (0.68, 0.38, 0.29)
