"""Three-valued logic: unknown is never safe."""

from habitrace.operators import rules


def _score(spark, rows):
    measures = spark.createDataFrame(rows, "scan_id long, code string, value double")
    return {r.scan_id: r for r in rules.score(rules.evaluate(measures, rules.rule_table(spark))).collect()}


def _levels(spark, rows):
    measures = spark.createDataFrame(rows, "scan_id long, code string, value double")
    return {r.code: r.level for r in rules.evaluate(measures, rules.rule_table(spark)).collect()}


def test_limits_compare_strictly(spark):
    got = _levels(spark, [(1, "door_width", 0.80), (1, "passage_width", 1.20), (1, "threshold", 0.02), (1, "slope", 0.051), (1, "uneven", 0.015)])
    assert got["door_width"] == "yellow"
    assert got["passage_width"] == "green"
    assert got["threshold"] == "yellow"
    assert got["slope"] == "red"
    assert got["uneven"] == "green"
    assert got["stairs"] == got["obstacle"] == got["bathroom_door"] == "unknown"


def test_nothing_known_has_no_score(spark):
    got = _score(spark, [(1, "door_width", None), (2, "door_width", 0.95)])
    assert got[1].score is None and got[1].known == 0
    assert got[2].score == 100.0 and got[2].known == 1


def test_weights_are_renormalised(spark):
    got = _score(spark, [(1, "door_width", 0.85), (1, "slope", 0.01)])
    assert got[1].score == 100 * (0.4 * 0.5 + 0.4 * 1.0) / 0.8
    assert got[1].completeness == 25.0


def test_flags(spark):
    assert _levels(spark, [(1, "stairs", 1.0), (1, "obstacle", 0.0)])["stairs"] == "red"
    assert _levels(spark, [(1, "stairs", 1.0), (1, "obstacle", 0.0)])["obstacle"] == "green"
