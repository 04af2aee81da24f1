"""Documents with missing, null, odd and broken parts."""

from habitrace.operators import documents
from habitrace.operators.documents import Field

WANTED = [Field("n", "$.n", "long", 7), Field("s", "$.a.s", "string"), Field("b", "$.b", "boolean", True), Field("x", "$.x", "double")]


def frame(spark, *texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    return documents.parsed(spark.createDataFrame(rows, "id long, document string"))


def test_values_and_states(spark):
    texts = ['{"n":1,"a":{"s":"t"},"b":false,"x":2}', '{"n":"1","a":[],"b":null,"x":"2"}', "{broken", None, "[1]", "null", '{"n":1.5,"a":{"s":3},"b":0,"x":1e300}', "{}", '{"n":12345678901234567890,"x":true,"a":{"s":{"t":1}}}']
    got = {r.id: r for r in documents.fields(frame(spark, *texts), WANTED).collect()}
    take = lambda k: [(getattr(got[k], f.name), getattr(got[k], f"{f.name}_state")) for f in WANTED]
    assert take(0) == [(1, "ok"), ("t", "ok"), (False, "ok"), (2.0, "ok")]
    assert take(1) == [(7, "mistyped"), (None, "missing"), (True, "null"), (None, "mistyped")]
    nothing = [(7, "missing"), (None, "missing"), (True, "missing"), (None, "missing")]
    assert take(2) == take(3) == take(4) == take(5) == take(7) == nothing
    assert [got[k].readable for k in (2, 3, 4, 5)] == [False, False, True, True]
    assert take(6) == [(7, "mistyped"), ("3", "ok"), (True, "mistyped"), (1e300, "ok")]
    assert take(8)[0] == (7, "mistyped") and take(8)[1] == (None, "mistyped") and take(8)[3] == (None, "mistyped")


def test_items(spark):
    rows = frame(spark, '{"o":[{"n":1},{"n":null},3,null,{"n":"z","x":2.5}]}', '{"o":{}}', '{"o":[]}', "{", '{"o":null}')
    got = [tuple(r) for r in documents.items(rows, "$.o", [WANTED[0], WANTED[3]], ["id"]).orderBy("id", "pos").collect()]
    assert got == [(0, 0, 1, "ok", None, "missing"), (0, 1, 7, "null", None, "missing"), (0, 2, 7, "missing", None, "missing"), (0, 3, 7, "missing", None, "missing"), (0, 4, 7, "mistyped", 2.5, "ok")]


def test_drift_and_layouts(spark):
    rows = frame(spark, '{"n":1}', '{"n":"a"}', '{"n":null}', "{}", "{").selectExpr("id % 1 as g", "document", "readable")
    counts = {r.field: tuple(r)[2:] for r in documents.drift(rows, WANTED, ["g"]).collect()}
    assert counts["n"] == (5, 1, 2, 1, 1) and counts["x"] == (5, 0, 5, 0, 0)
    assert documents.schemas(rows, ["g"]).first().layout == "OBJECT<n: VARIANT>"
    assert documents.drift(rows.limit(0), WANTED, ["g"]).count() == 0
