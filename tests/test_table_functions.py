"""SQL table functions equal their DataFrame forms."""

from tallyframe.functions import tables
from tallyframe.operators import traces


def test_content_parts_by_lateral_join_equal_the_operator(spark):
    texts = ["plain", "", "[]", "[1, 2]", '[{"type": "text", "text": "a"}, {"type": "image", "image_ref": "b"}]', '[{"type": "text"}] tail', '{"type": "x"}', "[[", '"', None, "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    assert tables.register(spark) == ["content_parts"]
    got = spark.sql("SELECT m.id, p.* FROM {m} m, LATERAL content_parts(m.content) p", m=df)
    want = traces.content_parts(df, ["id"])
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    kept = spark.sql("SELECT m.id, p.part FROM {m} m LEFT JOIN LATERAL content_parts(m.content) p ON p.type = 'image'", m=df)
    assert kept.count() == len(texts) and [r.id for r in kept.filter("part IS NOT NULL").collect()] == [4]
