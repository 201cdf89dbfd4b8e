from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrain.llm.splitting import cuts, split_oversized


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n!é́", max_size=900), st.integers(40, 200))
def test_round_trip(text, limit):
    overlap = limit // 5
    own = cuts(text, limit, overlap)
    assert all(b - a <= limit for a, b in own)
    assert text == text[own[0][0] : own[0][1]] + "".join(text[a + overlap : b] for a, b in own[1:])
    assert all(b[0] == a[1] - overlap for a, b in zip(own, own[1:]))


def test_natural_boundaries():
    text = "Une phrase. " * 20
    assert all(text[: b].endswith(". ") for _, b in cuts(text, 100, 10)[:-1])


def test_edges(spark):
    long = "x" * 5000
    data = [("d", "a", long, 1), ("d", "a", long, 2), ("d", "b", "court", 1), ("d", "c", None, 1), (None, "e", long, 1), ("d", "f", "", 1)]
    df = spark.createDataFrame(data, "document_id string, chunk_id string, content string, piece int")
    got = split_oversized(df, ["document_id", "chunk_id"], "content").collect()
    assert {(r[0], r[1]) for r in got} == {("d", "a"), (None, "e")}
    own = sorted((r["piece"], r["content"]) for r in got if r[1] == "a")
    assert own[0][1] + "".join(t[150:] for _, t in own[1:]) == long
    assert split_oversized(df.limit(0), ["document_id", "chunk_id"], "content").count() == 0
