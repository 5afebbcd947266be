import corpus_pipeline as cp
from scriptoria.llm.common import cut
from scriptoria.llm.mixing import mix_sources


def test_token_ids_carry_the_order_of_the_mixture(spark):
    rows = [(i, f"text {i}", "en", "big" if i % 5 else "small", 8) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {(r.doc_id, r.mix_slot, r.mix_position) for r in mix_sources(docs).collect()}
    mixed = cp.mix_to_weights(spark, docs, "/nowhere").repartition(5, "doc_id")  # as a reader that keeps no order
    ids = cp.encode_bytes(spark, mixed, "/nowhere").collect()
    assert {(r.doc_id, r.mix_slot, r.mix_position) for r in ids} == want
    assert len({r.mix_position for r in ids}) == 200 and [r.doc_id for r in sorted(ids, key=lambda r: r.mix_position)] != list(range(200))


def test_the_mixing_stage_decides_the_places(spark):
    """The last stage places rows by the weights that the mixing stage chose, also after a table in between, and not without it."""
    rows = [(i, f"text {i}", "en", [None, "", "big", "big", "big"][i % 5], 8) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def places(frame):
        return {(r.doc_id, r.source, r.mix_slot, r.mix_position) for r in frame.select("doc_id", "source", "mix_slot", "mix_position").collect()}

    assert places(cp.encode_bytes(spark, docs, "/nowhere")) == {(*r[:1], r[3], None, None) for r in rows}
    found = {}
    for name, weights in (("default", None), ("last", {"": 1.0, "big": 1e-6})):
        mixed = cut(cp.mix_to_weights(spark, docs, "/nowhere", weights), name)
        assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
        found[name] = places(cp.encode_bytes(spark, mixed.repartition(5, "doc_id"), "/nowhere"))
        assert found[name] == places(mix_sources(docs, weights=weights)), name
    assert found["default"] != found["last"]
