import corpus_pipeline
from tallyfield.llm import near_copies, simhash


def test_stage_joins_what_simhash_and_similarity_link(spark):
    often = "alpha beta gamma delta epsilon zeta eta " * 50
    tails = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(3)]
    a, b, c = (often + t for t in tails)
    long = " ".join(f"v{k}" for k in range(200))
    docs = [(7, a), (2, b), (5, c), (8, long), (4, long + " more words"), (9, "alone"), (11, None), (10, ""), (7, a)]
    fp = {i: int(simhash.fingerprints_of([(t or "").encode()])[0]) for i, t in docs}
    assert max((fp[7] ^ fp[2]).bit_count(), (fp[7] ^ fp[5]).bit_count()) <= 4 and (fp[7] ^ fp[9]).bit_count() > 4
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert near_copies.keep_first(rows).count() == 6  # similarity alone keeps all three
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_first_copy(spark, rows, "").collect()]
    assert sorted(i for i, _ in got) == [2, 4, 9, 10] and dict(got)[2] == b
    # without any link by bits, sets still join the groups of their fingerprints
    assert sorted(r.doc_id for r in near_copies.keep_first_of_both(rows.where("doc_id IN (4, 8, 9)"), bits=0).collect()) == [4, 9]
