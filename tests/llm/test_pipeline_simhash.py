"""The pipeline's near copies are linked by their SimHash fingerprints, and by set similarity besides."""

import random

import corpus_pipeline
from casewright.llm import simhash


def test_fingerprints_link_what_set_similarity_does_not(spark):
    # The same long line again and again hides, from fingerprints, a set of other shingles.
    rng = random.Random(3)
    line = " ".join(f"w{rng.randrange(9999)}" for _ in range(11))  # an odd number, so no bit is near a tie
    tails = [" ".join(f"t{k}x{rng.randrange(99999)}" for _ in range(30)) for k in range(2)]
    texts = [" ".join([line] * 400 + [t]) for t in tails] + [" ".join(f"u{rng.randrange(9999)}" for _ in range(60))]
    bits = [simhash.fingerprint(t) for t in texts]
    assert 0 <= (bits[0] ^ bits[1]).bit_count() <= 2 < (bits[0] ^ bits[2]).bit_count()
    docs = spark.createDataFrame([(i + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert len({r.component_id for r in simhash.similar_groups(docs).collect()}) == 3
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
