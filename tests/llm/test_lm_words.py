"""The network tells words of equal count apart."""

from stillwell.llm import lm


def test_network_learns_words_of_equal_count(spark):
    # words alternate strictly: a unigram model pays one bit for each, a recurrent one nearly none
    texts = [" ".join("ab"[(k + i) % 2] for k in range(1000)) for i in range(80)]
    got = lm.language_scores(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)
    assert sum(r.score for r in got) > 0.2 * sum(r.base_score for r in got)
