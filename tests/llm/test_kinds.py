import numpy as np
from pyspark.sql import functions as F

from skein.llm import kinds as K
from skein.session import read


def test_models_come_from_all_documents(spark):
    """Languages as fitted to all texts at hand; k-means' means over all texts, of which there are more than 2,000."""
    docs = read(spark, "/root/testdata/sf0.1", "documents").where(F.col("doc_id") <= 4000)
    got = K.fit(docs)
    rows = docs.where(F.length("text") > 0).select("text", K.language_code(F.col("lang")).alias("g")).collect()
    order, table = K.fit_languages([r.text for r in rows if r.g], [r.g for r in rows if r.g])
    assert got.languages == order and np.allclose(got.trigrams, table)
    assert len(got.topics) == K.TOPICS and K.fit(docs.where(F.col("doc_id") < 0)).topics == []
    counts = [c for c in map(K.word_counts, (r.text for r in rows)) if c]
    seen = np.zeros(K.WORDS)
    for c in counts:
        seen[list({K._bucket(w) for w in c})] += 1
    idf = np.log((1 + len(counts)) / (1 + seen))
    assert len(counts) > 2000 and np.allclose(got.words[(idf == 0) | (seen == 0)], 0)
    assert (got.words[seen > 0].sum(axis=1) > 0).all()  # a word of any document counts
