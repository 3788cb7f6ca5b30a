"""Labels without a word that marks toxic documents."""

from slotwise.llm import toxicity


def test_labels_without_a_cue_still_fit_a_field(spark):
    alphabet = "abcdefghijklmnop"
    word = lambda i, j: "".join(alphabet[(i * 7 + j * 5 + k * (i + j + 1)) % 16] for k in range(6))
    docs = [(i, " ".join(word(i, j) for j in range(30))) for i in range(40)]
    labels = [(i, int(i % 10 == 0)) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    field = toxicity.fit(table, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert field is not None
    scores = [r.score for r in toxicity.score(table, field).collect()]
    assert len(scores) == 40 and all(0 <= s <= 1 for s in scores) and len(set(scores)) > 1


def test_labels_on_texts_without_words(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "doc_id bigint, toxic int")
    for texts in ([None, "", " ", ""], [None, "a b c", "d e", ""], []):
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        field = toxicity.fit(table, labels)
        assert field is None
        assert [r.score for r in toxicity.score(table, field).collect()] == [0.0] * len(texts)
