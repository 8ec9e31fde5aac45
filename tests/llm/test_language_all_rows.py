"""The pipeline's language stage learns from every row, not from a sample."""

from tessera.llm import language_id


def test_prototypes_of_all_learning_rows(spark, monkeypatch):
    rows = [(i, f"the quick brown fox number {i} of the day", "en") for i in range(900)] + [(1000 + i, f"der schnelle braune fuchs zahl {i} des tages", "de") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = []
    real = language_id._drawn

    def counted(docs, per_language, held):
        found = real(docs, per_language, held)
        drawn.append((held, found.count()))
        return found

    monkeypatch.setattr(language_id, "_drawn", counted)
    assert language_id.keep_identified(docs).count() > 0
    held = docs.filter(language_id.held_out(docs["doc_id"])).count()
    assert drawn == [(False, 1800 - held), (True, held)]
