"""Tasks spell out words only; phrases are counted by the numbers of their words."""

from layover.llm import phrases
from tests.llm.test_phrases import plain


def test_phrases_are_not_spelled_in_every_task(spark, monkeypatch):
    sizes, spell = [], phrases.spell

    def counted(bitmaps):
        sizes.append(len(bitmaps))
        return spell(bitmaps)

    monkeypatch.setattr(phrases, "spell", counted)
    docs = [(k, "to be or not to be that is the question. To be or not", "en" if k % 2 else None) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(8)
    found = phrases.collocations(df, min_count=20, first_doc=False).collect()
    assert sorted(map(tuple, found)) == [r[:-1] for r in plain(docs, 20)] and found
    assert sizes == [1]
