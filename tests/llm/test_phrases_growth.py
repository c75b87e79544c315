"""What a task makes follows from its own text, however much other text there is."""

import pyarrow as pa

from layover.llm import phrases


def test_rows_of_a_task_do_not_grow_with_the_other_texts(spark, monkeypatch):
    made, spell = [], phrases.spell
    monkeypatch.setattr(phrases, "spell", lambda bitmaps: made.append(spell(bitmaps)) or made[-1])
    texts = [" ".join(f"w{i}" for i in range(50))] * 30
    for times in (1, 5):
        docs = [(k, text, "en") for k, text in enumerate(texts * times)]
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(times)
        phrases.collocations(df, min_count=100, first_doc=False).collect()
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * 30), pa.array(texts), pa.array(range(30), pa.int64())], names=["lang", "text", "doc"]
    )
    assert [sum(b.num_rows for b in run(iter([batch]))) for run in made] == [50, 50]
