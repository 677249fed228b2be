import corpus_pipeline
from pyspark.sql import functions as F

from lectern.llm import queries as registered
from lectern.llm import secrets

from .helpers import empty_documents, odd_documents


def test_stages_do_what_they_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    left = secrets.find(docs).where(F.size("base") > 0)
    assert left.count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_toxic_and_contaminated_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).select("doc_id").distinct()
    flagged = registered.op2_toxicity(spark, sf).where("predicted = 1").select("doc_id")
    assert out.join(flagged, "doc_id").count() == 0
    leaked = registered.op7_decontamination(spark, sf).where("contaminated").select("doc_id")
    assert out.join(leaked, "doc_id").count() == 0
    assert out.join(docs, "doc_id", "left_anti").count() == 0


def test_every_operator_has_its_query():
    names = registered.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_stages_take_odd_rows_and_none(spark, sf):
    odd = odd_documents(spark, [(400, "password = hunter2hunter2 and on")])
    for docs in (odd, empty_documents(spark)):
        counts = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)  # each on the odd rows themselves
            assert out.columns == corpus_pipeline.COLUMNS
            counts.append(out.count())
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        if docs is odd:
            # 8 twice, 5 and 6, and the texts without words (1, 2, 9 and a null id) are near-duplicates
            assert counts == [15, 10, 15, 15]
            assert packed.where("piece = 0").count() == 15
            redacted = corpus_pipeline.STAGES[3][1](spark, docs, sf).where("doc_id = 400").first()
            assert redacted.text == "[REDACTED] and on" and redacted.n_chars == len(redacted.text)
        else:
            assert counts == [0, 0, 0, 0] and packed.count() == 0
