import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import langid
from test_operators import brute_components, brute_secrets

SF = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in langid.identify(docs, ["doc_id"]).where("rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    keep = {c for _, n, c in brute_components(rows) if n} | {d for d, n, _ in brute_components(rows) if not n}
    rows = [r for r in rows if str(r[0]) in keep]
    flat = lambda t: " ".join(t.split())
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not any(i in flat(t) for i in items)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, text in rows:
        out, at = "", 0
        for a, _, _, b in brute_secrets(text):
            if a >= at and (a > at or not a):
                out, at = out + text[at:a] + "[SECRET]", b
            at = max(at, b)
        ids = np.array([*library.encode(out + text[at:], add_special_tokens=False).ids, 2], "<u4")
        stops = [*range(ids.size % 1024 or 1024, ids.size + 1, 1024)]
        want += [(d, k, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *stops[:-1]], stops, strict=True))]
    got = [(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language_id", "near_duplicates", "decontamination", "secrets", "packing"]
    for _, stage in stages[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_stages_on_odd_rows(spark):
    """Nulls, repeats, columns with the names that stages add, unlabelled and empty tables."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four", "en", "a", 9), (3, "one two three four", "en", "a", 9), (None, "a text without an id", "fr", "x", 1), (None, None, None, None, None), (4, "token: abcdefgh", None, "x", 1)]
    clash = spark.createDataFrame(rows, schema)
    for name in ("lang_pred", "score", "rejected", "row", "id", "node", "blob", "spans", "bad", "letters", "order", "offset", "sequence_id", "dk", "text2"):
        clash = clash.withColumn(name, F.lit("clash"))
    stages = dict(corpus_pipeline.STAGES)
    for docs, n, known in ((clash, 7, 3), (clash.withColumn("lang", F.lit(None).cast("string")), 7, 4), (clash.limit(0), 0, 0)):
        for name, want in (("language_id", known), ("near_duplicates", 6), ("decontamination", 7), ("secrets", 7)):
            out = stages[name](spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            got = out.collect()
            assert len(got) == (want if n else 0), name
            assert all(r.score == "clash" for r in got)
        assert stages["packing"](spark, docs, SF).count() == n
    assert [r.text for r in stages["secrets"](spark, clash, SF).where("doc_id = 4").collect()] == ["[SECRET]"]
