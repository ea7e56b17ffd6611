import corpus_pipeline

from lexweave.llm.components import connected_components
from lexweave.llm.decontam import find_overlaps
from lexweave.llm.jaccard_join import jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == names and 0 < out.count() <= docs.count(), name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    assert find_overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert jaccard_components(docs).where("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100), (200, 300), (300, 200), (None, 4)] + [(500 + i, 600) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(51)} | {200: 200, 300: 200} | {500 + i: 500 for i in range(40)} | {600: 500}
    assert got == want


def test_stages_against_plain_versions(spark, tmp_path):
    """The whole pipeline on few documents: the classifier's verdicts, then every other stage by comparing all pairs."""
    import random

    import brute
    import public_tokenizers
    from test_line_dedup import plain_cuts
    from tokenizers import Tokenizer

    from lexweave.llm.quality import quality_scores

    r = random.Random(2)
    sentence = lambda: " ".join(f"word{r.randrange(900)}" for _ in range(r.randrange(6, 14))) + "."
    common = [sentence() for _ in range(6)]
    texts = ["\n".join(sentence() for _ in range(r.randrange(1, 6))) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", "\n".join([common[0], sentence(), common[1]]), "\n".join([sentence(), common[0], common[1]])]
    item = " ".join(f"leak{k}" for k in range(16))
    texts += [f"before\n{item} after it", "", None]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(len(texts)) if d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    kept = {x.doc_id for x in quality_scores(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels).where("predicted = 1").collect()}
    left = {d: t for d, t in enumerate(texts) if d in kept}
    cuts = plain_cuts([(d, t) for d, t in left.items() if t], 5)
    for d, gone in cuts.items():
        lines = left[d].split("\n")
        if gone and len(gone) == sum(1 for x in lines if x.strip()):
            del left[d]
        elif gone:
            left[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    groups = brute.jaccard_components([(d, t or "") for d, t in left.items()])
    left = {d: t for d, t in left.items() if groups[d][1] == d and not brute.overlaps(t or "", item)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in left.items()}
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == want and 3 < len(got) < len(texts)
