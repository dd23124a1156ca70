"""The pipeline against its stages one after another on the driver."""

import hashlib
import random

import pandas as pd
import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from braidwork.llm import spm, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(21)
    words = [a + b for a in "the of on er th ly es ti ng re".split() for b in "ab cd ef gh ij kl mn op".split()]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    license_, passage = make(30), make(14)
    texts = [make(r.randint(20, 150)) for _ in range(300)]
    texts[29] = make(80)
    texts[10:20] = [f"{t}\n{license_}\n{make(20)}" for t in texts[10:20]]
    texts[30:33] = [texts[29]] * 3
    texts[40] = texts[41] + " tail"
    texts[50] += " " + passage + " " + make(10)
    texts[60] = " ".join("changed" if k == 40 else w for k, w in enumerate(texts[61].split() + make(60).split()))
    texts[55] = texts[60].replace("changed", "instead")
    toxic = set(range(100, 200, 2))
    texts = [t + " idiot " + make(5) if i in toxic else t for i, t in enumerate(texts)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(250)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, toxic, passage


def without_repeated_lines(docs):
    """Every run of lines with 10 words or more that stands in an earlier document is cut; what has no word left goes."""
    out = []
    for n, (i, t) in enumerate(docs):
        a, gone = (t or "").split("\n"), set()
        for _, other in docs[:n]:
            b = (other or "").split("\n")
            for x in range(len(a)):
                for y in range(len(b)):
                    size = 0
                    while x + size < len(a) and y + size < len(b) and a[x + size] == b[y + size]:
                        size += 1
                    if sum(len(s.split()) for s in a[x : x + size]) >= 10:
                        gone |= set(range(x, x + size))
        new = "\n".join(s for k, s in enumerate(a) if k not in gone)
        if not gone or new.strip():
            out.append((i, new if gone else t))
    return out


def one_of_each(docs):
    """The first document of each group linked by a Jaccard similarity of 0.8 of five-word shingles, or equal words."""
    words = [tuple((t or "").lower().split()) for _, t in docs]
    sets = [{w[k : k + 5] for k in range(max(len(w) - 4, 1))} if w else set() for w in words]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if words[a] == words[b] or 10 * len(sets[a] & sets[b]) >= 8 * max(len(sets[a] | sets[b]), 1):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    return [d for k, d in enumerate(docs) if group[k] == k]


def passage_in(text, passage):
    w, p = (text or "").lower().split(), passage.lower().split()
    windows = {tuple(p[k : k + 10]) for k in range(len(p) - 9)}
    return any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))


def test_pipeline_matches_brute_force(spark, tables):
    folder, toxic, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    machine = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scores(docs, machine).where("predicted = 1").collect()}
    assert len(bad & toxic) >= 0.9 * len(toxic) and not bad - toxic
    left = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad)
    kept = [(i, t) for i, t in one_of_each(without_repeated_lines(left)) if not passage_in(t, passage)]
    assert set(got) == {i for i, _ in kept} and not set(got) & {31, 32, 50, 60}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    for i, t in kept:
        assert got[i].n_ids == len(sp.encode(t or "")) and got[i].exact
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_stages_keep_columns(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.names == docs.schema.names
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0
    assert isinstance(corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas(), pd.DataFrame)
