"""The corpus pipeline against a plain version of every stage, and on the awkward rows."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_models import plain_raking
from tests.llm.test_native import plain_measures
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tripspark.llm import gam, line_rules, pieces, raking
from tripspark.llm.common import table

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the vocabulary file is not installed")


def plain_rules(docs):
    lines = {i: [" ".join(x.lower().split()) for x in t.split("\n") if x.strip()] for i, (t, _, _) in docs.items()}
    texts, held = defaultdict(set), defaultdict(set)
    for i, (t, _, source) in docs.items():
        texts[source].add(t)
        for x in lines[i]:
            held[source, x].add(t)
    template = {k for k, v in held.items() if len(v) >= line_rules.LINE_MIN_DOCS}
    kept = {}
    for i, (t, lang, source) in docs.items():
        n, _, _, _, repeated = plain_measures(t)
        gone = sum(len(x.split()) for x in lines[i] if (source, x) in template)
        if n >= 50 and 100 * repeated <= 50 * n and n - gone >= 0.5 * n:
            kept[i] = (t, lang, source)
    return kept


def plain_topic(t):
    size = max(1, len(t))
    if not t.strip(" "):
        return "empty"
    if t.count("|") * 50 > size:
        return "table"
    if t.count("\n") * 40 > size:
        return "list"
    return "long prose" if size >= 6000 else "prose" if size >= 1500 else "short prose"


def plain_mix(spark, docs):
    cells = Counter()
    for t, lang, source in docs.values():
        cells[source, lang, plain_topic(t)] += plain_measures(t)[0]
    axes = [sorted({k[i] for k in cells}) for i in range(3)]
    tokens = np.zeros([len(a) for a in axes])
    for k, n in cells.items():
        tokens[tuple(a.index(x) for a, x in zip(axes, k, strict=True))] = n

    def share(axis):
        held = tokens.sum(axis=tuple(i for i in range(3) if i != axis))
        raw = held * np.minimum((held / held.max()) ** -0.3, 1.5)
        return raw / raw.sum()

    w = plain_raking(tokens, share(0), share(1), share(2))
    ratio = np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)
    ratio /= ratio.max()
    ids = spark.createDataFrame([(i,) for i in docs], "doc_id long")
    key = F.xxhash64(F.lit(raking.SEED), "doc_id", F.lit(None).cast("string"))
    draws = {r.doc_id: r.u for r in ids.select("doc_id", (F.shiftrightunsigned(key, 11) * 2.0**-53).alias("u")).collect()}
    place = lambda d: tuple(a.index(x) for a, x in zip(axes, (d[2], d[1], plain_topic(d[0])), strict=True))
    return {i: d for i, d in docs.items() if draws[i] < ratio[place(d)]}


@needs_data
def test_pipeline_equals_a_plain_version(spark):
    raw = table(spark, FOLDER, "documents")
    model = gam.train(raw, table(spark, FOLDER, "labels"))
    docs = {r.doc_id: (r.text, r.lang, r.source) for r in raw.collect()}
    score = dict(zip(docs, model.score(gam.features([t for t, _, _ in docs.values()])), strict=True))
    docs = {i: d for i, d in docs.items() if score[i] >= 0.3}
    docs = plain_rules(docs)
    ids = list(docs)
    heads = plain_components(ids, [plain_fingerprint(docs[i][0]) for i in ids])
    docs = {i: docs[i] for i, h in zip(ids, heads, strict=True) if i == h}
    docs = plain_mix(spark, docs)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(docs) and len(docs) > 20
    v = pieces.load()
    for i, (text, _, _) in docs.items():
        assert got[i].token_ids == pieces.encode(v, [text], [i])[0].tolist() and got[i].lossless


def test_stages_on_awkward_rows(spark, tmp_path):
    good = " ".join(f"word{k} stands here" for k in range(40)) + "."
    rows = [(1, good, "en", "s"), (1, good, "en", "s"), (2, good, "en", "s"), (3, None, "en", None), (4, "", None, "s"), (None, good + " more", "en", "s"), (None, good + " more", "en", "s")]
    rows += [(5, "word " * 30_000, "en", "s"), (6, re.sub("word", "term", good), None, None)]
    rows += [(2, re.sub("word", "other", good), "en", "s")]  # one id, another text, in a group of its own
    rows += [(None, re.sub("word", "plain", good), "en", "s")] * 2  # no id in the group
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for folder, d in (("some", docs), ("none", docs.limit(0))):
        where = f"{tmp_path}/{folder}"
        d.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        now = spark.read.parquet(f"{where}/documents.parquet")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, where)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == corpus_pipeline.COLUMNS, name
            out.write.parquet(f"{where}/stage{k}")
            now = spark.read.parquet(f"{where}/stage{k}")
            if folder == "some" and name == "SimHash near-dedup":
                assert sorted(r.doc_id or 0 for r in now.collect()) == [0, 1, 2, 6]
        assert {r.lossless for r in now.collect()} <= {True}
        assert corpus_pipeline.run(spark, where).count() == now.count()
