"""Quality classifier, language models, pieces, search, extraction and raking against plain versions and held-out rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripspark.llm import gam, html_text, langid, permutation_index, pieces, raking
from tripspark.llm.common import table

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
needs_pieces = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the vocabulary file is not installed")
LONG = "word " * 40_000


# ---- quality classifier


@needs_data
def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    got = gam.op1_quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    joined = got.merge(labels.toPandas(), on="doc_id")
    joined = joined[joined.held_out]
    pos, neg = joined.score[joined.quality == 1].to_numpy(), joined.score[joined.quality == 0].to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.95 and (joined.predicted == joined.quality).mean() > 0.93


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but an interaction
    m = gam.fit(x, y)
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.9
    i = 17
    total = m.intercept + sum(t[(m.edges[j] <= x[i, j]).sum()] for j, t in enumerate(m.tables))
    total += sum(t[(m.coarse[a] <= x[i, a]).sum(), (m.coarse[b] <= x[i, b]).sum()] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
    assert m.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, LONG, 9), (3, "a\n\nb", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = gam.op1_quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert gam.op1_quality(docs.limit(0), labels.limit(0)).count() == 0


# ---- language models


@needs_data
def test_language_on_held_out_documents(spark):
    docs = table(spark, FOLDER, "documents")
    got = langid.op10_language(docs).toPandas().merge(docs.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    assert got.rejected.mean() < 0.05


def plain_kneser_ney(texts, probe):
    """Log probability of every four-gram of ``probe`` after its first three letters, from the definition."""
    types = {4: Counter(int(g) for t in texts for g in langid.grams(t))}
    for k in (3, 2, 1):
        types[k] = Counter(g & langid._MASKS[k] for g in types[k + 1])
    contexts = {k: defaultdict(lambda: [0, 0]) for k in types}
    for k, grams in types.items():
        for g, c in grams.items():
            contexts[k][g >> 16][0] += c
            contexts[k][g >> 16][1] += 1
    rate = {}
    for k, grams in types.items():
        n1, n2 = (sum(c == i for c in grams.values()) for i in (1, 2))
        rate[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))

    def p(g, k):
        if k == 0:
            return 1 / (len(types[1]) + 1)
        g &= langid._MASKS[k]
        total, kinds = contexts[k].get(g >> 16, (0, 0))
        if not total:
            return p(g, k - 1)
        return max(types[k].get(g, 0) - rate[k], 0) / total + rate[k] * kinds / total * p(g, k - 1)

    return [math.log(p(int(g), 4)) for g in langid.grams(probe)]


def test_probabilities_follow_the_definition(spark):
    texts = ["the cat sat on the mat", "a cat and a hat", "that was the end of it, the end"]
    counts = langid.count_grams(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    model = langid.collect_model(langid.estimate(counts))
    for probe in ("the cat had a bath", "zzz", "éa the"):
        got = model.log_probability("en", langid.grams(probe))
        assert got == pytest.approx(plain_kneser_ney(texts, probe), rel=1e-5)
    e = model.entropies(["the cat", None, "12 !?", "the mat"])
    assert np.isnan(e[1:3]).all() and e[0, 0] == pytest.approx(-np.mean(plain_kneser_ney(texts, "the cat")), rel=1e-5)


def test_unseen_grams_are_not_found_in_a_large_model(spark):
    known = spark.range(600_000).select(F.lit("x").alias("lang"), F.lit(4).alias("kind"), F.xxhash64("id").alias("key"), F.lit(-1.0).alias("value"))
    model = langid.collect_model(known)
    keys = lambda a, b: np.array([r.k for r in spark.range(a, b).select(F.xxhash64("id").alias("k")).collect()]).view(np.uint64)
    assert (model.lookup("x", 4, keys(0, 20_000)) == -1).all()
    assert np.isnan(model.lookup("x", 4, keys(600_000, 640_000))).all()


def test_models_beyond_the_broadcast_bound_are_joined(spark):
    texts = [("en", "the cat sat on the mat"), ("en", "a cat and a hat"), ("es", "el gato y la casa"), ("es", "la casa del gato")]
    estimates = langid.estimate(langid.count_grams(spark.createDataFrame(texts, "lang string, text string")))
    small, large = langid.collect_model(estimates), langid.collect_model(estimates, most=10)
    assert large.stored is not None and not large.tables
    probes = [(1, "the casa"), (1, "the casa"), (2, None), (3, "12 !?"), (None, "zzz éa gato"), (4, "that hat"), (5, LONG)]
    docs = spark.createDataFrame(probes, "doc_id long, text string")
    want, got = ([(r.doc_id, *(-1.0 if x is None else x for x in r["__lang"])) for r in langid.scored(docs, m).collect()] for m in (small, large))
    order = lambda rows: sorted(rows, key=lambda r: str(r[:2]))
    assert len(got) == len(want)
    for a, b in zip(order(got), order(want), strict=True):
        assert a[:2] == b[:2] and a[4] == b[4] and a[2:4] == pytest.approx(b[2:4], rel=1e-9)


def test_thresholds_cover_every_training_text(spark):
    rng = np.random.default_rng(8)
    names = ["".join(rng.choice(list("abcdefgh"), 12)) for _ in range(6000)]
    rows = [(4 * i, t, "en") for i, t in enumerate(names)] + [(40_000 + 4 * i, "el niño y la casa " + "ñ" * i, "es") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = langid.train(docs)
    got = langid.scored(docs, model).select("lang", "__lang.*").toPandas()
    own = {k: e.to_numpy() for k, e in got[got.lang == got.pred].groupby("lang").entropy}
    assert len(own["en"]) > 4000 and len(own["es"]) < 20
    assert abs((own["en"] > model.limits["en"]).mean() - langid.REJECTED) < 2e-4 + 1 / len(own["en"])
    shared = np.quantile(np.concatenate(list(own.values())), 1 - langid.REJECTED)
    assert own["es"].max() <= model.limits["es"] < math.inf
    assert model.limits["es"] == pytest.approx(max(own["es"].max(), shared), rel=0.01)


def test_language_awkward_rows(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(12)] + [(20 + i, "el gato y la casa", "es") for i in range(12)]
    rows += [(50, None, "en"), (51, "", "en"), (52, "12 34 !", None), (None, "the cat", "en"), (53, LONG, None), (50, None, "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, __x string")
    got = langid.op10_language(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == "en" and by[23].lang_pred == "es" and by[None].lang_pred == "en"
    assert [by[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and by[51].score == 0
    assert {r.lang_pred for r in langid.op10_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.op10_language(docs.limit(0)).count() == 0


# ---- pieces

TEXTS = ["", "Hello  world", " lead", "trail  ", "tab\tand\nline", "▁literal ▁ mark", "漢字 😀 ñandú", "a" * 300, "x y " * 50, "   ", "<s> <0x0A> </s>"]


@needs_pieces
def test_without_dropout_as_the_library():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = pieces.load()
    texts = [t for t in TEXTS if "▁" not in t and "<" not in t] + ["The quick brown fox jumps over the lazy dog", "antidisestablishmentarianism " * 3, "überraschung été niño"]
    got = pieces.encode(v, texts, list(range(len(texts))), dropout=0.0)
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == m.encode(t), t


@needs_pieces
@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_round_trip_and_variety(dropout):
    v = pieces.load()
    got = pieces.encode(v, TEXTS, list(range(len(TEXTS))), dropout=dropout)
    assert [pieces.decode(v, g) for g in got] == TEXTS
    again = pieces.encode(v, TEXTS[::-1], list(range(len(TEXTS)))[::-1], dropout=dropout)[::-1]
    assert all((a == b).all() for a, b in zip(got, again, strict=True))  # no matter what stands beside
    if dropout == 0.5:
        ways = {tuple(g.tolist()) for g in pieces.encode(v, ["segmentation"] * 50, list(range(50)), dropout=dropout)}
        assert len(ways) > 2


@needs_pieces
def test_batches_and_heap_agree():
    v = pieces.load()
    rng = np.random.default_rng(2)
    chunks = [" " + "".join(rng.choice(list("abcdeiost"), rng.integers(1, 23))) for _ in range(300)]
    keys = rng.integers(0, 1 << 63, len(chunks), dtype=np.uint64)
    for dropout in (0.0, 0.3):
        flat, starts = pieces._segment(v, chunks, keys, dropout)
        for i, c in enumerate(chunks):
            want, _ = pieces._heap(v, v.letters[pieces._codes([c])], keys[i], dropout)
            assert flat[starts[i] : starts[i + 1]].tolist() == want


@needs_pieces
def test_every_occurrence_is_drawn_for_by_itself():
    v = pieces.load()
    n = 4000
    got = [tuple(g.tolist()) for g in pieces.encode(v, ["internationalisation"] * n, list(range(n)))]
    assert len(set(got)) > 8
    (plain,) = {tuple(g.tolist()) for g in pieces.encode(v, ["internationalisation"], [0], dropout=0.0)}
    assert 0.1 < np.mean([g == plain for g in got]) < 0.9
    (one,) = pieces.encode(v, [" ".join(["internationalisation"] * n)], [1])  # inside one document as well
    cuts = np.flatnonzero([v.spelled[i].startswith(b" ") for i in one])
    assert len(cuts) == n and len({tuple(x.tolist()) for x in np.split(one, cuts[1:])}) > 8


@needs_pieces
def test_pieces_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "no id"), (4, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, token_ids int")
    got = pieces.encoded(docs).collect()
    assert len(got) == 6 and all(r["__pieces"].lossless for r in got)
    for r in got:
        p = r["__pieces"]
        assert p.n_pieces == len(p.token_ids) and p.ids_sha256 == hashlib.sha256(np.array(p.token_ids, "<i4").tobytes()).hexdigest()
    back = pieces.decoded(pieces.encoded(docs.select("doc_id", "text")).select("doc_id", "__pieces.token_ids")).collect()
    assert Counter(r.text for r in back) == Counter(t or "" for _, t in rows)
    assert pieces.op5_pieces(docs.limit(0)).count() == 0


# ---- nearest neighbours


def plain_nearest(ids, vectors, queries, k):
    v = np.array(vectors, dtype=np.float64)
    norm = np.sqrt((v**2).sum(axis=1))
    out = {}
    for q in queries:
        at = ids.index(q)
        s = (v * v[at]).sum(axis=1) / (norm * norm[at])
        order = sorted((i for i in range(len(ids)) if i != at), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[100:200] = v[100]  # a third of the rows share a vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [float("inf")] + [1.0] * 15), (1200, [1.0] * 3), (1250, [None] + [1.0] * 15)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows + odd + rows[:3]], "vec_id long, embedding array<float>, score double")
    got = defaultdict(list)
    for r in sorted(permutation_index.op9_nearest(frame).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    want = plain_nearest(list(range(300)), v.tolist(), [0, 50, 100, 150, 200, 250], 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    for q, x in got.items():
        assert [s for _, s in x] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    few = permutation_index.op9_nearest(frame.filter("vec_id < 3")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]
    assert permutation_index.op9_nearest(frame.limit(0)).count() == 0
    assert permutation_index.op9_nearest(frame.filter("vec_id = 0")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="check tables are not mounted")
def test_recall(spark):
    frame = table(spark, "/root/testdata/check_s", "embeddings")
    rows = frame.toPandas().sort_values("vec_id")
    ids = rows.vec_id.tolist()
    got = defaultdict(set)
    for r in permutation_index.op9_nearest(frame).collect():
        got[r.query_id].add(r.vec_id)
    queries = [i for i in ids if i % 50 == 0]
    want = plain_nearest(ids, rows.embedding.tolist(), queries[::4], 5)
    assert set(got) == set(queries)
    assert np.mean([len(got[q] & {i for i, _ in x}) / 5 for q, x in want.items()]) >= 0.9


# ---- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, friend.</p></div>
<div id="page"><div class="%s"><h1>Title</h1><p>First, with &amp; and &eacute;,
 more <b>bo</b>ld text here, and it goes on for a while.<br>Next<p>Second&nbsp;one, also long enough to count, with commas, yes.
<p>Tiny.</p><table><tr><td>cell</table><ul><li>one<li>two</ul><div class="ad">Buy, now, cheap!</div><form><p>Sign up, please</p></form></div>
<aside>Side, bar, text</aside><section class="comments"><p>Nice, post, I like it, a lot, really, truly.</p></section></div><footer>&copy; x</footer></body></html>"""
MAIN = "Title First, with & and é, more bold text here, and it goes on for a while. Next Second one, also long enough to count, with commas, yes. Tiny. cell one two"


@pytest.mark.parametrize("kind", ["post", "content body"])
def test_main_text(kind):
    assert html_text.extract(PAGE % kind) == MAIN
    more = '<ol class="commentlist"><li>So, true, I say, and so on and on.</ol><article class="comment"><p>Me, too, and more, and more.</article>'
    assert html_text.extract((PAGE % kind).replace('<section class="comments">', f'{more}<section class="comments">')) == MAIN
    assert html_text.extract((PAGE % kind).replace(f'<div class="{kind}">', "<article>").replace("</form></div>", "</form></article>")) == MAIN


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("   ", ""), ("plain  text", "plain text"), ("<p>one", "one"), ("<b>a</b>b<p>c", "ab c"), ("<div><nav>x</nav></div>", ""), ("<" * 50, "<" * 50)])
def test_odd_pages(html, text):
    assert html_text.extract(html) == text


def test_deep_and_long_pages():
    assert html_text.extract("<div>" * 20_000 + "deep, text") == "deep, text"
    assert html_text.extract("<article>" + "<p>" + "long, " * 50_000 + "</article>") == ("long, " * 50_000).strip()


@needs_data
def test_given_pages(spark):
    pages = table(spark, FOLDER, "pages")
    got = {r.page_id: r for r in html_text.op4_main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        want = " ".join(__import__("html").unescape(re.sub(r"</?(?:p|br|h1)\b[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    odd = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5)], "page_id long, url string, html string, text int")
    assert [tuple(r) for r in html_text.op4_main_text(odd).collect()] == [(1, None, "", 0)] * 2
    assert html_text.op4_main_text(odd.limit(0)).count() == 0


# ---- raking


def plain_raking(tokens, sources, langs, topics, sweeps=2000):
    w = tokens / tokens.sum()
    for _ in range(sweeps):
        for axis, target in enumerate((sources, langs, topics)):
            other = tuple(i for i in range(3) if i != axis)
            have = w.sum(axis=other)
            ratio = np.divide(target, have, out=np.zeros_like(have), where=have > 0)
            w = w * ratio.reshape([-1 if i == axis else 1 for i in range(3)])
    return w


def test_raking_reaches_its_targets(spark):
    rng = np.random.default_rng(6)
    t = rng.integers(0, 1000, (5, 3, 4)).astype(float)
    t[0] *= 50  # a hot source
    t[2, 1] = 0
    s, g, p = ([f"{n}{i}" for i in range(k)] for n, k in zip("sgp", t.shape, strict=True))
    cells = spark.createDataFrame(
        [(s[a], g[b], p[c], int(t[a, b, c])) for a in range(5) for b in range(3) for c in range(4)], "source string, lang string, topic string, tokens long"
    )
    want_s, want_g, want_p = np.array([0.2, 0.2, 0.2, 0.3, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.25] * 4)
    got = raking.rake(cells, dict(zip(s, want_s, strict=True)), dict(zip(g, want_g, strict=True)), dict(zip(p, want_p, strict=True)))
    assert got.converged
    fs = {r.source: r.factor for r in got.sources.collect()}
    w = np.array([[[t[a, b, c] * fs[s[a]] * got.cells.get((g[b], p[c]), 0.0) for c in range(4)] for b in range(3)] for a in range(5)])
    w /= w.sum()
    assert w == pytest.approx(plain_raking(t, want_s, want_g, want_p), abs=1e-7)
    assert w.sum(axis=(1, 2)) == pytest.approx(want_s, abs=1e-8) and w.sum(axis=(0, 2)) == pytest.approx(want_g, abs=1e-8)


@needs_data
def test_sample_has_the_target_shares(spark):
    docs = table(spark, FOLDER, "documents")
    got = raking.op2_mixing(docs).toPandas()
    assert len(got) == docs.count() and got.probability.between(0, 1).all() and abs(got.probability.max() - 1) < 1e-9
    expected = (got.tokens * got.probability).groupby(got.lang).sum()
    held = got.groupby("lang").tokens.sum()
    want = held * np.minimum((held / held.max()) ** (raking.TEMPER["lang"] - 1), raking.UPLIFT)
    assert got.kept.mean() > 0.4
    assert (expected / expected.sum()).to_numpy() == pytest.approx((want / want.sum()).to_numpy(), abs=1e-6)
    kept = (got.tokens * got.kept).sum()
    assert kept == pytest.approx((got.tokens * got.probability).sum(), rel=0.1)


def test_mixing_awkward_rows(spark):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (None, "c d e", None, "t"), (4, LONG, "fr", None)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, lang string, source string, topic int, factor int")
    got = raking.mixed(docs).collect()
    assert len(got) == 6 and all(0 <= r["__mix"].probability <= 1 for r in got)
    same = [r["__mix"].kept for r in got if r.doc_id == 1]
    assert same[0] == same[1]
    assert raking.op2_mixing(docs.limit(0)).count() == 0
