"""Alignment of two tokenizers against pairs of byte ranges, with the libraries of the two files."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripspark.llm import alignment
from tripspark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, a int, rid string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.TOKENIZER_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.TOKENIZER_B)


def plain(rows, libraries):
    """Every pair of overlapping tokens, found from the byte ranges alone."""
    a_lib, b_lib = libraries
    letter = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letter)}
    links_of, out = [], []
    for doc_id, text in rows:
        whole = f" {text}".encode() if text else b""
        a = a_lib.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        spelled_a = [bytes(letter[c] for c in a_lib.id_to_token(i)) for i in a]
        spelled_b = []
        for i in b:
            p = b_lib.id_to_piece(i)
            spelled_b.append(bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            a, b, spelled_a, spelled_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in spelled_a], dtype=int), np.cumsum([len(x) for x in spelled_b], dtype=int)
        starts_a, starts_b = ends_a - [len(x) for x in spelled_a], ends_b - [len(x) for x in spelled_b]
        links = [(i, j) for i, j in np.argwhere((starts_a[:, None] < ends_b[None, :]) & (starts_b[None, :] < ends_a[:, None]))] if a else []
        links = [(a[i], b[j]) for i, j in links]
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, low = [], 0
        for c in cuts:
            part = [",".join(str(t) for t, s in zip(ids, starts, strict=True) if low <= s < c) for ids, starts in ((a, starts_a), (b, starts_b))]
            groups.append("|".join(part))
            low = c
        links_of.append(links)
        out.append([doc_id, len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = Counter(p for links in links_of for p in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted((o[0] is not None, *o[:5], sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), o[5]) for o, links in zip(out, links_of, strict=True))


def told(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((r.doc_id is not None, *(r[n] for n in names)) for r in df.collect())


TEXTS = [
    "The cat sat on the mat.", "", None, "  two  spaces, tabs\t and\n\nlines ", "größer Ünicode 日本語 🙂🙂", "has ▁ inside",
    "<|endoftext|> and <s> stay text", "a" * 3000, "word " * 900, "The cat sat on the mat.", "\x00\x01\x7f", "'s 't'll 12345 ...!?", " ", "‍﻿ é",
]


def test_equals_overlaps_of_byte_ranges(spark, libraries):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (99, "tail"), (None, "no id"), (-5, "x" * 700 + " y")]
    df = spark.createDataFrame([(i, t, None, 1, "x") for i, t in rows], SCHEMA)
    fixed = [(i if i is not None else -1, t) for i, t in rows]
    got = alignment.op12_alignment(df.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))))
    assert told(got) == plain(fixed, libraries)
    assert alignment.op12_alignment(df).filter("doc_id IS NULL").count() == 1
    assert alignment.op12_alignment(df.limit(0)).collect() == []


def test_whole_table_equals_overlaps(spark, libraries):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 2500]
    assert told(alignment.op12_alignment(docs.filter("coalesce(length(text), 0) < 2500"))) == plain(short, libraries)


def test_counts_in_parts_are_the_same(spark):
    docs = table(spark, SF, "documents")
    assert told(alignment.op12_alignment(docs, part_rows=5000)) == told(alignment.op12_alignment(docs))


def test_lanes_change_no_link(monkeypatch):
    v = alignment.load()
    a_of, b_of = alignment.encoders(v)
    a_bytes, b_bytes = alignment.Bytes(v["a"]), alignment.Bytes(v["b"])
    texts = [" the quick brown foxes" * 200, "", " Donaudampfschifffahrt" * 90, "zzzzqqq" * 400]
    empty = np.zeros(0, np.int32)
    a, b = [[f(t) if t else empty for t in ts] for f, ts in ((a_of, [" " + t if t else "" for t in texts]), (b_of, texts))]
    sizes = [np.array([len(x) for x in y], dtype=np.int64) for y in (a, b)]
    flat = [np.concatenate(y) for y in (a, b)]
    found = []
    for lane in (16, 384, 10**9):
        monkeypatch.setattr(alignment, "LANE", lane)
        la, lb, ca, cb = alignment.align(a_bytes, b_bytes, *flat, *sizes)
        found.append((sorted(zip(la.tolist(), lb.tolist(), strict=True)), sorted(zip(ca.tolist(), cb.tolist(), strict=True))))
    assert found[0] == found[1] == found[2]


def test_merges_out_of_order_are_refused(tmp_path):
    import json

    with open(alignment.TOKENIZER_A, encoding="utf-8") as f:
        told_ = json.load(f)
    told_["model"]["merges"] = told_["model"]["merges"][::-1]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(told_), encoding="utf-8")
    with pytest.raises(ValueError, match="order of ids"):
        alignment.load(str(path))
