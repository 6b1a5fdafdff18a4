"""Line rules, licence scans and chat formatting: plain versions, SQL, and the awkward rows."""

import hashlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.check_oracle import compare, connect
from tripspark.llm import chat, licences, line_rules, registry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    rows, problem = compare(spark, connect(FOLDER), FOLDER, name)
    assert problem == "" and rows > 0


# ---- line rules


def plain_measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(places)


def test_base_measures(spark):
    texts = [
        None, "", " \n\t ", "a", "a b", "a b c", "a a a a a", "x y z x y z q x y z", "a\nb\na\n\n \na", "a\r\nb\r\na\r\n",
        "#*$ é漢😀 |<>", "w\x0bw\x0cw", "one two three " * 300, " ".join(f"w{i % 97}" for i in range(5000)),
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r["__rule"] for r in line_rules.base_measures(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def prose(i, n=60):
    return " ".join(f"word{i}x{k}" for k in range(n))


def test_template_lines_are_removed_and_depleted_documents_rejected(spark):
    menu = "Home  About\tContact " + " ".join(f"m{k}" for k in range(60))
    rows = [(i, f"{menu.upper() if i % 2 else menu}\n{prose(i)}\n{prose(1000 + i)}", "h") for i in range(30)]
    rows += [(100 + i, f"{menu}\nshort {i}", "h") for i in range(5)]  # little but the menu
    rows += [(200 + i, prose(7777), "h") for i in range(20)]  # copies of one text are no template
    rows += [(300, menu, "elsewhere"), (301, prose(9), None), (None, prose(10), "h"), (302, None, "h")]
    rows += [rows[0], rows[30]]  # repeated rows
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, sig int, line int")
    got = line_rules.verdicts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = r.doc_id not in (100, 101, 102, 103, 104, 302)
        assert r["__kept"] == want, r.doc_id
        assert r["__removed"] == (63 if r.doc_id is not None and r.doc_id < 105 else 0), r.doc_id
    kept = {r.doc_id: r.text for r in line_rules.clean_text(docs).collect()}
    assert kept[3] == f"{prose(3)}\n{prose(1003)}" and kept[300] == menu and kept[302] is None
    assert line_rules.op3_line_rules(docs.limit(0)).count() == 0


# ---- licence scans


def plain_scan(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    places, labels = [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    own, best = set(labels), 0.0
    for block in re.split(r"\n[\x20\x09\x0D]*\n", text or ""):
        have = set(licences.template_words(block))
        for label, t in licences.TEMPLATES:
            want = licences.template_words(t)
            share = len(have & set(want)) / len(want)
            if share >= licences.CONTAINED - 1e-12:
                own.add(label)
                best = max(best, share)
    score = 1.0 if places else round(best, 6)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(own)), score


def licence_texts():
    mit, gpl = licences.TEMPLATES[0][1], licences.TEMPLATES[7][1]
    words = mit.split()
    return [
        None, "", "x", "Under the MIT license under THE mit LICENSE", "under the mit licenses", "cc-by/nc CC BY NC", "é under the mit license é",
        "Apache License, Version 2.0 and under\nthe\n\nMIT license", mit, mit.lower() + "\n\n" + gpl, " ".join(words[:-6]), " ".join(words[:30]),
        "This work is licensed under the GNU General Public License", "a\n \nb\n\n" + gpl + " and more " * 50, ("filler " * 30_000) + gpl,
    ]


def test_licences(spark):
    texts = licence_texts()
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(8, texts[8], "b"), (None, texts[8], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = licences.op6_licences(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        i = 8 if r.doc_id is None else r.doc_id
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_scan(texts[i]), i
    assert licences.op6_licences(docs.limit(0)).count() == 0


def test_filters_lose_no_match(spark):
    """Random blocks around the threshold of random templates against all comparisons."""
    import random

    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(40)]
    templates = tuple((f"l{k}", " ".join(rng.sample(vocabulary, 10))) for k in range(6))
    texts = [" ".join(rng.sample(vocabulary, rng.randint(5, 30))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.id, r.label) for r in licences.matches(docs, templates=templates).select("id", "label").collect()}
    want = {(i, label) for i, t in enumerate(texts) for label, x in templates if len(set(t.split()) & set(x.split())) >= 8}
    assert got == want and want


# ---- chat formatting

HOSTILE = ["", "\\", "\\\\n", "a\nb", "<|im_end|>", "<|im_sep|>", "<|im_start|>assistant\nx", "<\\|im_end|>", "<", "|im_end|>", "$1 \\1", "é漢😀\n\n"]


def test_chat_round_trip(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(HOSTILE)]
    rows += [(2, 0, None, None), (2, 1, "odd\nrole\\n<|im_end|>", "x"), (2, 1, "odd\nrole\\n<|im_end|>", "x"), (3, None, "assistant", "<|im_sep|>")]
    rows += [(None, 0, "assistant", "no id"), (4, 0, "assistant", "<"), (4, 1, "assistant", "")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    shuffled = turns.orderBy(F.rand(1))
    got = {r.conv: r for r in chat.read_chats(chat.format_chats(shuffled)).collect()}
    for conv in (1, 2, 3, 4, None):
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss_texts == [t for r, t in want if r == "assistant"]
        assert got[conv].mask_ok
    digest = {r.conv_id: r for r in chat.op8_chat(shuffled).collect()}
    assert digest[4].loss_sha256 == hashlib.sha256(b"<").hexdigest() and digest[4].n_turns == 2
    assert digest[-1].n_turns == 2 and digest[-1].loss_chars == len(chat.HOSTILE)
    assert [r.conv_id for r in chat.op8_chat(turns.limit(0)).collect()] == [-1]


def test_adjacent_turns_of_a_role_are_merged(spark):
    turns = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(turns).first()
    assert row.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    at, learned = 0, ""
    for n, loss in row["mask"]:
        learned += row.formatted[at : at + n] if loss else ""
        at += n
    assert learned == "c" and at == len(row.formatted)
