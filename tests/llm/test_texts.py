"""Operators on single texts against plain versions of the same definitions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sentspark.llm import language_id as L, line_blocks as B, line_crf as C, winnowing as W
from sentspark.llm.bfd_packing import LENGTH, WordEncoder, best_fit, pack_documents

TOKENS = public_tokenizers.path("word_bpe_49k.json")


# --- packing ------------------------------------------------------------------------------


def test_packing(hard, hard_texts, none):
    rows = pack_documents(hard, TOKENS).collect()
    tokenizer = Tokenizer.from_file(TOKENS)
    want = Counter()
    for doc, text in hard_texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), LENGTH):
            part = np.array(ids[start:start + LENGTH], "<u4")
            want[doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= LENGTH
    assert pack_documents(none, TOKENS).collect() == []


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    for top in (5, 64, 200):
        lengths = sorted(rng.integers(1, top, 300).tolist(), reverse=True)
        rooms, want = [], []
        for need in lengths:
            fitting = [r for r in rooms if r >= need]
            room = min(fitting) if fitting else top
            if fitting:
                rooms.remove(room)
            want.append(top - room)
            if room > need:
                rooms.append(room - need)
        windows, offsets = best_fit(lengths, top)
        assert sorted(offsets) == sorted(want) and len(set(windows)) == sum(o == 0 for o in offsets)


def test_words_are_encoded_as_whole_texts():
    encoder, tokenizer = WordEncoder(TOKENS), Tokenizer.from_file(TOKENS)
    pieces = ["It's", "x'sx", "don't", "I'LL", "İ", "ΣΑΣ", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "\xa0", "½", "a,b.c!!", "12a", "漢字", "µM", "ﬁ", "###"]
    for a, b in itertools.product(pieces, repeat=2):
        for gap in (" ", "", "\n"):
            text = a + gap + b
            assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_frequent_words_are_learned_once(monkeypatch):
    """Memory that turns over keeps what is in use, and asks the model for many units at a time."""
    monkeypatch.setattr("sentspark.llm.bfd_packing.CACHED_WORDS", 50)
    encoder, tokenizer, asked = WordEncoder(TOKENS), Tokenizer.from_file(TOKENS), []
    units = encoder._units
    encoder._units = lambda new: asked.append(list(new)) or units(new)
    for i in range(40):
        texts = [f"the word{'abcdefgh'[i % 8] * j} is, {chr(97 + i % 26) * (j + 1)}{i}; it's" for j in range(10)]
        assert encoder.encode_all(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(encoder.words) + len(encoder.older) < 50 * 2 + 2 * 60
    assert sum(b"the" in new for new in asked) == 1 and sum(b"," in new for new in asked) == 1
    assert len(asked) <= 40 < sum(map(len, asked))


def test_texts_are_encoded_together_as_alone():
    encoder, tokenizer = WordEncoder(TOKENS), Tokenizer.from_file(TOKENS)
    texts = [f"A{chr(a)}b'{chr(a)}s {chr(a)}{chr(b)} Ä{chr(b)}9" for a in range(256) for b in (a, 39, 60, 124, 233)]
    texts = ["", " \t\n\x0b\x0c\r ", *texts, "İ Hello hello, HELLO", "e\u0301 É", "<|endoftext|>", "’quoted’ words, “and” more", ""]
    assert encoder.encode_all(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode_all([]) == [] and encoder.encode_all([""]) == [b""]


def test_models_without_a_mark_at_the_end_of_words():
    encoder = WordEncoder(TOKENS)
    marked = encoder._units([b"this", b"&&&", "é".encode()])
    encoder.ends[:] = False
    assert encoder._units([b"this", b"&&&", "é".encode()]) == marked


# --- winnowing ----------------------------------------------------------------------------


def slow_winnow(text, k, window):
    grams = [text[i:i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    hashes = [int(W.gram_hashes(W.codes_of(g), k)[0]) for g in grams]
    chosen = {}
    for i in range(max(1, len(hashes) - window + 1)) if hashes else []:
        part = hashes[i:i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        chosen[at] = hashes[at]
    return sorted((p, h) for p, h in chosen.items())


@pytest.mark.parametrize("k,window", [(1, 1), (3, 4), (7, 5), (24, 17)])
def test_winnow(k, window):
    for text in ("", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the cat sat on the mat and the cat sat on the mat", "👍é漢" * 20):
        hashes, places = W.winnow(W.codes_of(text), k, window)
        assert list(zip(places.tolist(), hashes.tolist())) == slow_winnow(text, k, window)


def test_shared_passage_is_found():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b, shared = ("".join(map(chr, rng.integers(97, 110, n))) for n in (80, 60, W.K + W.WINDOW - 1))
        one, two = W.winnow(W.codes_of(a + shared))[0], W.winnow(W.codes_of(shared + b))[0]
        assert len(np.intersect1d(one, two))


def test_edits(spark, hard, hard_texts, none):
    got = W.fingerprint_edits(hard).collect()
    order = sorted(((d, t or "") for d, t in hard_texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:3] for r in got) == want
    assert W.fingerprint_edits(none).collect() == []
    one = W.fingerprint_edits(spark.createDataFrame([(3, "abcdefgh" * 9)], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    prints = {}
    for r in W.fingerprints(hard).collect():
        prints.setdefault(r["doc_id"], set()).add(tuple(r["hashes"]))
    assert prints[1] == prints[2] and len(prints[7]) == 1 and prints[4] == prints[5] == {()}


# --- line labelling -----------------------------------------------------------------------


def test_counts_and_labels(hard, hard_texts, none):
    field = C.Field(np.zeros((2, C.FEATURES)), np.zeros((2, 2)), np.array([0.0, 1.0]))
    got = Counter(tuple(r)[:7] for r in C.judge_lines(hard, field).collect())
    word, want = re.compile(r"[^\x20\x09-\x0D]+"), Counter()
    for doc, text in hard_texts:
        w = word.findall(text or "")
        grams, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i:i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if word.search(x)]
        want[doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
             len(w) < 50 or 2 * len(covered) > len(w)] += 1
    assert got == want
    assert C.judge_lines(none, field).collect() == []


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    field = C.Field(rng.normal(size=(2, C.FEATURES)), rng.normal(size=(2, 2)) * 2, rng.normal(size=2))
    rows = np.repeat([0, 2, 5], [1, 7, 4])
    bits = rng.integers(0, 1 << C.FEATURES, len(rows)).astype(np.uint32)
    score = C._vectors(bits) @ field.unary.T
    got = C.decode(field, rows, bits)
    for r in (0, 2, 5):
        at = np.flatnonzero(rows == r)
        best = max(itertools.product((0, 1), repeat=len(at)), key=lambda y: field.begin[y[0]] + sum(score[i, l] for i, l in zip(at, y))
                   + sum(field.move[a, b] for a, b in zip(y, y[1:])))
        assert got[at].astype(int).tolist() == list(best)


def test_training_reads_any_part_of_a_text():
    bits, seen = np.arange(5000, dtype=np.uint32), set()
    for doc in range(300):
        lines = C._some_lines(bits, doc)
        assert len(lines) == C.SAMPLE_LINES and (np.diff(lines) == 1).all()
        seen.add(int(lines[0]) // 500)
    assert len(seen) >= 9 and len(C._some_lines(bits[:3], 1)) == 3


def test_training_separates_and_gradient_is_right():
    rng = np.random.default_rng(6)
    rows = np.repeat(np.arange(60), 5)
    labels = rng.random(300) < 0.5
    bits = (1 + (labels * 2).astype(np.uint32)).astype(np.uint32)
    field = C.train(rows, bits, labels)
    assert (C.decode(field, rows, bits) == labels).all()
    assert not C.train(rows[:0], bits[:0], labels[:0]).unary.any()


def test_held_out_quality(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    learn, test = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    judged = C.judge_lines(docs, C.fit(docs, learn)).join(test, "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert all(good) and sum(bad) <= 0.2 * len(bad)


# --- language -----------------------------------------------------------------------------


def test_language(spark, tables, hard, hard_texts, none):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = L.fit(docs.where(~L.held_out()))
    told = L.identify(docs, model).join(docs.where(L.held_out()).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.97 * len(told)
    rows = L.identify(hard, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in hard_texts)
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (4, 5, 6, 20):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert L.identify(none, model).collect() == []
    empty = L.fit(docs.where("false"))
    assert {r["lang_pred"] for r in L.identify(hard, empty).collect()} == {"und"}


def test_unseen_words_fall_back():
    model = L.Model(["x", "y"], {0: np.zeros(0, np.uint64), **{n: np.zeros(0, np.uint64) for n in L.KEPT_GRAMS}},
                    {k: np.zeros((0, 2)) for k in (0, *L.KEPT_GRAMS)})
    gram = L._gram_hash(np.array([ord("b"), ord("c")], np.uint32), 2)
    model.keys[2], model.scores[2] = gram, np.array([[-1.0, -3.0]])
    langs, scores = L.score_texts(["abcd", "zzz"], model)
    assert langs == ["x", "x"] and abs(scores[0] - 1 / (1 + np.exp(-2))) < 1e-12 and scores[1] == 0.5


def plain_scores(text, model):
    """Word by word, by definition: {language: sum}, and the number of words."""
    total, count = [0.0] * len(model.languages), 0
    for word in ("".join(c if c.isalpha() else " " for c in text.lower())).split():
        count += 1
        codes = np.array([ord(c) for c in f" {word} "], np.uint32)
        entries = {k: {int(h): v for h, v in zip(model.keys[k].tolist(), model.scores[k])} for k in model.keys}
        own = int(L._word_hash(codes, np.array([1]), np.array([len(codes) - 1]))[0])
        found = [entries[0][own]] if own in entries[0] else []
        for n in sorted(L.KEPT_GRAMS, reverse=True):
            if not found:
                found = [entries[n][int(h)] for h in L._gram_hash(codes, n) if int(h) in entries[n]]
        if found:
            total = [t + v for t, v in zip(total, np.mean(found, axis=0))]
    return total, count


def test_scores_are_those_of_the_definition(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = L.fit(docs.where("doc_id < 40"), sample_rows=5)
    model = L.Model(model.languages, {k: v[::7] for k, v in model.keys.items()}, {k: v[::7] for k, v in model.scores.items()})
    texts = [r["text"][:300] for r in docs.where("doc_id between 50 and 70 and text is not null").collect()] + ["zzz qq", "12 34", "Ünïted états"]
    langs, scores = L.score_texts(texts, model)
    for text, lang, score in zip(texts, langs, scores):
        total, count = plain_scores(text, model)
        if not count:
            assert (lang, score) == (L.UNDECIDED, 0.0)
            continue
        total = np.array(total)
        assert total[model.languages.index(lang)] >= total.max() - 1e-9
        z = total * min(1, L.EVIDENCE / count)
        assert abs(score - 1 / np.exp(z - z.max()).sum()) < 1e-9


def test_rare_language_is_learned(spark):
    """Five documents of 50,000: one in ten thousand."""
    rng = np.random.default_rng(1)
    common = ["the", "and", "of", "house", "tree", "water", "over", "under"]
    rare = ["ja", "ei", "talo", "puu", "vesi", "yli", "alla", "kissa"]
    rows = [(i, " ".join(rng.choice(common, 8)), "en") for i in range(49_995)] + [(50_000 + i, " ".join(rng.choice(rare, 30)), "fi") for i in range(5)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert model.languages == ["en", "fi"]
    langs, scores = L.score_texts(["talo ja puu ei vesi", "the house and the tree", "the talo"], model)
    assert langs[:2] == ["fi", "en"] and (scores[:2] > 0.9).all() and scores[2] < scores[0]


# --- pages --------------------------------------------------------------------------------


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- c --><div class="cookie-notice">We use cookies</div>
    <div id=sidebar><p>Side <div>deep</div></p></div><article><h1>Head &amp; line</h1><p>First&nbsp;  para.<br>more<p>Second <b>bold</b> &lt;x&gt;
    <div class="ad">Buy</div><ul><li>one</li><li>two</li></ul><form><p>Name <input></p></form></article>
    <section class="comments"><p>Nice!</p></section><footer>&copy; all</footer></body></html>"""
    assert B.main_text(page) == "Head & line\n\nFirst para. more\n\nSecond bold <x>\n\none\n\ntwo"
    assert B.main_text("") == "" and B.main_text("<nav>only</nav>") == "" and B.main_text("plain text") == "plain text"
    assert B.main_text("<article><p>cut off &am") == "cut off &am"
    assert B.main_text("<p><a href=x>all link</a></p>") == ""
    long = "<p>" + "word " * 200_000
    assert len(B.main_text(long)) == 999_999


def test_main_text_without_telling_names():
    para = "A sentence of the article that is long enough to be a line of text on its own account. " * 2
    article = f"<div class=x1><h1>Title</h1><p>{para}<p>Short line.<p>{para}<ul><li>one<li>two</ul></div>"
    want = "\n\n".join(["Title", para.strip(), "Short line.", para.strip(), "one", "two"])
    before = '<div class="x7"><p>We use cookies</p></div><div class=x2>Buy our new shoes, <a href=b>here</a></div>'
    after = "<div class=x3><p>Great post!</p></div><div class=x4>&copy; 2024 Some Company. All rights reserved.</div>"
    assert B.main_text(f"<body>{before}{article}{after}</body>") == want
    inner = f"<article><p>{para}</p><div class=x7><p>We use cookies</p></div><p>End.</p></article>"
    assert B.main_text(inner) == f"{para.strip()}\n\nEnd."
    # On a page of short lines the threshold goes by the longest of them.
    assert B.main_text("<div><p>We use cookies</p></div><div><p>A short article of a few words only.</p></div>") == "A short article of a few words only."
    assert B.main_text(f"<div><p>{para}</p></div><div><p>{para}</p></div>") == f"{para.strip()}\n\n{para.strip()}"


@pytest.mark.parametrize("start, end", [
    ('<div class="layout has-sidebar">', "</div>"), ('<section class="post no-comments">', "</section>"), ("<form><fieldset>", "</fieldset></form>"),
    ('<div class="widget"><article>', "</article></div>"), ('<div id="banner"><main>', "</main></div>"), ('<p class="notice">x', ""),
    ('<ul><li class="promo">x', "</ul>"), ('<div class="ad">Buy', ""), ('<table><tr><td class="menu">x<td>', "</table>"),
])
def test_removed_parts_leave_the_article(start, end):
    para = "A sentence of the article that is long enough to be a line of text on its own account. " * 2
    tag = "<li>" if "<ul>" in start else "<p>"
    nav, foot = '<nav><a href="/a">Menu</a> of the site</nav>', '<div class="related">Teaser</div><footer>Imprint</footer>'
    page = f"<html><body>{nav}{start}{tag}{para}{tag}{para}{end}{foot}</body></html>"
    assert B.main_text(page) == f"{para.strip()}\n\n{para.strip()}"
    comment = f'<body><article><p>{para}</article><div class="comments"><article>Nice!</article></div></body>'
    assert B.main_text(comment) == para.strip()


LONG = "A sentence of the article that is long enough to be a line of text on its own account. " * 2


@pytest.mark.parametrize("page, want", [
    (f"<article><p title=it's>{LONG}</p><p>Next.</p></article>", [LONG.strip(), "Next."]),
    (f"<article><div><h1>Head</h1></div><div><p>{LONG}</p></div><div><p>One short closing line.</p></div></article>",
     ["Head", LONG.strip(), "One short closing line."]),
    (f"<body><div class=x><div><h1>Head</h1></div><div>{LONG}</div><div>Short.</div><div>{LONG}</div><div>End.</div></div><div>Shop now</div></body>",
     ["Head", LONG.strip(), "Short.", LONG.strip(), "End."]),
    (f"<article><p>{LONG}</p></article><div class='user-comments'><p>{LONG}</p></div>", [LONG.strip()]),
    (f"<div><p>We use cookies and similar technologies to give you the best experience on our website, to measure visits and to show you offers. Accept all "
     f"or change your settings.</p></div><article><p>{LONG}</p></article>", [LONG.strip()]),
    (f'<p title="a>b">{LONG}</p><p title=\'c">\'>{LONG}</p>', [LONG.strip()] * 2),
    (f'<p title="never closed>{LONG}</p><p>{LONG}</p>', [LONG.strip()] * 2),
])
def test_lines_of_the_article_stay(page, want):
    assert B.main_text(page) == "\n\n".join(want)


def test_surge_and_dive_by_definition():
    """The windows against sums made anew for every line."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        lines, run = [], 0
        for _ in range(int(rng.integers(1, 30))):
            run += int(rng.random() < 0.2)
            size = int(rng.choice([0, 5, 60, 130]))
            lines.append(B.Line("x" * max(1, size), float(size), bool(rng.random() < 0.1), (), run))
        sums = [sum(x.weight for x in lines[i:i + 3] if x.run == lines[i].run) for i in range(len(lines))]
        edge, want, on = min(120, 0.5 * max(sums)), [], False
        for i, line in enumerate(lines):
            on = on and lines[i - 1].run == line.run
            on = (on and sums[i] > 0) or (line.weight > 0 and (line.told or sums[i] > edge))
            want.append(on)
        assert B._surging(lines, 3, 120) == want


def test_pages(spark):
    rows = [(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (None, None, None, 2), (2, "v", "", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, B.extract_pages(df).collect()), key=repr)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert B.extract_pages(df.where("false")).collect() == []
