"""The training-text operators against brute force, with NULLs, empty and long texts, repeats and extra columns."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("skyfare.llm")

from skyfare.llm.bpe import Bpe, decode_documents, encode_documents
from skyfare.llm.decontaminate import find_benchmark
from skyfare.llm.html_text import extract_text, main_text
from skyfare.llm.neighbours import nearest
from skyfare.llm.pii import boost, find_personal_data, labelled, redact, thresholds
from skyfare.llm.quality import isotonic, score_quality
from skyfare.llm.stored import stored
from skyfare.llm.shingle_join import jaccard_components
from skyfare.llm.token_counts import count_tokens
from skyfare.llm.token_files import _folded, canonical_codes, code_lengths, read_tokens, write_tokens
from skyfare.llm.units import tokenizer, tokenizer_path
from skyfare.llm.url_filter import judge_urls
from skyfare.llm.words import slices
from skyfare.sources.scratch import scratch_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
BASE = " ".join(f"w{k}" for k in range(60))
TEXTS = [
    (0, BASE),
    (1, BASE.upper()),
    (2, BASE + " more"),
    (3, None),
    (4, ""),
    (5, "two words"),
    (5, "two words"),
    (None, "no id at all, mail a@b.example.org"),
    (6, "ΑΣ don't  stop\n<|endoftext|> é 中文😀 " * 300),
    (7, "x" * 20000),
]


def frame(spark, rows=TEXTS):
    """Documents with columns that clash with names the operators use themselves."""
    schema = "doc_id bigint, text string, row string, spans string, id string, n bigint"
    return spark.createDataFrame([(*r, "r", "s", "i", 1) for r in rows], schema)


def test_shingle_components(spark):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        n = min(5, len(words))
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()

    found = {r.doc_id: r for r in jaccard_components(frame(spark)).collect()}
    assert {k: r.component_id for k, r in found.items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, None: None}
    assert all(found[k].n_shingles == len(shingles(t)) for k, t in TEXTS)
    assert jaccard_components(frame(spark, [])).collect() == []


def test_benchmark_windows(spark):
    item = " ".join(f"w{k}" for k in range(20, 32))
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, "two words"), (3, None), (4, "")], "item_id int, text string")
    for most in (200_000, 5):  # in one pass and in several
        found = find_benchmark(frame(spark), benchmark, cleaned="kept", most_words=most).collect()
        by_id = {r.doc_id: r for r in found}
        assert len(found) == len(TEXTS)
        assert (by_id[0].n_words, by_id[0].n_hit, by_id[0]["items"]) == (60, 12, ["1"])
        assert (by_id[5].n_hit, by_id[5]["items"], by_id[5].kept) == (2, ["2"], "")
        assert by_id[3].kept is None and by_id[4].n_words == 0 and by_id[7].n_hit == 0
        assert by_id[2].kept == BASE.replace(item, "") + " more"
    assert {r.n_hit for r in find_benchmark(frame(spark), benchmark.limit(0)).collect()} == {0}


def test_benchmark_items_without_an_id(spark):
    item, last = (" ".join(f"w{k}" for k in range(a, a + 12)) for a in (20, 40))
    rows = [(None, item), (None, last), (1, last), (None, None), (None, "")]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
    for most in (200_000, 5):
        found = {r.doc_id: r for r in find_benchmark(frame(spark), benchmark, cleaned="kept", most_words=most).collect()}
        assert (found[0].n_hit, found[0]["items"]) == (24, ["1", None])
        assert found[0].kept == BASE.replace(item, "").replace(last, "")
        assert (found[5].n_hit, found[5]["items"]) == (0, [])


def test_byte_pair_round_trip(spark):
    path = tokenizer_path(BYTE)
    encoded = encode_documents(frame(spark), path, decoded=True)
    rows = encoded.collect()
    assert sorted((r.decoded for r in rows)) == sorted((t or "" for _, t in TEXTS))
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == tokenizer(path).encode(r.decoded, add_special_tokens=False).ids
    again = decode_documents(encoded, path).collect()
    assert sorted(r.decoded for r in again) == sorted(r.decoded for r in rows)
    assert Bpe(path).decode(np.array([255 - 188], "<u4").tobytes()) == tokenizer(path).decode([255 - 188])


def test_token_counts_reuse_the_cache(spark):
    path, cache = tokenizer_path(BYTE), scratch_path(spark, "counts")
    first = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(frame(spark), path, cache).collect()}
    for doc, text in TEXTS:
        n = len(tokenizer(path).encode(text or "", add_special_tokens=False).ids)
        assert (doc, len((text or "").encode()), n, n > 512) in first
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in TEXTS})
    assert count_tokens(frame(spark, [*TEXTS, (9, "new")]), path, cache).count() == len(TEXTS) + 1
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in TEXTS}) + 1


def test_token_files_round_trip(spark):
    path, folder = tokenizer_path(WORD), scratch_path(spark, "files")
    write_tokens(frame(spark), path, folder, end_id=2)
    rows = sorted(read_tokens(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for row, (doc, text) in zip(rows, order, strict=True):
        ids = tokenizer(path).encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens) == (doc, start, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        start += len(ids)
    empty = scratch_path(spark, "empty")
    write_tokens(frame(spark, []), path, empty, end_id=2)
    assert read_tokens(spark, empty).collect() == []


def test_code_lengths_are_limited_and_complete():
    counts = np.array([2**k for k in range(30)])
    lengths = code_lengths(counts, 8)
    assert lengths.max() <= 8 and sum(2.0 ** -lengths) == 1
    codes = [f"{c:0{n}b}" for c, n in zip(canonical_codes(lengths).tolist(), lengths.tolist(), strict=True)]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert code_lengths(np.array([5])).tolist() == [1]


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    vectors += [(100 + k, [1.0] * 8) for k in range(9)]  # ties
    odd = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (None, [1.0] * 8), (204, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in [*vectors, *odd, vectors[3]]], "vec_id long, embedding array<float>, rank int")
    found = nearest(df, df.where("vec_id in (3, 104, 200, 204)")).collect()
    x = {k: np.array(v, np.float32).astype(float) for k, v in vectors}
    for q in (3, 104):
        score = {k: v @ x[q] / np.sqrt((v @ v) * (x[q] @ x[q])) for k, v in x.items() if k != q}
        best = sorted(score, key=lambda k: (-round(score[k], 12), k))[:5]
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == best
    assert {r.query_id for r in found} == {3, 104}


def test_quality_separates_and_defines_odd_cases(spark):
    good = [(k, f"The {k}th text of a plain kind, with words and a point. " * 5) for k in range(120)]
    bad = [(1000 + k, f"BUY {k}!! NOW!! " * 30) for k in range(120)]
    docs = frame(spark, [*good, *bad, *TEXTS[3:5], TEXTS[7]])
    labels = spark.createDataFrame([(k, 1) for k, _ in good] + [(k, 0) for k, _ in bad] + [(0, None)], "doc_id long, quality int")
    rows = score_quality(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.predicted == (r.doc_id < 1000) for r in held if r.doc_id not in (3, 4))
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 243
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    steps, values = isotonic(np.arange(4.0), np.array([1.0, 0, 2, 2]), np.array([2.0, 2, 2, 2]))
    assert values.tolist() == [0.25, 1.0, 1.0][: len(values)] and np.all(np.diff(steps) > 0)


def test_personal_data(spark):
    text = "a@b.org, 1.2.3.4, 4111 1111 1111 1111, +1 (212) 555-0187; 300.1.1.1 and 1234567890123456"
    rows = [(1, text), (2, None), (3, ""), (4, "1 " * 5000), (4, "1 " * 5000), (None, "😀 x@y.zz")]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in find_personal_data(frame(spark, rows)).collect()}
    assert [k for k, _, _ in found[1]] == ["email", "ip", "card", "phone"]
    assert [text[a:b] for _, a, b in found[1]] == ["a@b.org", "1.2.3.4", "4111 1111 1111 1111", "+1 (212) 555-0187"]
    assert found[None] == [("email", 2, 8)] and found[2] == found[3] == found[4] == []
    clean = {r.doc_id: r for r in redact(frame(spark, rows)).collect()}
    assert clean[1].text.startswith("[EMAIL], [IP], [CARD], [PHONE]; 300.1.1.1") and clean[2].text is None
    assert clean[None].text == "😀 [EMAIL]" and clean[1].spans == "s"


def test_personal_data_in_forms_that_no_base_pattern_takes(spark):
    personal = (
        "2001:db8::7", "fe80::204:61ff:fe9d:f156", "call 2125550187", "(212)555-0187", "030/4471234", "0171 2345678", "call 555-0187",
        "01 23 45 67 89", "JOE.ROE AT EXAMPLE DOT COM", "joe(AT)example.com", "joe{at}example.com", "4222.2222.2222.2220", "joe [at] example [dot] org",
    )
    other = ("std::vector<int>", "see a::b", "on 2024-01-31", "in 1998-1999", "id 2125550187", "we met at noon.Then", "1 " * 40, "4222.2222.2222.2221")
    rows = [(k, f"Well, {text} it is") for k, text in enumerate(personal + other)]
    clean = {r.doc_id: r.text for r in redact(frame(spark, rows)).collect()}
    assert [k for k, text in enumerate(personal) if text.split()[-1] in clean[k] or not re.search(r"\[(EMAIL|IP|CARD|PHONE)\] it is$", clean[k])] == []
    assert [text for k, text in rows[len(personal) :] if clean[k] != text] == []
    examples = stored(labelled(spark), "labelled")
    fitted = thresholds(examples.where("held"), boost(examples.where("NOT held")))
    assert set(fitted) == {"email", "ip", "card", "phone"}


def test_urls(spark):
    urls = [
        ("http://A.Example.org/es/1?q", "example.org/es/", "block"),
        ("x://org/", "org/", "allow"),
        ("x://notorg/", None, None),
        ("x://a.com/de/#f", "com/de/", "block"),
        ("no scheme", None, None),
        (None, None, None),
        ("x://example.org", None, None),
    ]
    pages = spark.createDataFrame([(k, u, "h") for k, (u, _, _) in enumerate(urls)], "page_id int, url string, host string")
    for r in judge_urls(pages).collect():
        _, rule, verdict = urls[r.page_id]
        assert r.rule == rule and r.verdict in ([verdict] if verdict else ["allow", "block"])


def test_main_text():
    page = (
        "<title>t</title><nav><a href=x>menu</a></nav><div class='cookie-notice'>We use it for the best of all.</div>"
        "<article><h1>Head &amp; tail</h1><p>One  of the\nlines.<br>Two<p>Short.</p><aside>Aside.</aside>"
        "<div id=comments><p>I like it.</p></div></article><script>var a='<p>no</p>'</script><footer>End</footer>"
    )
    assert main_text(page) == "Head & tail\n\nOne of the lines. Two\n\nShort."
    assert main_text("") == "" and main_text("<nav><a>x</a></nav>") == ""
    assert main_text("<p>" + "The words of a long text are here. " * 3000 + "</p>").startswith("The words")


TEXT = "This is the text of the page, and it is long enough to be read as what the page has to say to us."
SIDE = "You can have all of this and more of it if you join us, as it is the best that there is for you."


@pytest.mark.parametrize("name", ["post tag-social", "hentry comments-open", "post category-cookies", "has-sidebar", "no-sidebar", "hidden-xs", "sidebar", "widget"])
def test_main_text_keeps_what_is_named_for_something_else(name):
    text = f"<h1 class='entry-header'>The head of it</h1><p>{TEXT}</p><p>{TEXT}</p>"
    kept = f"The head of it\n\n{TEXT}\n\n{TEXT}"
    side = f"<div class='sidebar'><p>{SIDE}</p></div>"
    assert main_text(f"<article class='{name}'>{text}</article>{side}") == kept
    assert main_text(f"<div id='{name}'><article>{text}</article></div>{side}") == kept
    assert main_text(f"<main><div class='{name}'>{text}</div>{side}</main>") == kept
    assert main_text(f"<div class='{name}'>{text}</div>{side}") == kept


@pytest.mark.parametrize("name", ["ad", "site-header", "site__nav", "cookie-banner", "share-buttons x", "comments", "newsletter-signup"])
def test_main_text_cuts_what_is_named_apart(name):
    side = f"<div class='{name}'><p>{SIDE}</p></div>"
    assert main_text(f"{side}<article><p>{TEXT}</p><p>{TEXT}</p>{side}</article>") == f"{TEXT}\n\n{TEXT}"
    replies = f"<section class='comments'><article class='comment'><p>{SIDE * 9}</p></article></section>"
    text = f"<p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p>"
    assert main_text(f"<main><article>{text}</article>{replies}</main>") == "\n\n".join([TEXT] * 3)


def test_main_text_by_rules_in_and_out_of_articles():
    nav = "<nav><a href=x>menu</a></nav>"
    links = "<p><a href=x>One of the other pages</a></p>"
    text = f"<h2>A head</h2><p>{TEXT}</p><p>Short.</p><p>{TEXT * 2}</p>"
    kept = f"A head\n\n{TEXT}\n\nShort.\n\n{TEXT * 2}"
    teasers = "".join(f"<article><a href={k}>Teaser {k} of it</a></article>" for k in range(3))
    assert main_text(f"{nav}<div>{text}</div>{teasers}") == kept
    # in the article a short line between links goes, its headline, byline and last line stay
    page = f"<article>{links}<h1>Title</h1>{links}<p>By me</p><p>{TEXT}</p>{links}<p>Join now</p>{links}<p>{TEXT}</p><p>End</p></article>"
    assert main_text(nav + page) == f"Title\n\nBy me\n\n{TEXT}\n\n{TEXT}\n\nEnd"
    # text beside the article is read by the same rules
    assert main_text(f"<div><p>{SIDE * 3}</p></div><article><p>{TEXT * 9}</p></article><p>Imprint</p>") == f"{SIDE * 3}\n\n{TEXT * 9}\n\nImprint"
    assert main_text(f"<div>{SIDE}</div><article><p>{TEXT * 9}</p></article>") == TEXT * 9


def test_main_text_of_other_languages_and_long_lists():
    nav = "<nav><a href=x>menu</a></nav>"
    finnish = "Tämä sivu kertoo meille jotakin hyvin pitkästi, jotta lukija ymmärtäisi asian kunnolla ja kokonaan. " * 3
    finnish = finnish.strip()
    chinese = "这是一个很长的句子，用来说明网页正文的提取不应该依赖空格和停用词表，因为中文没有空格。"
    for text in (finnish, chinese):
        assert main_text(f"{nav}<p>{text}</p><p>{text}</p><footer>x</footer>") == f"{text}\n\n{text}"
        assert main_text(f"{nav}<article><p>{text}</p></article>") == text
    table = " ".join(f"{k}:{k * k}" for k in range(99))
    assert main_text(f"{nav}<p>{TEXT}</p><pre>{table}</pre><p>{TEXT}</p>") == f"{TEXT}\n\n{table}\n\n{TEXT}"
    assert main_text(f"{nav}<pre>{table}</pre>{nav}") == table


def test_main_text_of_a_tiny_article():
    for side in (f"<div class='ad'>{SIDE}</div>", f"<div>{SIDE}</div>"):
        assert main_text(f"{side}<article><h1>Title</h1><p>One line.</p></article><footer>x</footer>") == "Title\n\nOne line."


def test_main_text_without_optional_end_tags():
    kept = f"{TEXT}\n\n{TEXT}"
    for head in ("<head><title>x</title>", "<title>x</title>", "<head><meta charset=x><script>var a='<body>'</script>", "<head><noscript><img src=x></noscript>"):
        for body in ("<body>", "<body><main>", ""):
            assert main_text(f"<!DOCTYPE html><html>{head}{body}<article><p>{TEXT}<p>{TEXT}") == kept
            assert main_text(f"<html>{head}{body}<p>{TEXT}<p>{TEXT}<footer>x") == kept
    assert main_text(f"<head><title>x</title>\n{TEXT}") == TEXT
    assert main_text(f"<html><head><title>x</title></head><body><ul><li>{TEXT}<li>{TEXT}</ul><table><tr><td>{TEXT}<tr><td>{TEXT}</table>") == f"{kept}\n\n{kept}"


def test_main_text_counts_links_with_an_address_only():
    assert main_text(f"<article><h2><a name=s1>Title</a></h2><p>{TEXT}</p></article>") == f"Title\n\n{TEXT}"
    assert main_text(f"<div><a name=top><p>{TEXT}</p><p>{TEXT}</p></div>") == f"{TEXT}\n\n{TEXT}"
    # an open link ends at the next one, and what it held goes on
    links = "<p><a href=x>One of the links that is as long as a block of the text of the page has to be<b><a href=y>two</a></b></p>"
    assert main_text(f"<div>{links}<a href=x>More<p>{TEXT}</p><a name=s></a><p>{TEXT}</p><p>{TEXT}</p></div>") == f"{TEXT}\n\n{TEXT}"


def test_any_markup_is_read():
    """No markup stops the reader, and the sections that no rule knows are comments."""
    rng = random.Random(11)
    parts = ["<![foo[ x ]]>", "<![>", "<!", "<![CDATA[x]]>", "<!DOCTYPE [", "<!--", "-->", "<?", "?>", "<p", "<a href='", '"', ">", "</", "&", "&#x", "&#99999999;", "text ", "<script>", "</script>", "<div>", "\x00", "]]>", "<!ELEMENT", "<![if x]>", "<p>"]
    for _ in range(10_000):
        main_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))))
    assert main_text(f"<article><p>{TEXT}</p><![foo[ x ]]><p>{TEXT}</p></article>").startswith(TEXT)


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", f"<article><p>{TEXT}</p></article>"), (3, "w", "<![>")]
    pages = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    found = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in extract_text(pages).collect())
    assert found == sorted([("1", "u", "", 0)] * 2 + [("2", "None", "", 0), ("None", "v", TEXT, len(TEXT)), ("3", "w", "", 0)])
    assert extract_text(pages.limit(0)).collect() == []


def test_case_is_folded_in_slices():
    texts = ["A", "ÄB<|C", "Dé E", None, "<|X", "F" * 9] * 5
    for first in range(6):
        batch = pa.record_batch({"text": pa.array(texts)}).slice(first, 11)
        want = [t if "<|" in t else t.encode().lower().decode() for t in (x or "" for x in texts[first : first + 11])]
        found = [t for _, data, offsets in slices(batch, "text", 20) for t in _folded(data, offsets).to_pylist()]
        assert found == want
