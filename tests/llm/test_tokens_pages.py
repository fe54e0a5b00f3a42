"""Piece encoding, id files, page text and the pipeline."""

import itertools
import json
import os
import random
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from sightline.llm import html_blocks, sentencepiece, vbyte  # noqa: E402
from sightline.llm.common import tokenizer_file  # noqa: E402

PIECES = tokenizer_file("piece_bpe_32k.model")
WORDS = tokenizer_file("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, start int"
TEXTS = [None, "", " ", "a", "Hello  world\n\ttest é", "▁ and ▁▁x", "  two  spaces  ", "日本語 🦜 text", "x" * 3000, "don't <|endoftext|> İ ǅ ﬁ",
         "tab\tline\r\nend", "é ̸≠", "a b c", "\x00\x1f", "many " * 500]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


# --- pieces ------------------------------------------------------------------

def best_score(model, unit):
    """Over all cuts of a short unit into pieces or single characters."""
    best = -np.inf
    for cuts in itertools.product((0, 1), repeat=len(unit) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(unit)]
        parts = [unit[a:b] for a, b in zip(at, at[1:])]
        if all(p in model.plain or len(p) == 1 for p in parts):
            best = max(best, sum(model.plain[p][1] if p in model.plain else model.fallback for p in parts))
    return best


def test_pieces_are_the_best_segmentation():
    model = sentencepiece.Pieces(PIECES)
    for unit in ["▁the", "▁thing", "▁onheat", "▁Verkeit", "▁\n", "▁é日x", "tionally", "▁▁▁", "▁á", "q"]:
        ids = model.unit(unit)
        score, i = 0.0, 0
        while i < len(ids):
            piece = model.pieces[ids[i]]
            if ids[i] in model.bytes:
                n = len(next(c for c in unit if c.encode()[0] == model.bytes.index(ids[i])).encode())
                score, i = score + model.fallback, i + n
            else:
                score, i = score + model.plain[piece][1], i + 1
        assert score == pytest.approx(best_score(model, unit))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_pieces_round_trip(text):
    model = sentencepiece.load(PIECES)
    assert model.decode(model.encode(text).tolist()) == text


def test_encode_and_decode(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, "x")]
    coded = sentencepiece.encode(frame(spark, rows), PIECES)
    told = {r.doc_id: r for r in sentencepiece.decode(coded, PIECES).collect()}
    ids = {r.doc_id: r.ids for r in coded.collect()}
    assert coded.count() == len(rows)
    for i, t in enumerate(TEXTS):
        assert told[i].text == (t or "") and told[i].n_tokens == len(ids[i])
        assert told[i].ids_crc32 == zlib.crc32(np.array(ids[i], "<u4").tobytes())
    assert sentencepiece.encode(frame(spark, []), PIECES).count() == 0


# --- id files ----------------------------------------------------------------

@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 300), max_size=60))
def test_pack_round_trip(values):
    control, data = vbyte.pack(np.array(values, np.uint32))
    assert vbyte.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, -(-v.bit_length() // 8)) for v in values)


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_id_files(spark, monkeypatch, block):
    from tokenizers import Tokenizer
    monkeypatch.setattr(vbyte, "BLOCK_VALUES", block)
    rows = [(i * 7 % 41, t) for i, t in enumerate(TEXTS)] + [(500, "last"), (None, "first")]
    random.Random(1).shuffle(rows)
    path = vbyte.fresh_path(spark)
    vbyte.write_ids(frame(spark, rows), path, WORDS)
    got = {r.doc_id: r for r in vbyte.read_ids(spark, path).collect()}
    assert len(got) == len(rows)
    library, start = Tokenizer.from_file(WORDS), 0
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32, bytes(got[d].ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)


def test_id_files_repeated_and_empty(spark):
    path = vbyte.fresh_path(spark)
    vbyte.write_ids(frame(spark, [(1, "a b"), (1, "a b"), (1, "c"), (0, None)]), path, WORDS)
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in vbyte.read_ids(spark, path).collect())
    assert [g[0] for g in got] == [0, 1, 1, 1] and got[0][1:] == (0, 1)
    ends = [s + n for _, s, n in got]
    assert sorted(s for _, s, _ in got) == [0, *sorted(ends)[:-1]]
    path = vbyte.fresh_path(spark)
    vbyte.write_ids(frame(spark, []), path, WORDS)
    assert vbyte.read_ids(spark, path).count() == 0


# --- pages -------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>x", "x"),
    ("<html><body><nav><a href=1>Home</a></nav><article><h1>T &amp; t</h1><p>One   two\n three</p><p>End.</p></article><footer>f</footer>",
     "T & t\nOne two three\nEnd."),
    ("<body><div class='menu'>m</div><div class=\"content\"><p>Body text of some length<div class='ad-slot'>Buy</div><p>More &copy it</div>"
     "<div id=comments><p>A reader comment that is much longer than all of the article's text, and then some more</div>",
     "Body text of some length\nMore © it"),
    ("<article><p>a &lt;b&gt; &#233;&#x41; &nbsp; z</p><script>var p = '</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>c</p></article>",
     "a <b> éA z\nc"),
    ("<main><p>First part here</p><aside>side</aside><form><input><label>Mail</label></form><p>Second part here</p></main>"
     "<div class='cookie-notice'>We use cookies, many of them, so here is a very long notice text about cookies</div>",
     "First part here\nSecond part here"),
    ("<header><h1>Site</h1></header><div><p>A paragraph with enough words to be running text.</p><p>Tail.</p></div><div role='navigation'>x y z</div>",
     "A paragraph with enough words to be running text.\nTail."),
    ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><blockquote>q</blockquote></article>", "one\ntwo\na b\nc\nq"),
    ("<article><p><b>Unclosed<br><p>Next</b></p></article>", "Unclosed\nNext"),
    ("<nav>only a menu</nav><footer>foot</footer>", ""),
    ("<article><p title='hidden class=ad' style=\"overflow: hidden\">Seen</p><p hidden>not seen</p></article>", "Seen"),
    ("<article>" + "<p>word</p>" * 5000 + "</article>", "\n".join(["word"] * 5000)),
]


def test_page_text(spark):
    rows = [(i, f"u{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(4, None, PAGES[4][0], "x")]
    out = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = {r.page_id: r for r in out.collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert out.count() == len(rows)
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_text_keeps_all_of_the_article():
    long = "A sentence of the article that is long enough to weigh. " * 20
    a, b = long.strip(), "The second half is lighter, and as much a part of the article."
    for page, want in [
            (f"<article><h1>Title</h1><div class='entry-content'><p>{a}</p></div><p>tail</p></article>", f"Title\n{a}\ntail"),
            (f"<article><div class='content'>{a}</div><div class='ad'>x</div><div class='content'>{b}</div></article>", f"{a}\n{b}"),
            (f"<body><p>{a}</p><div class='ad'>x</div><p>tail</p></body>", f"{a}\ntail"),
            (f"<body><h1>Title</h1><div class='post'><p>{a}</p></div><p>tail</p></body>", f"Title\n{a}\ntail"),
            (f"<article><p>{a}</p></article><article><p>{b}</p></article>", f"{a}\n{b}"),
            (f"<article>teaser</article><div><p>{a}</p></div>", f"teaser\n{a}"),
            ("<div>" * 3000 + f"<p>{a}</p>", a)]:
        assert html_blocks.main_text(page) == want


def test_page_text_weighs_text_outside_links():
    a = ("A sentence of the article that is long enough to weigh. " * 20).strip()
    links = [f"<a href='/{w}'>{w}</a>" for w in ("Home", "World news", "Sport", "Contact us")]
    for page, want in [
            ("<body><div class='top'>" + "<br>".join(links) + f"</div><div id='text'><h1>Title</h1><p>{a}</p></div></body>", f"Title\n{a}"),
            ("<body><div class='top'>" + " | ".join(links) + f"</div><div id='text'>{a}</div><div>{' '.join(links)}</div><div>(c) us</div>", a),
            ("<table><tr>" + "".join(f"<td>{x}" for x in links) + f"</table><div id='text'><p>{a}</p></div>", a),
            ("<table><tr><td>" + " ".join(links) + f"<td>{a}</table>", a),
            ("".join(f"<p>{x}</p>" for x in links), ""),
            (f"<article><h1><a href='/'>Title</a></h1><p>{a} {links[0]}</p><p>{links[1]}</p></article>", f"Title\n{a} Home\nWorld news"),
            (f"<article><section id='discussion'><p>{a}</p></section><section id='related-work'><h2 id='search'>Old work</h2>"
             "<p class='form'>Short.</p></section><div class='share'>Tell all</div></article>", f"{a}\nOld work\nShort."),
            (f"<body><section id='discussion'><h2 class='side'>Talk</h2><p>{a}</p></section><div class='related'>More</div></body>", f"Talk\n{a}")]:
        assert html_blocks.main_text(page) == want


def test_page_text_reads_attributes_and_comments_as_browsers_do():
    for page, want in [
            ("<p title=Bob's>Hello world one.</p><p>It's fine and long.</p><p>Last.</p>", "Hello world one.\nIt's fine and long.\nLast."),
            ("<p title='a > b' class=\"x>y\">One</p><p data-x=a'b\"c>Two</p>", "One\nTwo"),
            ("<p>One</p><!--><p>Two</p><!---><p>Three</p><!-- <p>no</p> -->", "One\nTwo\nThree"),
            ("<script type='a>b'>no</script><p class=>One</p>", "One"),
            ("<p " + "a='b' " * 2000 + "c='", ""),
            ("<p>" + "x" * 300_000 + "</p>", "x" * 300_000),
            ("<article class=hidden-sm class='ad'><p>One</p></article>", "One")]:
        assert html_blocks.main_text(page) == want


def test_page_text_inside_wrappers_that_look_like_boilerplate():
    a = ("A sentence of the article that is long enough to weigh. " * 20).strip()
    menu, foot = "<nav><a href=/>Home</a></nav>", "<footer>(c) us, all rights reserved</footer>"
    for page, want in [
            (f"<form action=x>{menu}<h1>T</h1><p>{a}</p>{foot}</form>", f"T\n{a}"),
            (f"<form>{menu}<div class='nav-open wrapper'><h1>T</h1><p>{a}</p><div class='comments'>{a}</div></div></form>", f"T\n{a}"),
            (f"<div class='sidebar-left'>{menu}<h1>T</h1><p>{a}</p></div>{foot}", f"T\n{a}"),
            (f"<div class='page has-sidebar'><article><h1>T</h1><p>{a}</p></article><div class='sidebar'>{a}</div></div>", f"T\n{a}"),
            (f"<div class='sidebar'>{a}{a}</div><article><p>Short.</p></article>", "Short."),
            (f"<div class='sidebar'><p>{a}</p></div><h1>T</h1><p>{a}</p>", f"T\n{a}"),
            (f"<section><header><h1>Title</h1></header><p>{a}</p></section>", f"Title\n{a}"),
            (f"<header><h1>Site name</h1></header><p>{a}</p>", a),
            (f"<div class='comments'><article><p>{a}</p></article></div><p>Own text of the page.</p>", "Own text of the page."),
            (f"<form><label>Your name</label><input></form><p>{a}</p>", a)]:
        assert html_blocks.main_text(page) == want


def test_page_text_edges():
    a = ("A sentence of the article that is long enough to weigh. " * 20).strip()
    links = "".join(f"<li><a href={i}>Source number {i}</a></li>" for i in range(3))
    for page, want in [
            (f"<article><p>{a}</p><h2>References</h2><ul>{links}</ul></article>", f"{a}\nReferences\nSource number 0\nSource number 1\nSource number 2"),
            (f"<div class='post'><p>{a}</p><ul>{links}</ul></div>", f"{a}\nSource number 0\nSource number 1\nSource number 2"),
            (f"<ul>{links}</ul><div id='text'><p>{a}</p></div><ul>{links}</ul>", a),
            (f"<div>Sign in to continue reading our site</div><div><h1>T</h1><p>{a}</p></div><div>All rights reserved, 2020</div>", f"T\n{a}"),
            (f"<div>Sign in to continue reading our site</div><div>{a}</div><div>All rights reserved, 2020</div>", a),
            (f"<h1>T</h1><div>{a}</div><p>The end.</p>", f"T\n{a}\nThe end."),
            (f"<h1>T</h1>By a writer<p>{a}</p>{a}", f"T\nBy a writer\n{a}\n{a}")]:
        assert html_blocks.main_text(page) == want


def test_sections_are_runs_of_weight():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.choice([0, 0, 0, 5]) for _ in range(rng.randint(0, 30))]
        found = html_blocks.sections(w)
        inside = {i for a, b in found for i in range(a, b)}
        assert all(i in inside for i, x in enumerate(w) if x)
        assert all(not any(w[i:i + html_blocks.WIDTH]) for i in range(len(w)) if i not in inside)


# --- pipeline ----------------------------------------------------------------

def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(12)
    v = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(v) + ("." if i % 9 == 8 else "") for i in range(n))
    docs = [prose(rng.randint(60, 200)) for _ in range(60)]
    docs += [docs[0], docs[1], docs[1], docs[2].replace(" ", " extra ", 1), docs[3] + " tail", None, "", "short text", "A!! B!! " * 60,
             "x### y*** " * 50, "same " * 80]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0 if t is None else len(t)) for i, t in enumerate(docs)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "encode_pieces"]
    at = spark.read.parquet(path + "/documents.parquet")
    cols, texts = at.columns, dict(enumerate(docs))

    def step(name, df):
        out = stages[name](spark, df, path)
        out.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")
    at = step("quality_rules", at)
    ids = sorted(r.doc_id for r in at.collect())
    assert at.columns == cols and ids == [i for i in range(65)]  # all prose, no junk
    at = step("exact_dedup", at)
    last = {}
    for i in ids:
        last[texts[i]] = i
    assert at.columns == cols and sorted(r.doc_id for r in at.collect()) == sorted(last.values())
    before = [(r.doc_id, r.text) for r in at.collect()]
    at = step("near_dedup", at)
    root = brute.components(before, 5)
    ids = sorted(d for d, c in root.items() if d == c)
    assert at.columns == cols and sorted(r.doc_id for r in at.collect()) == ids and len(ids) < len(before)
    source = {r[0]: r[3] for r in rows}
    at = step("mix_sources", at)
    mixed = [r.doc_id for r in at.collect()]
    sizes, taken = {}, {}
    for d in ids:
        sizes[source[d]] = sizes.get(source[d], 0) + len(brute.words(texts[d]))
    for d in mixed:
        taken[source[d]] = taken.get(source[d], 0) + len(brute.words(texts[d]))
    want = brute.targets(sizes)
    assert at.columns == cols and set(mixed) <= set(ids) and max(map(mixed.count, ids)) <= 2
    assert all(abs(taken[s] - want[s]) <= 100 for s in sizes)
    out = step("encode_pieces", at)
    model = sentencepiece.load(PIECES)
    assert sorted((r.doc_id, model.decode(r.ids)) for r in out.collect()) == sorted((d, texts[d]) for d in mixed)
    assert corpus_pipeline.run(spark, path).count() == len(mixed)


def test_registration(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_id_files_of_repeated_rows_over_many_blocks(spark, monkeypatch, block):
    """Repeated and null ids, equal texts that fill a block each: every row once, each where the one before it ends."""
    from tokenizers import Tokenizer
    monkeypatch.setattr(vbyte, "BLOCK_VALUES", block)
    long, library = "the same words again and again " * 200, Tokenizer.from_file(WORDS)
    rows = [(1, long)] * 5 + [(None, long)] * 4 + [(1, "short"), (2, None), (2, None), (3, long), (4, "x")]
    path = vbyte.fresh_path(spark)
    vbyte.write_ids(frame(spark, rows).repartition(3), path, WORDS)
    got = sorted(vbyte.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([d for d, _ in rows], key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        at += r.n_tokens
    want = sorted(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in got) == want
    if block < 1 << 20:
        assert spark.read.parquet(path + "/blocks").count() > 9


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    """A file that keeps cases apart must not be encoded by lower-cased words."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers
    other = Tokenizer(models.WordLevel({"[x]": 0, "The": 1, "the": 2, "cat": 3, ".": 4, "cat.": 5}, unk_token="[x]"))
    other.pre_tokenizer, other.normalizer = pre_tokenizers.WhitespaceSplit(), normalizers.NFC()
    other.save(str(tmp_path / "other.json"))
    rows = [(0, "The cat. the cat ."), (1, None), (2, "THE")]
    path = vbyte.fresh_path(spark)
    vbyte.write_ids(frame(spark, rows), path, str(tmp_path / "other.json"))
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in vbyte.read_ids(spark, path).collect()}
    assert got == {0: [1, 5, 2, 3, 4, 1], 1: [1], 2: [0, 1]}
    assert not vbyte.wordwise(json.loads(other.to_str())) and vbyte.wordwise(json.loads(Tokenizer.from_file(WORDS).to_str()))
