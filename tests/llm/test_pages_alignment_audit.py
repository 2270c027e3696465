"""Page text, token alignment and filter audit against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from labelscope.llm import alignment, filter_audit, html_text, oracle, queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the ", " ", "  ", "é", "日本", "\n", "0", "ing", "🙂", "</s>", "<|endoftext|>", "<0x0A>", " " * 18, "don't", "ﬁ", "\x00", "é"]


# --- pages --------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T &amp; t.</title><style>p{}</style><script>var t="</p><p>no.</p>";</script></head><body>
<header><h1>Site.</h1></header><nav><ul><li><a href="/x">Home</a></ul></nav><div class="cookie-notice">We use cookies, here.</div>
<div id="sidebar"><p>Side, text.</p></div><form><p>Write, us.</p></form><!-- <p>gone</p> -->
<article><header><h1>Head &ampline</h1></header><p><b>One,
 two. 5 < 6 &lt;b&gt;<br>three<p>A <a href="?a>b">link</a>.<ul><li>short<li>items</ul><div class="comments"><p>Nice, one.</p></div>
<aside>Also.</aside><p>L</p></article><footer>&copy; 2020, us.</footer></body></html>"""
TEXT = "Head &line\nOne, two. 5 < 6 <b> three\nA link.\nshort\nitems\nL"
PAGES = [
    (1, PAGE, TEXT), (2, None, ""), (3, "", ""), (4, "plain, words", "plain, words"), (5, "<p", ""), (5, PAGE[:PAGE.index("<p>A")], "Head &line\nOne, two. 5 < 6 <b> three"),
    (6, "<div class=ad>Buy, now.</div>", ""), (None, "<main><p>x</p><!-- open <p>y</p>", "x"), (7, "<article><p>a</p><script>b</p><p>c", "a"),
    (8, "<body><div><p>" + "Long text, with marks. " * 20 + "</p><h2>Sub</h2></div><ul>" + "<li><a>Link</a></li>" * 9 + "</ul>", ("Long text, with marks. " * 20).strip() + "\nSub"),
    (9, "<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000, "deep"), (10, "<article><p>" + "w, " * 200_000, " ".join(["w,"] * 200_000)),
    (11, "<a \"" * 100_000, ""), (12, "<article><p>x</P>y<svg><text>z</text></svg>", "x\ny"),
]


def test_page_text(spark):
    pages = spark.createDataFrame([(i, "u", h, "old", "x") for i, h, _ in PAGES], "page_id long, url string, html string, text string, N_chars string")
    got = html_text.extracted(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r.page_id, r.text, r.n_chars) for r in got.collect()) == Counter((i, t, len(t)) for i, _, t in PAGES)
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_given_pages(spark):
    """Every given page marks its article, whose blocks are one heading and paragraphs."""
    import html

    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.op11_html_text(spark, folder).collect():
        inside = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(p for p in parts if p)


# --- alignment ------------------------------------------------------------------
def brute_alignment(rows):
    """Columns of op12, pair by pair."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=PIECES)
    letters = alignment.byte_letters()
    spell_a = lambda i: bytes(letters[c] for c in library.id_to_token(i))
    spell_b = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc, text in rows:
        sides = []
        if text:
            sides = [[(i, spell(i)) for i in ids] for ids, spell in (
                (library.encode(" " + text, add_special_tokens=False).ids, spell_a), (sp.encode(text), spell_b))]
        if any(b"".join(x for _, x in s) != (" " + (text or "")).encode() for s in sides):
            sides = []
        if not sides:
            found.append((doc, [], [], [], []))
            continue
        ends = [list(itertools.accumulate(len(x) for _, x in s)) for s in sides]
        ids = [[i for i, _ in s] for s in sides]
        links = [(a, b) for a, e in zip(ids[0], ends[0]) for b, g in zip(ids[1], ends[1]) if e == g]
        counts.update(links)
        groups, last = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for i, e in zip(x, at) if last < e <= cut) for x, at in zip(ids, ends)))
            last = cut
        found.append((doc, *ids, groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter(
        (doc, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, a, b, groups, links in found)


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    made = ["".join(random.choice(PARTS) for _ in range(random.randint(1, 25))) for _ in range(150)]
    return [(1, None), (2, ""), (3, " "), (4, "▁"), (5, "a▁b"), (6, "one and one"), (6, "one and one"), (6, "other"), (None, "x"),
            *((k + 10, t) for k, t in enumerate(made)), (999, "word " * 300)]


def test_alignment(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_a int, row string").repartition(3)
    want = brute_alignment(texts)
    take = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert Counter(map(tuple, alignment.scored(docs, BYTES, PIECES).select(*take).collect())) == want
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)  # the shuffled join gives the same rows
    assert Counter(map(tuple, alignment.scored(docs, BYTES, PIECES).select(*take).collect())) == want
    assert alignment.scored(docs.limit(0), BYTES, PIECES).count() == 0


def test_overlaps(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").filter("doc_id > 6")
    got = {}
    for r in alignment.overlaps(docs, BYTES, PIECES).collect():
        got.setdefault(r.doc_id, set()).add((r.a_place, r.b_place, r.same_end))
    both = alignment.aligner(BYTES, PIECES)
    for doc, text in texts:
        if doc and doc > 6 and (ids := both.ids(text)):
            spans = [list(itertools.pairwise(itertools.accumulate((len(side.bytes[i]) for i in x), initial=0)))
                     for side, x in zip((both.a, both.b), ids)]
            assert got[doc] == {(i, j, a[1] == b[1]) for i, a in enumerate(spans[0]) for j, b in enumerate(spans[1])
                                if a[0] < b[1] and b[0] < a[1]}


def test_ranks_equal_the_library(texts):
    """tiktoken over the vocabulary file gives the library's ids, for whole vocabulary entries, odd and very long texts too."""
    side = alignment.ByteLevel(BYTES)
    assert side._fast is not None
    random.seed(6)
    entries = [x.decode("utf-8", "ignore") for x in random.sample(side.bytes, 3000)]
    joined = ["".join(random.choices(entries, k=4)) for _ in range(1500)]
    long = [" " * 200_000, "a" * 200_000, "\n \t" * 60_000, "." * 100_000, "7" * 100_000]
    for text in [*entries, *joined, *long, *(t for _, t in texts if t)]:
        assert side.encode(text).tolist() == side._library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_aligned(spark):
    docs = spark.createDataFrame([(1, "ab " * 200_000), (2, "x" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(docs, BYTES, PIECES, True).collect()}
    assert got[1].n_links == got[1].n_groups > 0 and sum(got[1].times) == got[1].n_links and got[2].n_groups > 0


def test_pair_bound():
    both = alignment.aligner(BYTES, PIECES)
    assert 0 < both.pair_bound() <= alignment.BROADCAST_PAIRS


# --- audit ------------------------------------------------------------------------
def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    bad = {i for i, _, t in labels if t == 1}
    rows = []
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs)}
        rows.append((lang or "", fails, doc in good, doc in bad))
    out = set()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley, steps = Counter(), []
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                at = [(f, g, b) for _, f, g, b in mine if not any(f[y] for y in order[:k])]
                removed = [(f, g, b) for f, g, b in at if f[x]]
                shapley[x] += len(removed)
                steps.append(("".join(order), k + 1, len(at) - len(removed), len(removed), sum(f[x] for _, f, _, _ in mine) - len(removed),
                              sum(g for _, g, _ in removed), sum(b for _, _, b in removed),
                              sum(f[x] and sum(f.values()) == 1 for _, f, _, _ in mine), x))
        out |= {(part, *s[:-1], shapley[s[-1]]) for s in steps}
    return out


AUDIT = ("part", "filter_order", "step", *filter_audit.MEASURES, "unique_fails", "shapley")


@pytest.fixture(scope="module")
def audited():
    random.seed(8)
    words = ["alpha", "beta", "Gamma", "DELTA", "x|y", "ünder", "#"] + [f"w{i}" for i in range(120)]
    docs = [(random.choice([None, *range(40)]), random.choice([None, "", "dup", " ".join(random.choices(words[:random.choice([2, 5, 127])], k=random.choice([3, 99, 100, 130])))]),
             random.choice([None, "", "en", "fr"])) for _ in range(160)]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1])) for i in [*range(0, 45, 2), 4, 4]]
    return docs, labels


def test_audit(spark, audited):
    docs, labels = audited
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, lang string, part string, mask int").repartition(5)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.document_audit(d, l, F.col("lang")).select(*AUDIT).collect()
    assert len(got) == 600 * 3 and set(map(tuple, got)) == brute_audit(docs, labels)
    assert filter_audit.document_audit(d.limit(0), l, F.col("lang")).count() == 0
    one = filter_audit.document_audit(spark.createDataFrame([(1, "A" * 2_000_000 + " b" * 500_000)], "doc_id long, text string"), l.limit(0), F.lit(None))
    assert {r.part for r in one.collect()} == {""}


def test_audit_equals_its_sql(spark, audited):
    docs, labels = audited
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [d for d in docs if d[0] is not None])
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    got = con.execute(f"select {', '.join(AUDIT)} from ({oracle.FILTER_AUDIT})").fetchall()
    assert set(got) == brute_audit([d for d in docs if d[0] is not None], labels)


def test_fields_do_not_overflow():
    """Sums of billions stay in their fields."""
    total = 3_000_000_000_000 * filter_audit.packed(31, True, True, 5) + 7 * filter_audit.packed(0, False, False, 5)
    for order, step, kept, removed, redundant, good, toxic, unique, shapley in filter_audit.unpacked(total, "ABCDE"):
        first = 3_000_000_000_000 * (step == 1)
        assert (kept, removed, good, toxic, unique) == (7, first, first, first, 0)
        assert redundant == 3_000_000_000_000 - first and shapley == 24 * 3_000_000_000_000


# --- registered queries -----------------------------------------------------------
def test_registered_token_counts(spark, texts, tmp_path):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    rows = [*texts, (2000, "many words " * 2100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_token_counts(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "bigint", "boolean", "bigint"]
    want = Counter()
    for i, t in rows:
        n = len(sp.encode(t or ""))
        near = [k for k in range(len(t) - 1500, len(t), 1) if len(sp.encode(t[:k])) <= 4096] if n > 4096 else [len(t or "")]
        fit = near[-1]
        want[i, len((t or "").encode()), n, n > 4096, fit] += 1
    assert Counter(map(tuple, got.collect())) == want
