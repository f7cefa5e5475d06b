import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.html_extract import Block, _Element, extract_main_text, led_in, main_text, text_stretches
from tessera.llm.packing import BestFit, UnitEncoder, cut, packed_sequences
from tessera.llm.token_counts import PrefixCounter, cut_at, prefix_tables, token_counts, truncated
from tessera.llm.warc import read_record, read_seek_table, round_trip, seek_table, write_archives

from .fixtures import documents, empty

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "   ", "<|startoftext|>a<|endoftext|>b <|endoftext|>", "don't I'LL we've 'S it's  x", "a b　c d́e ́x", "ΣΑΣ ΟΔΟΣ İstanbul ǅ ß ẞ", "日本語テキスト 한국어 😀😃 👩‍👩‍👧",
    "\x00\x01\x1c a\x1fb", "x y", "１２３ ½ ²", "a" * 3000, "!!!???...---###$$$", "\n\n\nx\n y \t z  ", "<|startoftext", " " * 5000,
]


def odd_texts(n=1500):
    rng = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCéèüñ0123456789 .,'!?-\n\t  　日本語</>|"
    return ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(n)]


# --- token counts


def test_counts_equal_the_library():
    library, counter = Tokenizer.from_file(WORD), PrefixCounter(WORD)
    for text in odd_texts():
        assert counter.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_prefix_equals_the_library():
    """Also inside words, contractions, letters with marks, special strings, and texts without any white space."""
    library, counter = Tokenizer.from_file(WORD), PrefixCounter(WORD)
    tokens = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(3)
    texts = ["Theand thble reingwh, thorin's été 42x naïveté <|endoftext|>tail end", "a<|startoftext|><|endoftext|>it's<|endoftext", "日本語テキスト한국어" * 20, "q" + "e\u0301\u0323" * 30 + "x", "각나다", "!'re'll''s'", "İΣß" * 9]
    texts += ["".join(rng.choices("theandringso'sétlИ3!", k=120)) for _ in range(20)] + odd_texts(300)
    for text in texts:
        text = text[:400]
        table = counter.prefixes(text)
        assert table.tolist() == [tokens(text[:i]) for i in range(len(text) + 1)], repr(text)
        for budget in (0, 1, 7, 30):
            n = cut_at(table, budget)
            assert table[n] <= budget and all(c > budget for c in table[n + 1 :].tolist())
            assert counter.cut(text, budget) == (n, table[n])


def test_truncation_keeps_text_without_white_space(spark):
    docs = spark.createDataFrame([(1, "日本語テキスト" * 400), (2, None), (2, "ab cd"), (None, "a" * 5000)], "doc_id long, text string")
    library = Tokenizer.from_file(WORD)
    for r in truncated(docs, WORD, 100).collect():
        assert len(library.encode(r["text"], add_special_tokens=False).ids) == r["n_tokens"] <= 100
        assert r["n_tokens"] >= 99 or r["text"] in ("", "ab cd")
    assert truncated(empty(spark), WORD, 5).count() == 0 and prefix_tables(empty(spark), WORD).count() == 0


def test_other_tokenizers_are_refused():
    for wrong, right in ((BYTE, PrefixCounter), (WORD, UnitEncoder)):
        with pytest.raises(ValueError):
            right(wrong)


def test_word_prefixes_equal_plain_merging():
    counter = PrefixCounter(WORD)
    rng = random.Random(7)

    def merge(parts):
        while len(parts) > 1:
            rank, at = min((counter.ranks.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    for _ in range(300):
        word = "".join(rng.choices("thenraiosz", k=rng.randint(1, 12)))
        inner, whole = counter.word_prefixes(word)
        for i in range(1, len(word) + 1):
            assert inner[i] == len(merge(list(word[:i]))) and whole[i] == len(merge([*word[: i - 1], word[i - 1] + "</w>"]))


def test_token_count_rows(spark):
    docs = documents(spark, 30)
    library = Tokenizer.from_file(WORD)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, WORD, 2048).collect())
    text = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    n = [len(library.encode(t, add_special_tokens=False).ids) for _, t in text]
    assert got == sorted((str(d), len(t.encode()), k, k > 2048) for (d, t), k in zip(text, n))
    short = sorted((str(r["doc_id"]), r["n_tokens"], r["kept_chars"], r["kept_tokens"]) for r in token_counts(docs, WORD, 50).collect())
    table = PrefixCounter(WORD).prefixes
    kept = [(c, t[c]) for c, t in ((cut_at(t, 50), t) for t in (table(t[:4000]) for _, t in text))]  # fifty tokens end before that
    assert short == sorted((str(d), k, *c) for (d, _), k, c in zip(text, n, kept))
    assert token_counts(empty(spark), WORD, 1).count() == 0
    tables = prefix_tables(docs.filter("doc_id < 5"), WORD).collect()
    text = {r["doc_id"]: r["text"] for r in docs.filter("doc_id < 5").collect()}
    assert all(len(r["counts"]) == len(text[r["doc_id"]]) + 1 and r["counts"][-1] == len(library.encode(text[r["doc_id"]], add_special_tokens=False).ids) for r in tables)


# --- packing


def test_ids_equal_the_library():
    library, units = Tokenizer.from_file(BYTE), UnitEncoder(BYTE)
    for text in [*odd_texts(), "é" * 5000, "ж" * 5000, "a" * 4095 + "é", "日本" * 3000]:
        assert units.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_ids_on_both_sides_of_the_long_units_and_the_settled_letters():
    """The two encoders give the same ids at the length and the letter where one takes over from the other."""
    library, units = Tokenizer.from_file(BYTE), UnitEncoder(BYTE)
    for n in (4095, 4096, 4097):
        for text in ("ab" * (n // 2) + "c" * (n % 2), "-" * n, "1" * n, " " * n + "x", "x " + "é" * (n - 1), "abc " + "theand" * (n // 6) + "q" * (n % 6)):
            assert units.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), (n, text[:9])
    for letter in ("\u024e", "\u024f", "\u0250", "\u0251"):
        for text in (letter, f"a{letter}b", f"{letter * 3} x{letter}", f" {letter}'s", f"1{letter}1"):
            assert units.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_plain_texts_are_encoded_whole():
    """Texts without odd letters and long runs leave the table of units empty; runs of any length and place give the library's ids."""
    library, units = Tokenizer.from_file(BYTE), UnitEncoder(BYTE)
    for n in (0, 1, 2047, 2048, 4094, 4095, 4096, 6143):
        for text in ("x y " * n, "b " + "é" * n + "\r\n", " " * n + "'ll", "a\tb " * 700 + "!1" * (n // 2), "w" + "\n " * (n // 2)):
            units._units.clear()
            assert units.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), (n, text[:9])
            if n < 2048 or text[:1] == "x":
                assert not units._units, (n, text[:9])


def test_cut_leaves_only_the_first_piece_short():
    for total in (1, 5, 10, 11, 20, 35):
        pieces = cut(total, 10)
        assert sum(n for _, n in pieces) == total and all(n == 10 for _, n in pieces[1:])
        assert [s for s, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces)])[:-1])


def test_best_fit_like_a_plain_search():
    rng = random.Random(2)
    fast, open_, made = BestFit(50, 6), [], 0
    for _ in range(3000):
        n = rng.randint(1, 50)
        bin_, offset = fast.put(n)
        fits = [f for f, _ in open_ if f >= n]
        if fits:
            tightest = min(fits)
            assert 50 - offset == tightest
            at = next(i for i, (f, b) in enumerate(open_) if f == tightest and b == bin_)
            open_.pop(at)
            left = tightest - n
        else:
            assert (bin_, offset) == (made, 0)
            made += 1
            left = 50 - n
        if left:
            if len(open_) >= 6:
                fullest = min(f for f, _ in open_)
                closed = {b for f, b in open_ if f == fullest} - {b for own in fast.bins.values() for b in own}
                open_ = [(f, b) for f, b in open_ if b not in closed]
            open_.append((left, bin_))
        assert len(open_) <= 6


def test_packed_sequences_hold_every_id(spark):
    docs = documents(spark, 60)
    rows = packed_sequences(docs, BYTE, 256, 2, group=40).collect()
    library = Tokenizer.from_file(BYTE)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.setdefault(r["doc_id"], []).append(ids)
    for doc, versions in want.items():
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        for ids in versions[:1] if len(versions) == 1 else []:
            assert [r["start"] for r in own] == [s for s, _ in cut(len(ids), 256)]
            for r in own:
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
        assert sum(r["length"] for r in own) == sum(map(len, versions))
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= 256
    total = sum(r["length"] for r in rows)
    assert len(places) <= 1.25 * total / 256 + 2
    assert packed_sequences(empty(spark), BYTE).count() == 0


# --- archives


def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i}</p>", "d", 1) for i in range(20)]
    rows += [(100 + i, "http://y/ö \r\n", "<p>same ünï</p>", "d", 1) for i in range(30)]
    rows += [(200, None, None, None, None), (201, "http://e", "", "", 0), (None, "http://n", "<p>same ünï</p>", "d", 1), (202, "u", "z" * 400_000, "d", 1), rows[0], (300, "a", "<p>page 1</p>", "d", 1), (300, "b", "<p>page 2</p>", "d", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, response long")


def test_round_trip(spark):
    table = pages(spark)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in table.collect()]
    top = {}
    for page, payload in rows:
        top[payload] = max(top.get(payload, -1), -1 if page is None else page)
    got = round_trip(table).collect()
    assert sorted((str(r["page_id"]), r["payload_digest"], r["payload_bytes"]) for r in got) == sorted((str(p), base64.b32encode(hashlib.sha1(b).digest()).decode(), len(b)) for p, b in rows)
    by_digest = {base64.b32encode(hashlib.sha1(b).digest()).decode(): t for b, t in top.items()}
    for digest, page in by_digest.items():
        own = [r for r in got if r["payload_digest"] == digest]
        assert [r["page_id"] for r in own if r["record_type"] == "response"] == [page]
        assert all(r["refers_to"] == page for r in own if r["record_type"] == "revisit")
    assert round_trip(empty(spark, "page_id long, url string, html string")).count() == 0
    assert {r["record_type"] for r in round_trip(table, least=1_000_000).collect()} == {"response"}


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_repeated_pages_have_one_response(spark, threshold):
    """Rows that repeat id and payload, in several partitions, whatever join brings the groups to them."""
    rows = [(7, "u", "<p>x"), (3, "u", "<p>x")] * 4 + [(None, "u", "<p>x"), (9, None, None), (9, "v", None), (9, "v", "<p>y"), (8, "v", "<p>y" * 50_000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    assert found == {(7, 4, "response", None): 1, (7, 4, "revisit", 7): 3, (3, 4, "revisit", 7): 4, (None, 4, "revisit", 7): 1, (9, 0, "response", None): 1, (9, 0, "revisit", 9): 1, (9, 4, "response", None): 1, (8, 200_000, "response", None): 1}


def test_one_record_is_read_by_its_index_entry(spark, tmp_path):
    index = write_archives(pages(spark), f"file:{tmp_path}/archives").collect()
    assert len({r["record_id"] for r in index}) == len(index)
    for r in index:
        if r["record_type"] == "response" and r["page_id"] is not None and r["page_id"] < 20:
            headers, block = read_record(r["archive"], r["frame_offset"], r["frame_size"], r["record_offset"], r["record_size"])
            assert headers["WARC-Record-ID"] == r["record_id"] and block.endswith(f"<p>page {r['page_id']}</p>".encode())


def test_seek_table_and_any_zstd_reader(spark, tmp_path):
    import io

    import zstandard

    frames = [(10, 20), (7, 5)]
    assert read_seek_table(b"x" * 17 + seek_table(frames)) == frames
    index = write_archives(pages(spark), f"file:{tmp_path}/a").collect()
    for uri in {r["archive"] for r in index}:
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(uri.removeprefix("file:"), "rb").read()), read_across_frames=True).read()
        assert raw.count(b"WARC/1.1\r\n") == sum(r["archive"] == uri for r in index)


# --- pages

LONG = "This paragraph is long enough to be taken for the text of an article, with several words more than a menu has. "
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a><p>A slogan for every page of the site</p></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie-banner">We use cookies to make this site better for you and for all of our many partners.</div>
{main}
<aside><h3>Read on</h3><p>{long}</p></aside><section id="comments"><article class="comment"><p>{long}I like it.</p></article></section>
<form><label>Mail</label><input name="m"><button>Send</button></form><div class="ad-slot">Buy one, get one, {long}</div><footer>&copy; us &middot; {long}</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>{long}</p><p>Short.<p>With <b>bold</b>,\n <i>unclosed and&nbsp;more <ul><li>one<li>two</ul><p>{long}</p><p>End.</p>"
WANT = "Head & line {long} Short. With bold, unclosed and more one two {long} End."


@pytest.mark.parametrize("main", ["<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>", '<div class="page-with-sidebar"><article>{}</article></div>', '<div id="content">{}</div>', "<article><header>{}</header></article>"])
def test_article_alone_is_kept(main):
    page = PAGE.format(main=main.format(BODY.format(long=LONG)), long=LONG)
    assert main_text(page) == WANT.format(long=LONG.strip())


def test_parts_of_an_article_in_several_holders_stay():
    first, second = f"<div class=entry-content><p>{LONG * 6}</p></div>", f"<div class=entry-content><p>{LONG * 4}</p></div>"
    want = f"{(LONG * 6).strip()} {(LONG * 4).strip()}"
    for page in (f"<div class=story>{first}{second}</div>", f"<div>{first}{second}</div>", f"<main>{first}<p>{LONG}</p></main>"):
        assert main_text(page) == (want if second in page else f"{(LONG * 6).strip()} {LONG.strip()}")


def test_pages_without_marks_keep_what_stands_between_surge_and_dive():
    page = f"<body><div><a href=x>Home</a> <a href=y>About us</a></div><div>{LONG}</div><div>{LONG}</div><div><a href=z>Next page</a></div></body>"
    assert main_text(page) == f"{LONG.strip()} {LONG.strip()}"
    assert text_stretches([0, 0, 0, 200, 150, 0, 0, 0, 0, 0, 300, 0]) == [(3, 5), (10, 11)]
    assert text_stretches([]) == [] and text_stretches([0, 0]) == []


def test_names_in_doubt_lose_no_article_text():
    lines = ['<p class="follow-up">One more word.</p>', '<h2 class="section-header">A head line</h2>', '<section id="reviews"><p>What they say.</p></section>', '<div class="legal-analysis">A law.</div>', "<address>12 Some Road</address>"]
    said = ["One more word.", "A head line", "What they say.", "A law.", "12 Some Road"]
    for line, text in zip(lines, said):
        assert main_text(f"<body><nav>Menu</nav><article><p>{LONG}</p>{line}<p>{LONG}</p></article><footer>{LONG}</footer></body>") == f"{LONG.strip()} {text} {LONG.strip()}"
    for line in ('<div class="comment-list">', '<div id="cookie-banner">', '<p class="ad">', '<div class="share-buttons">', '<ul class="related-links">', '<div class="site-footer">'):
        assert main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div>{line}{LONG}{LONG}</body>") == f"{LONG.strip()} {LONG.strip()}", line


def test_short_text_between_long_text_stays():
    short = "".join(f"<p>Line {i}.</p>" for i in range(8))
    want = " ".join([LONG.strip(), *(f"Line {i}." for i in range(8)), LONG.strip()])
    for page in (f"<body><p>{LONG}</p>{short}<p>{LONG}</p></body>", f"<div><p>{LONG}</p><ul>{short.replace('p>', 'li>')}</ul><p>{LONG}</p></div>", f"<div><div><p>{LONG}</p></div><div>{short}</div><div><p>{LONG}</p></div></div>"):
        assert main_text(page) == want
    assert main_text(f"<div>{short}<p>{LONG}</p>{short}</div>") == " ".join([*(f"Line {i}." for i in range(8)), LONG.strip(), *(f"Line {i}." for i in range(8))])
    links = "".join(f'<p><a href="/{i}">Some link {i}</a></p>' for i in range(8))
    assert main_text(f"<body><p>{LONG}</p>{links}<p>{LONG}</p></body>") == f"{LONG.strip()} {LONG.strip()}"


def test_stretches_like_brute_force():
    """Every block belongs to a stretch exactly if a window over it sums to the surge, up to blocks without text at the ends."""
    rng = random.Random(12)
    for _ in range(500):
        lengths = [rng.choice([0, 0, 5, 30, 90, 200]) for _ in range(rng.randrange(1, 40))]
        sums = [sum(lengths[i : i + 3]) for i in range(len(lengths))]
        least = min(86, max(sums) / 2)
        inside = {i + j for i, n in enumerate(sums) if n >= least and n > 0 for j in range(3) if i + j < len(lengths)}
        found = text_stretches(lengths)
        assert {i for s, e in found for i in range(s, e)} <= inside
        assert {i for i in inside if lengths[i]} == {i for s, e in found for i in range(s, e) if lengths[i]}
        assert all(lengths[s] and lengths[e - 1] for s, e in found)


def test_no_article_is_lost_to_forms_and_names():
    text = LONG.strip()
    article = f"<article><p>{LONG}</p><p>{LONG}</p></article>"
    want = f"{text} {text}"
    assert main_text(f'<body><nav>Menu</nav><form id="aspnetForm">{article}<footer>{LONG}</footer></form></body>') == want
    assert main_text(f'<body><form id="aspnetForm"><div><p>{LONG}</p><p>{LONG}</p></div></form></body>') == want
    assert main_text(f"<body>{article}<form><label>Mail</label><p>Write to us.</p></form></body>") == want
    assert main_text(f"<body><article><p>{LONG}</p><form><p>Mail me new texts.</p></form><p>{LONG}</p></article></body>") == want
    for name in ("post promoted", "post sponsored", "entry featured promo"):
        assert main_text(f'<body><div class="{name}"><p>{LONG}</p><p>{LONG}</p></div><div class="box"><p>short</p></div></body>') == want, name
    for tag, name in (("div", "cookie-recipe"), ("p", "sponsor-history"), ("section", "comments-on-the-law"), ("div", "newsletter-of-1910")):
        assert main_text(f'<body><article><p>{LONG}</p><{tag} class="{name}" id="{name}">Told at length.</{tag}><p>{LONG}</p></article></body>') == f"{text} Told at length. {text}", name
    for name in ("comments", "comments-area", "post-comments", "article-sidebar", "cookie-consent-banner", "newsletter-signup-form", "sponsor-box", "post comment"):
        assert main_text(f'<body><article><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div><p>{LONG}</p></article></body>') == want, name


@pytest.mark.parametrize("before", ["", "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>", "<div>Buy this now.</div>", "<ul><li><a href=a>One</a></ul><div>Buy this. Now.</div><div>Only here.</div>"])
def test_bare_pages_begin_where_the_text_surges(before):
    """Without an article element, a main part or any name, the sums alone find the text."""
    body = BODY.format(long=LONG)
    assert main_text(f"<body>{before}<div>{body}</div></body>") == WANT.format(long=LONG.strip())
    assert main_text(f"<body>{before}<div><h1>A head</h1></div><div><p>{LONG}</p><p>{LONG}</p></div><ul><li><a href=x>Next</a></ul></body>") == f"A head {LONG.strip()} {LONG.strip()}"


def test_lead_in_like_brute_force():
    """A lead-in goes exactly if it is shorter than a surge, has no heading and lies outside the container with most text."""
    rng = random.Random(5)
    boxes = [_Element("div", None, 0) for _ in range(3)]
    for _ in range(500):
        blocks = [Block("x", rng.choice([0, 10, 60, 200]), rng.choice(boxes), False, rng.random() < 0.2) for _ in range(rng.randrange(1, 12))]
        ((start, end),) = led_in(blocks, [(0, len(blocks))])
        most = max(boxes, key=lambda b: (sum(x.length for x in blocks if x.box is b), -next((i for i, x in enumerate(blocks) if x.box is b), 99)))
        first = next(i for i, b in enumerate(blocks) if b.box is most or b.heading)
        assert end == len(blocks) and start == (first if sum(b.length for b in blocks[:first]) < 86 else 0)


def test_broken_pages():
    for page, text in {"": "", "  ": "", "a < b and c > d": "a < b and c > d", "<p>x": "x", "<script>var x": "", "<!-- x": "", "<article></article>": "", "x &lt;b&gt; &#233;&nbsp;y": "x <b> é y", "<p title='a>b'>t</p>": "t", "<a href='x>t</a>u": "t u".replace(" ", "")}.items():
        assert main_text(page) == text, page
    for page in ("<div>" * 50_000 + "x", "<b>" * 20_000 + "<div>x</div>" * 500, "<a " * 50_000, "</nav>" * 50_000, "<div class=ad>x</div>" * 5_000):
        main_text(page)


def test_page_rows(spark):
    rows = [(1, "u", PAGE.format(main=f"<article><p>{LONG}</p></article>", long=LONG), "old", 9, "h"), (2, None, None, "x", 1, "h"), (None, "v", "", None, None, None), (1, "u", "<p>again", "x", 1, "h")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, _html string")
    got = extract_main_text(table).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(page_id=p, url=u, text=t, n_chars=len(t)) for p, u, t in ((1, "u", LONG.strip()), (2, None, ""), (None, "v", ""), (1, "u", "again"))]))
    assert extract_main_text(empty(spark, "page_id long, url string, html string")).agg(F.count("*")).first()[0] == 0
