import gzip
import hashlib
import random
import time

import pytest

from pulseframe.llm import extract, warc
from pulseframe.session import work_path

BIG = "<p>" + "ä long page " * 200 + "</p>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://b/ 3\r\n", BIG), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"),
         (None, "u", BIG), (None, "u", "other\r\n\r\nWARC/1.1\r\nfake: x\r\n\r\n" + "y" * 1000), (7, "u", "x" * 1000), (7, "u", "x" * 1000), (8, "u", "WARC/1.1\r\n")]


def pages(spark, data=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in data], "page_id long, url string, html string, record_type string, top int").repartition(2)


def test_round_trip(spark):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark)).collect()), key=str)
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        again = html == BIG and page != 9
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_payloads_come_back(spark):
    path = work_path(spark, "warc")
    warc.write_pages(pages(spark), path)
    read = warc.read_records(spark, path).collect()
    assert [r for r in read if r.record_type == "gap" or r.reason] == []
    got = sorted(bytes(r.payload) for r in read if r.record_type == "response")
    assert got == sorted((h or "").encode() for p, _, h in PAGES if not (h == BIG and p != 9))


def record(i, body=b"hello"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{i}>\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def summary(data):
    return [(kind, start, end, what if kind == "gap" else int(warc._PAGE.match(what[0][b"warc-record-id"])[1])) for kind, start, end, what in warc.read_archive(data)]


def test_plain_salvage():
    a, b, c = record(1), record(2, b"x" * 50), record(3)
    assert [s[3] for s in summary(a + b + c)] == [1, 2, 3]
    broken = bytearray(b)
    broken[-10] ^= 1  # a changed byte of the block
    assert summary(a + bytes(broken) + c) == [("record", 0, len(a), 1), ("gap", len(a), len(a + b), "block digest differs"), ("record", len(a + b), len(a + b + c), 3)]
    cut = b[:-20]  # bytes are missing
    found = summary(a + cut + c)
    assert [f[0] for f in found] == ["record", "gap", "record"] and found[1][1:3] == (len(a), len(a + cut))
    junk = summary(b"junk" + a + b"\x00\x01" + b)
    assert [f[3] for f in junk if f[0] == "record"] == [1, 2] and sum(f[2] - f[1] for f in junk if f[0] == "gap") == 6
    assert summary(b"") == [] and summary(b"abc")[0][:3] == ("gap", 0, 3)
    assert summary(a[:-1])[0][0] == "gap"


@pytest.mark.parametrize("where", [15, 60, -12])
def test_member_salvage(where):
    a, b, c = (gzip.compress(record(i, bytes(range(256)) * i)) for i in (1, 2, 3))
    assert [s[3] for s in summary(a + b + c)] == [1, 2, 3]
    broken = bytearray(b)
    broken[where] ^= 255
    found = summary(a + bytes(broken) + c)
    assert [f[3] for f in found if f[0] == "record" and f[1] in (0, len(a + b))] == [1, 3]
    assert ("gap", len(a), len(a + b)) in [f[:3] for f in found]
    cut = summary(a + b[:-30] + c)
    assert [f[3] for f in cut if f[0] == "record"][-1] == 3 and any(f[0] == "gap" for f in cut)
    whole = gzip.compress(record(1) + record(2) + record(3))
    assert [s[3] for s in summary(whole)] == [1, 2, 3]
    assert [s[3] for s in summary(a + record(5) + b)] == [1, 5, 2]


def test_damage_in_a_member_of_many_records():
    many = b"".join(record(i, hashlib.sha256(b"%d" % i).hexdigest().encode() * 2) for i in range(1, 3001))
    whole = gzip.compress(many)
    numbers = lambda data: [f[3] for f in summary(data) if f[0] == "record"]
    assert numbers(whole) == list(range(1, 3001))
    broken = bytearray(whole)
    broken[-6] ^= 255  # the checksum: all content is there
    found = summary(bytes(broken))
    assert [f[3] for f in found if f[0] == "record"] == list(range(1, 3001))
    assert [f[0] for f in found if f[0] == "gap"] == ["gap"]
    for where in (len(whole) // 3, len(whole) * 9 // 10):
        broken = bytearray(whole)
        broken[where] ^= 255
        damaged = bytes(broken)
        got = numbers(damaged + gzip.compress(record(5000)))
        assert got[-1] == 5000 and got[0] == 1 and len(got) >= 3000 * where / len(whole) * 0.95
        assert any(f[0] == "gap" for f in summary(damaged))


def test_article_without_its_surroundings(spark):
    body = "<h1>Title&amp;s</h1><p>A first  paragraph\nwith <b>bold</b> text and enough words to be content.</p><p>Short.</p><p>Unclosed paragraph of some length here<p>Last &lt;one&gt;."
    html = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header>"
        "<nav><ul><li><a href=#>Menu entry</a></li></ul></nav><div class='ad'>Buy this now, it is very cheap and very good for everyone.</div>"
        f"<article>{body}<aside>Aside words</aside><div id='comments'><p>A reader comment that is rather long and says nothing.</p></div>"
        "<form><p>Your mail</p><input></form></article><div class='cookie-notice'>We use cookies</div><footer>&copy; me</footer></body></html>")
    want = "Title&s\nA first paragraph with bold text and enough words to be content.\nShort.\nUnclosed paragraph of some length here\nLast <one>."
    assert extract.main_text(html) == want
    assert extract.main_text(html.replace("</body></html>", "").replace("</footer>", "")) == want
    plain = html.replace("<article>", "<div>").replace("</article>", "</div>")
    assert extract.main_text(plain) == want
    data = [(1, "u", html), (2, None, None), (3, "u", ""), (None, "u", "just text that is not marked up"), (1, "u", html), (5, "u", "<nav>never closed <p>" + "words in a long line " * 9)]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract.extract_pages(pages(spark, data)).collect()), key=str)
    assert [g[3] for g in got] == [len(g[2]) for g in got]
    assert {g[0]: g[2] for g in got} == {1: want, 2: "", 3: "", None: "just text that is not marked up", 5: "never closed\n" + ("words in a long line " * 9).strip()}
    assert extract.extract_pages(pages(spark).limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    '<div class="no-sidebar">%s</div>', '<main class="has-header">%s</main>', '<article class="post with-comments">%s</article>', '<div id="page" class="sticky-nav">%s</div>',
    '<main class="header">%s</main>', '<div class="header"><div class="menu-wrap"><article>%s</article></div></div>', '<div class="widget"><div class="banner"><main>%s</main></div></div>'])
def test_wrappers_with_class_words_keep_the_article(page):
    body = "<p>A paragraph of the article with enough words to be content.</p><p>And a second one of nearly the same length, after it.</p>"
    around = '<div class="cookie-notice">We use cookies here, and this line is as long as a paragraph.</div><ul id="comment-list-3"><li>A reader comment that is rather long.</li></ul>'
    want = "A paragraph of the article with enough words to be content.\nAnd a second one of nearly the same length, after it."
    assert extract.main_text(f"<html><body>{around}{page % body}</body></html>") == want


LONG = "<p>" + "A sentence of an article that goes on and on, without an end. " * 6 + "</p>"
COMMENTS = ('<div id="comments" class="comments-area"><ol class="comment-list"><li class="comment"><article class="comment-body">'
            + "<p>I do not agree with this text at all, dear author.</p>" * 40 + "</article></li></ol></div>")


@pytest.mark.parametrize("before, after", [
    ("<article>", "</article>" + COMMENTS), ("<div>", "</div>" + COMMENTS),
    ("<div>", "</div>" + "<article><h3>Other story</h3><p>A teaser of another story.</p></article>" * 3),
    ("<article>", '<div class="post-comments">One of them.</div><div class="user-comment">Another.</div><div class="cookie-banner-v2">We use cookies.</div></article>'),
    ('<form id="page"><div class="sidebar"><article>', "</article></div></form>"), ('<article class="sidebar">', "</article>"),
])
def test_article_beside_comments_and_teasers(before, after):
    want = "\n".join([" ".join(LONG[3:-4].split())] * 4)
    assert extract.main_text(f"<html><body>{before}{LONG * 4}{after}</body></html>") == want


def test_short_paragraphs_at_the_end_stay():
    tail = ["Yes.", "No.", "So it goes.", "And so on.", "The end.", "Really."]
    got = extract.main_text("<body><div>" + LONG * 4 + "".join(f"<p>{t}</p>" for t in tail) + "</div></body>")
    assert got.split("\n")[4:] == tail


@pytest.mark.parametrize("page", ["<nav>" * 100_000 + LONG, "<form>" * 100_000 + LONG, '<div class="sidebar">' * 50_000 + f"<article>{LONG}</article>" + "</div>" * 50_000])
def test_time_is_linear_in_broken_tags(page):
    start = time.process_time()
    assert extract.main_text(page) == " ".join(LONG[3:-4].split())
    assert time.process_time() - start < 10


def _random_tree(rng, depth=0):
    """(tag, class, children or text): a random element."""
    if depth > 4 or rng.random() < 0.3:
        return ("p", "", f"line {rng.randrange(10**6)} " + "word " * rng.randrange(1, 30))
    tag, name = rng.choice([("div", ""), ("div", "sidebar"), ("div", "comment-list"), ("section", ""), ("article", ""), ("article", "comment"), ("nav", ""),
                            ("form", ""), ("div", "no-sidebar"), ("ul", "related"), ("select", "")])
    return (tag, name, [_random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))])


def _markup(node):
    tag, name, inner = node
    return f'<{tag} class="{name}">' + (inner if isinstance(inner, str) else "".join(map(_markup, inner))) + f"</{tag}>"


def _kept_by_tree(root):
    """The rules of dropped elements, applied to the whole tree: (text, kept) of each line."""
    lines, elements = [], []

    def walk(node):
        tag, name, inner = node
        first = len(lines)
        if isinstance(inner, str):
            lines.append(" ".join(inner.split()))
        else:
            place = len(elements)
            elements.append(None)
            for child in inner:
                walk(child)
            elements[place] = (tag, name, set(range(first, len(lines))))

    walk(root)
    bad = ("sidebar", "comment-list", "comment", "related")
    drops = [e for e in elements if e[1] in bad or e[0] in ("nav", "form", "select")]
    union = lambda es: set().union(*[e[2] for e in es])
    size = lambda ids: sum(len(lines[i]) for i in ids)
    hard = union([e for e in drops if e[0] == "select"])
    for articles in ([e for e in elements if e[0] == "article" and e[1] not in bad and e[2] - hard], [e for e in elements if e[0] == "article" and e[1] in bad and e[2] - hard]):
        if not articles:
            continue
        outside = size(set(range(len(lines))) - union(drops))
        need = union(articles)
        spanned = set(range(min(need), max(need) + 1))
        drops = [e for e in drops if e[0] == "select" or not (spanned <= e[2] or any(e is a for a in articles))
                 or not (outside < extract.OUTSIDE or e[1] in ("", "sidebar") and outside < size(e[2]))]
        if spanned - union(drops):
            break
    gone = union(drops)
    return [(t, i not in gone) for i, t in enumerate(lines)]


def test_dropped_lines_equal_those_of_the_tree():
    rng = random.Random(8)
    for _ in range(1500):
        root = ("div", "", [_random_tree(rng) for _ in range(rng.randrange(1, 5))])
        lines, dropped = extract.page_lines(_markup(root))
        assert [(x.text, not d) for x, d in zip(lines, dropped)] == _kept_by_tree(root), _markup(root)
