"""Main text of pages made from known articles by the templates of several hosts, and what a tokenizer must bear."""

import html
import random

import pytest

from repograph.llm import wrappers

WORDS = "amber brook cedar delta ember fjord grove haven inlet jetty knoll lagoon mesa notch oasis plain quarry ridge shoal tarn".split()


def sentence(rng, least=4, most=30):
    return " ".join(rng.choices(WORDS, k=rng.randint(least, most))).capitalize() + "."


def tagged(rng, body):
    menu = "".join(f"<li><a href=/{w}>{w}</a>" for w in rng.choices(WORDS, k=rng.randint(2, 7)))
    paragraphs = "".join(f"<p>{b}" if rng.random() < 0.5 else f"<p>{b}</p>" for b in body[1:])
    comments = "".join(f"<div class=comment><b>{rng.choice(WORDS)}</b><p>{sentence(rng)}</p></div>" for _ in range(rng.randint(0, 5)))
    side = f"<aside><h3>More</h3><p>{sentence(rng)}</p></aside>" if rng.random() < 0.5 else ""
    return f"<!DOCTYPE html><html><head><title>{body[0]}</title><style>p{{}}</style><script>var x = '</p><article>';</script></head><body><header>Site of {rng.choice(WORDS)}</header><nav><ul>{menu}</ul></nav><!-- <p>no</p> --><div class='top ad'>{sentence(rng)}</div><article><h1>{body[0]}</h1>{paragraphs}</article>{side}<section id=comments>{comments}</section><form><label>Mail</label><input name=q><button>Go</button></form><footer>&copy; {sentence(rng)}</footer>"


def divs(rng, body):
    """No article element, labels on some blocks only, and a notice that is the same everywhere."""
    links = "".join(f"<a href=x>{w}</a> " for w in rng.choices(WORDS, k=5))
    return f"<html><body><div id=page><div class=logo>The Daily Knoll</div><div class=sidebar>{sentence(rng)}{sentence(rng)}</div><div class='story s{rng.randint(1, 99)}'><h1>{body[0]}</h1>{''.join(f'<p>{b}</p>' for b in body[1:])}<div>This page may be read by all who like it.</div></div><div class=x>{links}</div><div class=c-ookies><span>We keep crumbs.</span></div></div></body></html>"


def quoted(rng, body):
    """Headings with paragraphs in turns, a container whose label speaks of a sidebar, upper-case tags."""
    return f"<BODY><DIV CLASS='content with-sidebar'><H1>{body[0]}</H1>{''.join(f'<H2>{b}</H2>' if i % 3 == 0 else f'<P>{b}</P>' for i, b in enumerate(body[1:]))}</DIV><DIV ROLE=complementary><UL><LI>{sentence(rng)}<LI>{sentence(rng)}</UL></DIV></BODY>"


def blocks(rng):
    return [sentence(rng, 3, 8)] + [sentence(rng) + rng.choice(["", " A <b>bold</b> word.", " R&amp;D &lt;x&gt; caf&eacute;\n\t here.", " See <a href=y>this</a>."]) for _ in range(rng.randint(1, 12))]


def plain(block):
    return " ".join(html.unescape(block.replace("<b>", "").replace("</b>", "").replace("<a href=y>", "").replace("</a>", "")).split())


def made(n=40, seed=3):
    rng = random.Random(seed)
    rows, want = [], {}
    for host, form in (("a.example", tagged), ("b.example", divs), ("c.example", quoted)):
        for _ in range(n):
            body = blocks(rng)
            want[len(rows)] = "\n".join(plain(b) for b in body)
            rows.append((len(rows), f"https://{host}/p/{len(rows)}", form(rng, body), 1))
    return rows, want


SCHEMA = "page_id long, url string, html string, host int"


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA)
    return wrappers.extract_text(pages, wrappers.infer_wrappers(pages)).collect()


def test_articles_come_back_whole(spark):
    rows, want = made()
    copies = [(1000 + i, "http://copies.example/1", rows[0][2], 1) for i in range(5)]
    odd = [(2000, None, rows[1][2], 1), (2001, "http://none.example", None, 1), (2002, "http://none.example", "", 1), (2003, "x", "<<< a < b <p", 1), (None, "http://copies.example/1", rows[0][2], None)]
    long = "<article>" + "".join(f"<p>line {i}</p><div>x {i}</div>" for i in range(3000)) + "</article>"
    got = extracted(spark, rows + copies + odd + odd[:1] + [(3000, "http://long.example", long, 1), (3001, "http://long.example", "<div>" * 5000 + "deep" + "</div>" * 5000, 1)])
    assert len(got) == len(rows) + 13
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id in want:
            assert r.text == want[r.page_id], (r.page_id, rows[r.page_id][2], r.text)
        elif r.page_id is None or r.page_id < 2000:
            assert r.text == want[0]
    by = {r.page_id: r.text for r in got}
    assert by[2000] == want[1] and by[2001] == by[2002] == "" and by[2003] == "<<< a < b"
    assert by[3000] == "\n".join(f"line {i}\nx {i}" for i in range(3000)) and by[3001] == "deep"
    assert extracted(spark, []) == []


def test_result_does_not_depend_on_the_partitions(spark):
    rows, _ = made(15, 8)
    pages = spark.createDataFrame(rows, SCHEMA)
    one = {r.host: r.wrapper for r in wrappers.infer_wrappers(pages.coalesce(1)).collect()}
    many = {r.host: r.wrapper for r in wrappers.infer_wrappers(pages.repartition(7)).collect()}
    assert one == many and len(one) == 3


def outline(kids):
    return "".join(f"{k[0]}{k[1]}" + ("" if k[2] is None else "{" + outline(k[2]) + "}") + ";" for k in kids)


def test_mismatches_become_optional_and_repeated_groups():
    a = wrappers.Page("<h1>t</h1><ul><li>1<li>2</ul><p>x</p>")
    b = wrappers.Page("<h1>u</h1><p>y</p><hr><table><tr><td>1</table>")
    both = wrappers.aligned(wrappers._plain(a), wrappers._plain(b), lambda x, y: x)
    assert outline(both) == "h1{#;};ul?{li+{#;};};p{#;};table?{tr{td{#;};};};"
    assert outline(wrappers.Page("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>").kids) == "dl{(dt|dd)+{dt{#;};dd{#;};};};"
    assert outline(wrappers.Page("<h2>a</h2><p>b<p>c<h2>d</h2><p>e<p>f<p>g<h2>h</h2><p>i").kids) == "(h2|p)+{h2{#;};p+{#;};};"


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p>a<b>b<p>c", ["ab", "c"]), ("a<br>b &nbsp; c", ["a b c"]), ("<div>x<div>y</div>z</div>", ["x", "y", "z"]), ("<!-- <p>a", []), ("<script>if (a < b) '<p>x</p>'", []), ("<p title='a>b'>c", ["c"]), ("<p title='a>b c", ["b c"]),
        ("a &amp; b &#x41;&#66; &bogus;", ["a & b AB &bogus;"]), ("<table><tr><td>a<td>b</div>c</table>d", ["a", "bc", "d"]), ("x</p>y</nope>z", ["x", "yz"]), ("<p>in <span class='ad'>buy</span> out", ["in out"]), ("fo<i>o</i>b<!-- c -->ar", ["foobar"]),
    ],
)
def test_tokens(source, want):
    assert [t for _, t, _ in wrappers.Page(source).texts] == want


def test_alignment_is_the_same_whatever_the_size(monkeypatch):
    rng = random.Random(6)
    for n, m, keys in [(0, 5, 2), (1, 1, 1), (7, 9, 3), (40, 33, 4), (120, 160, 12), (200, 90, 60), (64, 64, 1)] * 5:
        a, b = ([f"k{rng.randrange(keys)}" for _ in range(k)] for k in (n, m))
        monkeypatch.setattr(wrappers, "CELLS", 10**9)
        want = wrappers._steps(a, b)
        monkeypatch.setattr(wrappers, "CELLS", -1)
        assert wrappers._steps(a, b) == want
    monkeypatch.undo()
    a, b = [f"k{i}" for i in range(700)], [f"x{i}" for i in range(400)] + [f"k{i}" for i in range(700)]
    assert len(wrappers._steps(a, b)) == 700
