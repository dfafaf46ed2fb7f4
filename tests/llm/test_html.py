import numpy as np

from tributary.llm import html as H


def test_parsing():
    page = "<head><title>t</title></head><body><p class='a-b' id=mainText>One &amp; <b>t</b>wo\n three<br>four<p>five<script>x<p></script><!-- c <p> --><ul><li>six<li><a href=x>seven</a></ul><textarea>no</textarea></body"
    got = H.blocks(page)
    assert [b.text for b in got] == ["One & two three", "four", "five", "six", "seven", "</body"][: len(got)]
    assert got[0].node.words == ("p", "a", "b", "main", "text") and got[4].linked == 5 and got[3].linked == 0
    assert H.blocks(None) == [] and H.blocks("") == [] and [b.text for b in H.blocks("plain &lt;x&gt; text")] == ["plain <x> text"]
    assert [b.text for b in H.blocks('<p title="a>b">x</p><p title="open>y</p>')] == ["x", "y"]
    assert len(H.blocks("<div>" * 3000 + "deep")) == 1


def test_odd_markup():
    text = lambda page: [b.text for b in H.blocks(page)]
    for tag in ("svg", "object", "math", "canvas", "video", "noscript", "template"):
        assert text(f"<p>a</p><{tag}><path><p>b</p>") == ["a", "b"], tag
        assert text(f"<p>a</p><{tag}>x</{tag}><p>b</p>") == ["a", "b"], tag
    assert text("<svg><path><p>b</p><svg>no</svg>c") == ["b", "c"]
    assert text("<head><title>no</title><p>a") == ["a"] and text("<head><title>no<body>x") == ["x"] and text("<script>no<p>x") == []
    assert text("a<button>no</button><select><option>no</select>b") == ["a", "b"]


def test_nesting_takes_linear_time():
    import time

    took = []
    for n in (2000, 16000):
        page = "<div>".join("x" for _ in range(n)) + "</i>" * n
        at = time.perf_counter()
        read = H.blocks(page)
        H.vectors(read)
        took.append(time.perf_counter() - at)
        assert len(read) == n
    assert took[1] < 40 * took[0]


def scalar_logits(m, x):
    """The bidirectional LSTM as it is written down, number by number."""
    p, n, hid = m.p, len(x), H.HIDDEN
    sig = lambda z: 1 / (1 + np.exp(-z))
    out = [float(p["c"][0])] * n
    for d, order, place in (("f", range(n), 0), ("b", range(n - 1, -1, -1), hid)):
        h, c = [0.0] * hid, [0.0] * hid
        for t in order:
            g = [float(p[f"b{d}"][k] + sum(x[t][j] * p[f"W{d}"][j, k] for j in np.flatnonzero(x[t])) + sum(h[j] * p[f"U{d}"][j, k] for j in range(hid))) for k in range(4 * hid)]
            c = [sig(g[hid + k]) * c[k] + sig(g[k]) * np.tanh(g[3 * hid + k]) for k in range(hid)]
            h = [sig(g[2 * hid + k]) * np.tanh(c[k]) for k in range(hid)]
            out[t] += sum(h[k] * p["V"][place + k] for k in range(hid))
    return out


def test_labeller_equals_a_scalar_one():
    m, g = H.Labeller(np.random.default_rng(1)), H.Grammar(np.random.default_rng(2))
    for _ in range(3):
        x = g.sample()[0][:12]
        z, live = H.padded([x])
        assert np.allclose(m.logits(z, live)[:, 0], scalar_logits(m, x), atol=1e-4)


PROSE = ["The committee met on Tuesday to discuss how the old bridge could be repaired before winter.", "Nobody had expected that the costs would be so high, but the engineers were sure of their numbers.", "In the end they agreed to close one lane, and to let the other be used by buses only."]
PAGES = [
    ("<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>A bridge for all</h1><p>{0}</p><form><p>Sign up</p><input name=e></form><p>{1}</p></article><footer>All rights reserved</footer></body></html>", "A bridge for all {0} {1}"),
    ("<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td></tr><tr><td>Advertisement: buy shoes now</td></tr><tr><td><h1>A bridge for all</h1><p>{0}</p><p>{1}</p><p>{2}</p></td></tr><tr><td>© 2020 Privacy policy</td></tr></table>", "A bridge for all {0} {1} {2}"),
    ("<div id=nav><ul><li><a href=/>Startseite</a><li><a href=/k>Kontakt</a></ul></div><div class=post-content><h2>A bridge for all</h2><p>{0}</p><blockquote>{1}</blockquote></div><div class=comments><div class=comment><p>{2}</p></div></div><div class=sidebar><h3>Related posts</h3><a href=/x>Another bridge</a></div>", "A bridge for all {0} {1}"),
    ("<form action=/page><div class=header><a href=/>Home</a><a href=/a>About</a></div><div class=cookie-banner>We use cookies</div><main><h1>A bridge for all</h1><p>{0}</p><p>{1}</p><p>{2}</p><p>{0}</p></main><div class=footer>Powered by us</div></form>", "A bridge for all {0} {1} {2} {0}"),
    ("<div><a href=/>Accueil</a> <a href=/p>À propos</a></div><div><h1>A bridge for all</h1><p>{0}</p><p>{1}</p><p>{2}</p></div><div>© 2021 Tous droits réservés</div>", "A bridge for all {0} {1} {2}"),
]


def test_pages_written_by_hand():
    m = H.train()
    for page, want in PAGES:
        read = H.blocks(page.format(*PROSE))
        assert H.main_text(read, m.label([read])[0]) == want.format(*PROSE)


def test_gradients():
    rng = np.random.default_rng(0)
    m = H.Labeller(rng)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = rng.standard_normal((4, 2, H.WIDTH))
    live = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = rng.integers(0, 2, (4, 2)).astype(float)
    grad, _ = m.gradients(x, live, y)
    for name in ("Uf", "Wb", "bf", "V", "c"):
        at = tuple(0 for _ in m.p[name].shape)
        old, e = m.p[name][at], 1e-4
        m.p[name][at] = old + e
        up = m.gradients(x, live, y)[1]
        m.p[name][at] = old - e
        down = m.gradients(x, live, y)[1]
        m.p[name][at] = old
        assert abs((up - down) / 2 / e - grad[name][at]) < 1e-3 * max(1, abs(grad[name][at])), name


def test_held_out_pages():
    m, g = H.train(), H.Grammar(np.random.default_rng(77))
    right = total = 0
    for _ in range(150):
        x, y = g.sample()
        z, live = H.padded([x])
        right += int(((m.logits(z, live)[:, 0] > H.LEAST) == (y > 0)).sum())
        total += len(y)
    assert right / total > 0.97


def test_padding_does_not_matter():
    m = H.train()
    pages = [H.blocks(f"<nav><a href=x>Home</a></nav><article><h1>Title</h1>{'<p>Some words of text.</p>' * n}</article><footer>Legal</footer>") for n in (1, 9, 3)]
    for page, mark in zip(pages, m.label(pages), strict=True):
        assert mark.tolist() == m.label([page])[0].tolist()
        assert H.main_text(page, mark).startswith("Title Some words") and "Home" not in H.main_text(page, mark)


def test_rows(spark):
    page = '<html><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><div class="ad">Buy it</div><article><h1>A title</h1><p>Text one.</p><p>Text&nbsp;two &copy;</p></article><footer>End</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long text " * 30000 + "</p>")], "page_id long, url string, html string").selectExpr("*", "5 AS text", "6 AS n_chars")
    rows = H.extract(df).collect()
    assert sorted(str(r["page_id"]) for r in rows) == ["1", "1", "2", "3", "None"]
    got = {str(r["page_id"]): r for r in rows}
    assert got["1"]["text"] == "A title Text one. Text two ©" and got["1"]["n_chars"] == len(got["1"]["text"])
    assert got["2"]["text"] == "" and got["None"]["text"] == "" and len(rows) == 5
    assert H.extract(df.limit(0)).count() == 0


P, Q, R = PROSE
PLAIN = [
    # pages inside of a form, however long
    (f"<form method=post><div class=content><h1>A bridge for all</h1>{''.join(f'<p>{P}</p>' for _ in range(6))}</div></form>", " ".join(["A bridge for all", *[P] * 6])),
    (f"<form method=post><div class=content><h1>A bridge for all</h1><p>{P}</p><p>{Q}</p></div></form>", f"A bridge for all {P} {Q}"),
    (f"<form><nav><a href=/>Home</a></nav><div class=article><p>{P}</p><p>{Q}</p></div></form><div class=footer>Legal</div><div class=footer>Privacy policy</div><div class=footer>All rights reserved</div>", f"{P} {Q}"),
    # a form of the page stays one
    (f"<article><h1>A bridge for all</h1><p>{P}</p><form><h3>Newsletter</h3><p>{Q}</p><input name=e></form><p>{R}</p></article>", f"A bridge for all {P} {R}"),
    # elements without names, lines, definitions
    (f"<html><body><div>{P}</div></body></html>", P),
    (f"<body><div>{P}</div><div>{Q}</div></body>", f"{P} {Q}"),
    (f"<body><div id=main>{P}<br><br>{Q}</div></body>", f"{P} {Q}"),
    (f"<main><h1>Bridges</h1><dl><dt>Arch<dd>{P}<dt>Beam<dd>{Q}</dl></main>", f"Bridges Arch {P} Beam {Q}"),
    # buttons and lists of choices that nothing closes
    (f"<button>Menu<article><h1>A bridge for all</h1><p>{P}</p><p>{Q}</p></article><button>Share</button>", f"A bridge for all {P} {Q}"),
    (f"<select><option>en<option>de<article><h1>A bridge for all</h1><p>{P}</p><p>{Q}</p></article><select><option>x</select>", f"A bridge for all {P} {Q}"),
    # a menu in one cell
    (f"<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td></tr><tr><td><h1>A bridge for all</h1><p>{P}</p><p>{Q}</p><p>{R}</p></td></tr><tr><td>© 2020 Privacy policy</td></tr></table>", f"A bridge for all {P} {Q} {R}"),
]


def test_pages_of_plain_markup():
    m = H.train()
    for page, want in PLAIN:
        read = H.blocks(page)
        assert H.main_text(read, m.label([read])[0]) == want, page[:80]


def test_choices():
    text = lambda page: [b.text for b in H.blocks(page)]
    assert text("a<button><div>no</div></button>b<select><option>no</select>c") == ["a", "b", "c"]
    assert text("a<button>no<p>b</p><button>no</button>c") == ["a", "b", "c"] and text("<button>kept<p>b") == ["kept", "b"]
    assert text("<button>no<button>no</button>b") == ["b"] and text("<select><option>no<button>x</button><p>b") == ["b"]


def test_broken_tags_take_linear_time():
    import time

    def took(page):
        best = 9.0
        for _ in range(3):
            at = time.perf_counter()
            H.blocks(page)
            best = min(best, time.perf_counter() - at)
        return best

    for piece in ("<div ", "<a href='", "<a ", '<a ">"', "<a x='>", "<button>", "<select><p>", "<svg>", "<!--", "<p title=\">", "<form><h1>"):
        small, large = took(piece * 4000), took(piece * 32000)
        assert large < 8 * 3 * small + 0.05, (piece, small, large)
    assert [b.text for b in H.blocks('<p title="x>y">a</p><p title="open>b</p><p>c</p>')] == ["a", "b", "c"]
