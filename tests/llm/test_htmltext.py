import random
import time

from lodestitch.llm import htmltext


def test_held_out_pages():
    model = htmltext.trained()
    rng = random.Random(12345)
    kept = junk = lost = 0
    for _ in range(200):
        page, _ = htmltext.made_up_page(rng)
        nodes, texts = htmltext.parse(page)
        gone = htmltext.dropped(nodes, model.log_odds(htmltext.features(nodes, texts)))
        for i, node in enumerate(nodes):
            assert not (i and gone[node.parent] and not gone[i])
        for node, text, _ in texts:
            if text and text.strip():
                if gone[node]:
                    lost += len(text) * ("zz" not in text)
                elif "zz" in text:
                    junk += len(text)
                else:
                    kept += len(text)
    assert kept / (kept + junk) > 0.97 and kept / (kept + lost) > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About</a></li></ul></nav><div class="ad">Buy this now.</div>
<article><h1>A caf&eacute; &amp; more</h1><p><b>Bold start, of a paragraph.<br><p>Next   line
goes on, with some more words in it.</p><!-- hidden <p>x</p> --><p>One &lt; two, and that is the end of the story.</p></article>
<div id="comments"><h3>Comments</h3><div class="comment">I like it.</div><div class="comment">Me too.</div></div><footer>&copy; us</footer>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (None, None, "<p>unclosed <b>text"), (4, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "u", "a < b <"), (6, "u", "<script>only"), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in htmltext.extract(df).collect()]
    want = "A café & more Bold start, of a paragraph. Next line goes on, with some more words in it. One < two, and that is the end of the story."
    assert got[0] == got[7] == (1, want, len(want))
    assert got[1] == (2, "", 0) and got[2] == (3, "", 0) and got[6] == (6, "", 0)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_only_a_hidden_attribute_hides():
    at = PAGE.index("<article>") + len("<article")
    model = htmltext.trained()
    want = htmltext.main_text(PAGE, model)
    for attribute in ('style="overflow:hidden"', "title='hidden gems'", 'data-hidden="true"', 'data-hidden', "style=overflow:hidden", 'aria-hidden="false"', 'data-x="a hidden b"'):
        assert htmltext.main_text(PAGE[:at] + " " + attribute + PAGE[at:], model) == want
    for attribute in ("hidden", "HIDDEN", 'id="x" hidden=""', "aria-hidden=true"):
        assert "caf" not in htmltext.main_text(PAGE[:at] + " " + attribute + PAGE[at:], model)
    for attribute in ("hidden", 'style="overflow-x:hidden"'):
        assert htmltext.main_text(PAGE.replace("<body>", f"<body {attribute}>"), model) == want


def test_hostile_pages_take_linear_time():
    pages = {"<a ": 100_000, "<div>": 60_000, "<svg>": 60_000, '<a "x ': 60_000, "<a \"'>": 60_000, "<ul><li><div>": 20_000, "<div></section>": 40_000, "<!": 100_000, "<p><table><td><div>": 20_000, "&": 200_000}
    for piece, times in pages.items():
        start = time.time()
        htmltext.parse(piece * times)
        assert time.time() - start < 10, piece
    assert htmltext.parse('a<b title="x>y">c</b> <i "open>d')[1][-1][1] == "d"


# Pages in other tongues, whose classes are in none of the groups of words; what a reader would keep is marked by hand.
LONG = ["Der Rat hat am Montag beschlossen, die alte Brücke zu sanieren, weil sie den Verkehr nicht mehr trägt.", "Die Arbeiten dauern zwei Jahre, sagte die Leiterin des Amtes, und kosten mehr als geplant war.", "Anwohner hatten lange darauf gedrängt, denn der Umweg kostet sie jeden Morgen viel Zeit."]
FOREIGN = [
    f"<html><body><nav><ul><li><a href=/>Start</a></li><li><a href=/s>Sport</a></li><li><a href=/k>Kultur</a></li></ul></nav><div class=beitrag><h1>Brücke wird saniert</h1><p>{LONG[0]}</p><p>{LONG[1]}</p><p>{LONG[2]}</p></div><footer>Impressum und Datenschutz</footer></body></html>",
    f"<html><body><div class=kopfzeile><ul><li><a href=/>Start</a></li><li><a href=/s>Sport</a></li><li><a href=/k>Kultur</a></li><li><a href=/w>Wetter</a></li></ul></div><article class=xq1><p>{LONG[0]}</p><p>{LONG[1]}</p></article><aside class=rand><h3>Mehr</h3><ul><li><a href=/1>Eins</a></li><li><a href=/2>Zwei</a></li></ul></aside></body></html>",
    f"<body><form class=suche><label>Suchen nach</label><input name=q><button>Los</button></form><main class=haupt><h1>Brücke wird saniert</h1><p>{LONG[0]}</p><p>{LONG[2]}</p><blockquote>{LONG[1]}</blockquote></main><footer><ul><li><a href=/i>Impressum</a></li><li><a href=/d>Datenschutz</a></li></ul></footer>",
]
WANTED = [f"Brücke wird saniert {' '.join(LONG)}", " ".join(LONG[:2]), f"Brücke wird saniert {LONG[0]} {LONG[2]} {LONG[1]}"]


def test_pages_with_foreign_names():
    assert htmltext.main_texts(FOREIGN, htmltext.trained()) == WANTED
