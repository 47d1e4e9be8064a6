import pytest

from folioforge.operators.article import main_html
from folioforge.operators.html import to_markdown

TEXT = ["Rivers carry sand, silt and clay to the sea, and lay them down where the water slows.", "Over many years, the mouth grows outward, splits, and turns into a fan of channels.", "Storms, tides and floods then shape it again, so that no delta keeps its form for long."]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Section {k} with a long name, and more</a></li>' for k in range(9)) + "</ul>"
NOISE = "Please subscribe now, share this page with friends, and read what others have said, too."

PAGES = {
    "plain blocks": f'<body><div id="menu">{MENU}</div><div class="x"><h1>Deltas</h1>{BODY}</div><div class="sidebar"><p>{NOISE}</p></div></body>',
    "links without names": f"<body><div>{MENU}</div><div><h1>Deltas</h1>{BODY}</div><div>{MENU}</div></body>",
    "several articles": f"<body><article><p>Short, teaser.</p></article><article><h1>Deltas</h1>{BODY}</article><article><a href='/'>More, of, the, same, and other news today</a></article></body>",
    "nested": f'<html><head><title>t</title><script>var x = "<p>{NOISE}</p>";</script></head><body><div><div><section><h1>Deltas</h1>{BODY}</section></div><aside><p>{NOISE}</p></aside></div></body></html>',
    "boilerplate inside": f'<body><div><h1>Deltas</h1><p>{TEXT[0]}</p><div class="ad banner"><p>{NOISE}</p></div><p>{TEXT[1]}</p><nav>{MENU}</nav><p>{TEXT[2]}</p></div></body>',
    "tags left open": f"<body><div>{MENU}</div><div><h1>Deltas</h1><p>{TEXT[0]}<p>{TEXT[1]}<p>{TEXT[2]}</div><footer>{NOISE}",
    "one article": f"<body><div><p>{NOISE} {NOISE}</p></div><article><h1>Deltas</h1>{BODY}</article></body>",
    "paragraphs beside": f"<body><div>{MENU}</div><main><div><h1>Deltas</h1><p>{TEXT[0]}</p><p>{TEXT[1]}</p></div><p>{TEXT[2]}</p></main></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_marked_samples(name):
    found = to_markdown(main_html(PAGES[name]))
    assert found.replace("# Deltas", "").split("\n\n") [-3:] == TEXT and "Section" not in found and "subscribe" not in found and "teaser" not in found


def test_odd_pages():
    assert main_html(None) is None and main_html("") == "" and main_html("no tags at all") == "no tags at all"
    assert main_html("<div></div>") == "<div></div>"
    assert main_html(f'<nav>{MENU}</nav><div><h1>Hi</h1><p>Short.</p></div><footer>{NOISE}</footer>') == "<h1>Hi</h1><p>Short.</p>"
    deep = "<div>" * 20_000 + BODY + "</div>" * 20_000
    assert to_markdown(main_html(deep)).split("\n\n") == TEXT
    assert TEXT[0] in main_html(f"</p></div><p>{TEXT[0]}</span></p></article>")
