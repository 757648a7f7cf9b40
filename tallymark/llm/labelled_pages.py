"""Labelled pages to train the page model on: layouts of our own, filled with made-up words.

Elements marked ``data-y="main"`` hold main text, those marked ``data-y="other"`` inside them don't.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: ``{P}`` is some paragraphs, ``{S}`` a sentence, ``{W}`` a few words, ``{N}`` a menu, ``{A}`` a link.
HEAD = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{W}</title><style>p{margin:0}</style><script>var t="</p>";</script></head>'
MAIN_PARTS = [
    '<article data-y="main"><h1>{W}</h1>{P}</article>',
    '<article data-y="main" class="post"><header><h1>{W}</h1></header>{P}<h2>{W}</h2>{P}<ul><li>{S}</li><li>{S}</li></ul></article>',
    '<main><article data-y="main" class="entry-content"><h2>{W}</h2>{P}<blockquote>{S}</blockquote>{P}<div class="share social-buttons" data-y="other">{N}</div></article></main>',
    '<div class="content"><div class="article-body" data-y="main"><h1>{W}</h1>{P}<figure><figcaption>{S}</figcaption></figure>{P}</div></div>',
    '<div id="main"><div class="post-content story text" data-y="main">{P}<h3>{W}</h3>{P}<ol><li>{S}</li><li>{S}</li></ol></div></div>',
    '<main data-y="main"><h1>{W}</h1>{P}<table><tr><th>{W}</th><td>{S}</td></tr><tr><th>{W}</th><td>{S}</td></tr></table>{P}</main>',
    '<article data-y="main"><h1>{W}</h1>{P}<div class="ad advert" data-y="other">{S}</div>{P}<aside class="related" data-y="other"><h3>{W}</h3>{N}</aside></article>',
    '<article data-y="main"><h1>{W}</h1><p>{S}</p><section><h2>{W}</h2>{P}</section><section><h2>{W}</h2>{P}</section><section class="comments" data-y="other"><h3>{W}</h3>{C}</section></article>',
    '<section class="main-content" data-y="main"><h1>{W}</h1><p><b>{S}<br><p>{S}</p>{P}</section>',
    '<article data-y="main"><h1>{W}</h1><p><b>{S}<br><p>{S}</p>{P}<pre><code>{W}</code></pre><p>{W}.</p></article>',
    '<td class="body-text" data-y="main"><h1>{W}</h1>{P}</td>',
    '<article data-y="main">{P}<form class="newsletter subscribe" data-y="other"><label>{W}</label><input name="q"><button>{W}</button></form>{P}<div class="cookie notice" data-y="other"><p>{S}</p></div></article>',
]
BEFORE = [
    "<nav>{N}</nav><!-- ad 1 --><div class=\"ad\">{S}</div>",
    '<header class="site-header"><div class="logo">{A}</div><nav class="menu">{N}</nav></header>',
    '<div id="header"><h2>{A}</h2><div class="navbar nav-menu">{N}</div></div><div class="breadcrumb breadcrumbs">{A} {A} {A}</div>',
    '<div class="cookie-banner notice consent"><p>{S}</p><button>{W}</button></div><header><p>{W}</p>{N}</header>',
    '<div role="navigation">{N}</div><div class="banner advertisement sponsored promo"><p>{S}</p>{A}</div>',
    '<header><h1>{W}</h1><nav>{N}</nav></header>',
    '<header class="top"><h1>{A}</h1><p>{S}</p></header><nav>{N}</nav>',
    '<header role="banner"><p>{S}</p></header><form role="search"><input type="text"><label>{W}</label><button>{W}</button></form>',
    '<nav>{N}</nav><aside class="sidebar"><h3>{W}</h3>{N}<p>{S}</p></aside>',
    '<div class="alert message warning popup modal overlay"><p>{S} {S}</p></div><nav>{N}</nav>',
]
AFTER = [
    "<footer>&copy; {W} &middot; {S}\n{W}.</footer>",
    '<aside class="sidebar widget"><h3>{W}</h3>{N}<p>{S}</p></aside><footer class="site-footer"><p>{S}</p>{N}</footer>',
    '<section id="comments" class="comments reader-comments"><h2>{W}</h2>{C}</section><footer><p>&copy; {W}</p></footer>',
    '<div id="footer" class="footer copyright"><p>{S}</p>{A} {A}</div>',
    '<div class="related recommended more"><h3>{W}</h3>{N}</div><div class="comment-list">{C}</div><footer>{N}<p>{S}</p></footer>',
    '<form class="contact" action="/send"><p>{S}</p><label>{W}</label><textarea>{W}</textarea><select><option>{W}</option><option>{W}</option></select><button>{W}</button></form><footer>{S}</footer>',
    '<div class="ad ads sponsor"><p>{S} {S}</p>{A}</div><div class="disclaimer legal terms privacy"><p>{S}</p></div><footer role="contentinfo">{S}</footer>',
    '<div id="disqus_thread" class="discussion responses">{C}</div><div class="tags meta author byline">{A} {A}</div><footer>{S}</footer>',
]


def _filler(draw: random.Random):
    def word() -> str:
        return "".join(draw.choice(["ka", "lo", "mi", "ru", "te", "sa", "ven", "dor", "il", "po"]) for _ in range(draw.randint(1, 3)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(draw.randint(low, high)))

    def sentence() -> str:
        return words(3, 25).capitalize() + "."

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 3)}</a>'

    def paragraph() -> str:
        text = " ".join(sentence() for _ in range(draw.choice([1, 1, 2, 4, 8])))
        if draw.random() < 0.2:
            text += f" {link()} " + sentence()
        if draw.random() < 0.2:
            text = f"<b>{words(1, 3)}</b> " + text
        if draw.random() < 0.15:
            text = words(1, 2).capitalize() + "."
        # The end tag may be missing.
        return f"<p>{text}" + ("</p>" if draw.random() < 0.9 else "")

    return {
        "{P}": lambda: "".join(paragraph() for _ in range(draw.choice([1, 2, 4, 9]))),
        "{S}": sentence,
        "{W}": lambda: words(1, 6),
        "{N}": lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 8))) + "</ul>",
        "{A}": link,
        "{C}": lambda: "".join(f'<div class="comment"><span class="author">{word()}</span><p>{sentence()} {sentence()}</p></div>' for _ in range(draw.randint(1, 5))),
    }


def _fill(layout: str, filler: dict) -> str:
    for mark, make in filler.items():
        while mark in layout:
            layout = layout.replace(mark, make(), 1)
    return layout


def pages(seed: int = 5) -> list[str]:
    """Every main part between every pair of surroundings drawn for it; a fixed number of pages."""
    draw = random.Random(seed)
    filler = _filler(draw)
    found = []
    for part in MAIN_PARTS:
        for before in BEFORE:
            for after in draw.sample(AFTER, 4):
                main = _fill(part, filler)
                if main.startswith("<td"):
                    main = f"<table><tr>{main}<td class=\"sidebar\">{_fill('{N}', filler)}</td></tr></table>"
                page = _fill(HEAD, filler) + "<body>" + _fill(before, filler) + main + _fill(after, filler)
                found.append(page + ("</body></html>" if draw.random() < 0.9 else ""))
    return found


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled pages as a table of one column, ``html``."""
    return spark.createDataFrame([(p,) for p in pages()], "html string")
