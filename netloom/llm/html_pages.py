"""Labelled pages for the HTML model: written here from parts, with the state of every element known.

``y`` gives an element's state: m (holds content and other things), c (content)
or b (boilerplate); elements without it have their parent's. ``{n}`` becomes a
run of n random words, sentences where n is 8 or more.
"""

from __future__ import annotations

import random
import re

#: Parts of pages as they are commonly written; every list is sampled evenly.
HEADERS = [
    '<header class="site-header" y=b><a href="/">{2}</a><p>{4}</p></header>',
    '<div id="header" y=b><h1>{2}</h1><p>{5}</p></div>',
    '<div class="masthead banner" y=b><div class="logo"><a href="/">{1}</a></div><span>{5}</span></div>',
    '<header y=b><h2>{2}</h2><div>{9}</div></header>',
    '<div class="topbar" y=b>{6}</div>',
]
MENUS = [
    '<nav y=b><ul><li><a href="/a">{1}</a></li><li><a href="/b">{1}</a></li><li><a href="/c">{2}</a></li></ul></nav>',
    '<div class="menu" y=b><ul><li><a href="/a">{1}</a><li><a href="/b">{1}</a></ul></div>',
    '<ul id="navigation" class="nav" y=b><li><a href="/x">{1}</a></li><li><a href="/y">{1}</a></li></ul>',
    '<div class="breadcrumbs" y=b><a href="/">{1}</a> &gt; <a href="/s">{1}</a></div>',
    '<div role="navigation" y=b><p><a href="/q">{2}</a> | <a href="/r">{2}</a></p></div>',
    '<nav class="pagination pager" y=b><a href="/1">1</a> <a href="/2">{1}</a></nav>',
]
SIDES = [
    '<aside y=b><h3>{2}</h3><ul><li><a href="/a">{4}</a></li><li><a href="/b">{5}</a></li></ul></aside>',
    '<div class="sidebar" y=b><h4>{2}</h4><p>{14}</p></div>',
    '<div id="sidebar" class="widget" y=b><p>{10}</p><ul><li>{3}</li></ul></div>',
    '<section class="related recommended" y=b><h3>{2}</h3><div><a href="/r">{8}</a></div><div><a href="/s">{9}</a></div></section>',
    '<aside class="author-bio" y=b><p>{18}</p></aside>',
    '<div class="share social" y=b><a href="/t">{1}</a> <a href="/f">{1}</a></div>',
    '<div class="tags" y=b><a href="/t">{1}</a>, <a href="/u">{1}</a></div>',
]
ADS = [
    '<div class="ad" y=b>{8}</div>', '<div class="ad" y=b>{20}</div>', '<div class="ads banner" y=b><p>{12}</p></div>', '<div id="ad-1" class="advert advertisement" y=b><a href="/b">{9}</a></div>',
    '<aside class="promo sponsored" y=b><p>{16}</p></aside>', '<ins class="adsbygoogle" y=b>{3}</ins>', '<section class="sponsor" y=b><h3>{2}</h3><p>{11}</p></section>', '<div class="newsletter subscribe" y=b><p>{10}</p></div>',
]
NOTICES = [
    '<div class="cookie-banner notice" y=b><p>{18}</p><button>{1}</button></div>', '<div id="cookie-consent" class="consent" y=b>{14}</div>', '<div class="alert" role="alert" y=b><p>{12}</p></div>', '<div class="modal popup" role="dialog" y=b><h2>{3}</h2><p>{14}</p></div>',
    '<noscript y=b>{9}</noscript>', '<div class="notice" y=b>{10}</div>', '<div class="gdpr privacy" y=b><p>{22}</p></div>', '<p class="disclaimer" y=b>{17}</p>',
]
FORMS = [
    '<form action="/s" y=b><label>{2}</label><input name="q"><button>{1}</button></form>', '<form class="login" y=b><p>{9}</p><select><option>{1}<option>{1}</select><textarea>{3}</textarea></form>', '<div class="search" y=b><form><input><button>{1}</button></form></div>',
    '<fieldset y=b><legend>{2}</legend><label>{3}</label></fieldset>',
]
COMMENTS = [
    '<section class="comments" id="comments" y=b><h3>{2}</h3><div class="comment"><p>{14}</p></div><div class="comment"><p>{25}</p></div></section>', '<div id="comments" y=b><ol class="comment-list"><li class="comment">{16}</li><li>{9}</li></ol></div>',
    '<div class="comment-thread" y=b><article class="comment"><p>{20}</p></article><article class="comment"><h4>{2}</h4><p>{12}</p></article></div>', '<ul class="replies responses" y=b><li><p>{13}</p></li><li><p>{30}</p></li></ul>', '<div class="discussion reader-comments" y=b><div><b>{2}</b><p>{18}</p></div></div>',
]
FOOTERS = [
    '<footer y=b>&copy; {1} &middot; {9}</footer>', '<footer class="site-footer" y=b><p>{12}</p><ul><li><a href="/p">{2}</a></li></ul></footer>', '<div id="footer" y=b><p>{6}</p></div>', '<div class="footer copyright" y=b>{10}</div>', '<footer y=b><nav><a href="/i">{2}</a></nav><small>{14}</small></footer>',
]
WRAPS = ['<article y=c>{}</article>', '<main y=m><article y=c>{}</article></main>', '<div id="content" y=m><article class="post" y=c>{}</article></div>', '<div class="content" y=c>{}</div>', '<main id="main" y=c>{}</main>', '<div class="post entry" y=c><div class="entry-content">{}</div></div>', '<section class="article story" y=c><div class="article-body">{}</div></section>', '<div class="container" y=m><div class="main" y=c>{}</div></div>', '<div role="main" y=c>{}</div>', '<div y=c>{}</div>']
BLOCKS = ['<p>{30}</p>', '<p>{60}</p>', '<p>{15}', '<p><b>{20}<br>', '<p>{12} <a href="/l">{2}</a> {14}</p>', '<h2>{4}</h2>', '<h3>{3}</h3>', '<ul><li>{6}</li><li>{12}</li></ul>', '<ol><li>{9}<li>{4}</ol>', '<blockquote><p>{18}</p></blockquote>', '<table><tr><th>{1}</th><td>{2}</td></tr><tr><td>{3}</td><td>{1}</td></tr></table>', '<figure><figcaption>{8}</figcaption></figure>', '<pre>{10}</pre>', '<div>{25}</div>', '<section><h2>{3}</h2><p>{40}</p></section>', '<p>{3}</p>', '<p>{1}</p>', '<dl><dt>{2}</dt><dd>{10}</dd></dl>']
TITLES = ['<h1>{6}</h1>', '<h1 class="title headline">{9}</h1>', '<header><h1>{7}</h1></header>', '', '<h1>{3}</h1><p class="lead intro">{18}</p>']


def _words(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(max(1, round(n * rng.uniform(0.6, 1.5))))]
    return (" ".join(words).capitalize() + ".") if n >= 8 else " ".join(words)


def labelled_pages(n: int = 800, seed: int = 7) -> list[str]:
    rng, out = random.Random(seed), []
    pick = rng.choice
    for _ in range(n):
        bare, boxed = rng.random() < 0.3, rng.random() < 0.2  # blocks right under the page, blocks in boxes of their own
        parts = [pick(TITLES)]
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12))):
            parts.append(pick(BLOCKS))
        if boxed:
            parts = [f"<div>{x}</div>" if x else x for x in parts]
        if bare:
            parts = [re.sub(r"<(h1|h2|h3|p|ul|ol|dl|table|figure|pre|div|section|blockquote|header)\b", r"<\1 y=c", x, count=0 if x.count("<h1") else 1) for x in parts]
        with_guests = []
        for x in parts:
            with_guests.append(x)
            if rng.random() < 0.06:
                with_guests.append(pick(pick((ADS, ADS, SIDES, NOTICES, FORMS))))
        inner = "".join(with_guests)
        wrap = "{}" if bare else pick(WRAPS)
        if rng.random() < 0.15:
            inner += pick(COMMENTS)
        body = wrap.replace("{}", inner)
        before = [pick(x) for x in (NOTICES, HEADERS, MENUS, MENUS, ADS, FORMS, SIDES) if rng.random() < 0.4]
        after = [pick(x) for x in (SIDES, ADS, COMMENTS, FORMS, MENUS, NOTICES) if rng.random() < 0.35]
        if rng.random() < 0.85:
            after.append(pick(FOOTERS))
        if rng.random() < 0.3:
            for _ in range(rng.randint(1, 3)):
                body = f"<div y=m>{body}</div>"
        page = "".join([*before, body, *after])
        if rng.random() < 0.3:
            page = f'<div class="{pick(("page", "wrapper", "layout", "row"))}" y=m>{page}</div>'
        if rng.random() < 0.2:
            for _ in range(rng.randint(1, 4)):
                page = f"<div y=m>{page}</div>"
        html = f'<!DOCTYPE html><html lang="en" y=m><head y=b><meta charset="utf-8"><title>{{6}}</title><style>p{{}}</style><script>x("</p>")</script></head><body y=m>{page}</body></html>'
        if rng.random() < 0.2:  # fragments come without the outer elements, some as the article alone
            html = page if rng.random() < 0.5 else body
        out.append(re.sub(r"\{(\d+)\}", lambda m: _words(rng, int(m[1])), html))
    return out
