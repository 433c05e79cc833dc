"""Labelled pages to fit the page model to: usual layouts, with the article's blocks marked.

``data-content="1"`` marks an element whose text is content, ``"0"`` one inside of it whose text
isn't. The layouts are hand-written; words, lengths and numbers of blocks vary by a seed.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo en ar ul is om et".split()

# {s}: a sentence, {p}: paragraphs, {w}: a few words, {n}: list items with links, {c}: reader comments.
LAYOUTS = [
    '<html><head><title>{w}</title></head><body><nav><ul>{n}</ul></nav><div class="ad">{s}</div><article data-content="1">'
    '<h1>{w}</h1>{p}</article><footer>&copy; {w} &middot; {s}</footer></body></html>',
    '<html><body><header><h1>{w}</h1><nav><a href="/">{w}</a> <a href="/a">{w}</a></nav></header><main><article data-content="1">'
    '<h1>{s}</h1>{p}<h2>{w}</h2>{p}</article></main><aside><h3>{w}</h3><ul>{n}</ul></aside><footer><p>{s}</p><ul>{n}</ul></footer></body></html>',
    '<html><body><div id="header"><div class="menu"><ul>{n}</ul></div></div><div id="content"><div class="post" data-content="1">'
    '<h2>{w}</h2><div class="entry">{p}<ul><li>{s}</li><li>{w}</li><li>{s}</li></ul>{p}</div></div></div><div id="sidebar"><div class="widget">'
    '<h3>{w}</h3><p>{s}</p></div></div><div id="footer">{s}</div></body></html>',
    '<html><body><div class="cookie-notice"><p>{s} {s}</p><button>{w}</button></div><div class="container"><article data-content="1">'
    '<header><h1>{w}</h1></header>{p}<blockquote><p>{s}</p></blockquote>{p}<div class="share" data-content="0"><a href="#">{w}</a></div></article>'
    '<section class="comments"><h3>{w}</h3>{c}</section></div><footer>{w}</footer></body></html>',
    '<html><body><nav>{w} <a href="/x">{w}</a></nav><main data-content="1"><h1>{w}</h1>{p}<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td>'
    '<td>{s}</td></tr></table>{p}<aside data-content="0"><p>{s}</p><ul>{n}</ul></aside>{p}</main><form action="/s"><label>{w}</label><p>{s}</p>'
    '<button>{w}</button></form><footer><p>{s}</p></footer></body></html>',
    '<html><body><table><tr><td class="nav"><ul>{n}</ul></td><td data-content="1"><h1>{w}</h1>{p}</td><td class="ads"><p>{s}</p></td></tr></table>'
    '<div class="copyright">{s}</div></body></html>',
    '<html><body><div class="topbar"><a href="/">{w}</a></div><div class="story" data-content="1"><h1>{w}</h1><p>{s}</p>{p}<figure><figcaption>{s}'
    '</figcaption></figure>{p}<pre>{s}</pre></div><div class="related"><h3>{w}</h3><ul>{n}</ul></div><div id="comments">{c}</div>'
    '<div class="newsletter"><p>{s}</p></div></body></html>',
    '<html><body><header><p>{s}</p></header><section><div data-content="1"><h1>{w}</h1>{p}</div></section><section class="promo"><p>{s}</p><p>{s}</p>'
    '</section><div role="dialog"><p>{s}</p></div><div role="contentinfo">{s}</div></body></html>',
    '<html><body><ul class="breadcrumb">{n}</ul><article data-content="1"><h1>{w}</h1>{p}<div class="advertisement" data-content="0"><p>{s}</p></div>'
    '{p}<div class="comments" data-content="0"><h4>{w}</h4>{c}</div></article><div class="sidebar"><p>{s}</p><p>{s} {s}</p></div></body></html>',
    '<html><body><div id="menu">{w} | {w} | {w}</div><div id="main" data-content="1"><p><b>{s}<br><p>{s}</p>{p}</div><div class="banner">{s}</div>'
    '<form><p>{s}</p><input name="q"></form><div id="bottom"><a href="/l">{w}</a> <a href="/p">{w}</a></div></body></html>',
    '<html><body><nav><ul>{n}</ul></nav><article data-content="1"><h1>{w}</h1><p>{w}</p><p>{w}</p></article><footer><p>{s}</p><p>{s}</p></footer></body></html>',
    '<html><body><nav><ul>{n}</ul></nav><div class="notice">{s}</div><article data-content="1"><p>{s}</p><p>{w}</p><h2>{w}</h2>{p}<ol><li>{w}</li><li>{w}'
    '</li></ol></article><aside class="sidebar"><p>{s} {s} {s}</p></aside><section id="discussion">{c}{c}</section><footer>{s} {s}</footer></body></html>',
    '<html><body><nav><ul>{n}</ul></nav><footer>{s}</footer></body></html>',
]


def pages(each: int = 12, seed: int = 7) -> list[str]:
    """``each`` pages of every layout."""
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))

    def fill(layout):
        parts = layout.split("{")
        out = [parts[0]]
        for part in parts[1:]:
            key, rest = part[0], part[2:]
            sentence = lambda: words(rng.randint(4, 25)).capitalize() + rng.choice(".?!...")
            text = {
                "s": lambda: " ".join(sentence() for _ in range(rng.randint(1, 3))),
                "w": lambda: words(rng.randint(1, 5)),
                "p": lambda: "".join(f"<p>{' '.join(sentence() for _ in range(rng.choice((0, 1, 2, 4, 9))))}{words(rng.randint(0, 3))}</p>"
                                     for _ in range(rng.randint(1, 6))),
                "n": lambda: "".join(f'<li><a href="/{i}">{words(rng.randint(1, 3))}</a></li>' for i in range(rng.randint(2, 9))),
                "c": lambda: "".join(f'<div class="comment"><b>{words(1)}</b><p>{sentence()} {sentence()}</p><a href="#">{words(1)}</a></div>'
                                     for _ in range(rng.randint(1, 5))),
            }[key]()
            out += [text, rest]
        return "".join(out)

    return [fill(layout) for layout in LAYOUTS for _ in range(each)]
