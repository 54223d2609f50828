"""Labelled pages from which ``html_extract`` learns.

Pages are put together by rule from parts that sites commonly have, in changing order
and nesting, with changing names; ``data-main`` marks what is content. Their words are
invented, so nothing can be learned from the words themselves.
"""

from __future__ import annotations

import random

PAGES, SEED = 260, 17


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    return [_page(random.Random(seed * 1000 + i)) for i in range(pages)]


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def _sentence(r: random.Random, low: int = 5, high: int = 22) -> str:
    words = _words(r, r.randint(low, high)).split()
    if len(words) > 8 and r.random() < 0.5:
        words[len(words) // 2] += ","
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "?", "!"])


def _prose(r: random.Random) -> str:
    text = " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
    if r.random() < 0.2:
        text += f' <a href="/x">{_words(r, 2)}</a> {_sentence(r)}'
    if r.random() < 0.15:
        text = f"<b>{_words(r, 3)}</b> {text}"
    return text


def _links(r: random.Random, n: int) -> str:
    items = "".join(f'<li><a href="/{_words(r, 1)}">{_words(r, r.choice([1, 1, 2, 5])).capitalize()}</a></li>' for _ in range(n))
    return f"<ul>{items}</ul>"


def _open(r: random.Random, tag: str, names: list[str], main: int, bare: float = 0.2) -> str:
    """A start tag, mostly with a class or id from ``names``."""
    where = "" if r.random() < bare else f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'
    return f'<{tag}{where} data-main="{main}">'


def _nav(r):
    tag = r.choice(["nav", "nav", "div"])
    return f'{_open(r, tag, ["nav", "main-menu", "navigation", "breadcrumb", "topnav"], 0, 0.5 if tag == "nav" else 0)}{_links(r, r.randint(3, 9))}</{tag}>'


def _header(r):
    tag = r.choice(["header", "div"])
    return f'{_open(r, tag, ["header", "site-header", "masthead", "top-banner"], 0, 0.5 if tag == "header" else 0)}<a href="/">{_words(r, 2)}</a><p>{_sentence(r, 3, 8)}</p>{_nav(r) if r.random() < 0.5 else ""}</{tag}>'


def _footer(r):
    tag = r.choice(["footer", "footer", "div"])
    line = r.choice(["&copy; 2020 ", "Copyright ", "&copy; ", ""]) + _words(r, 2) + r.choice([" &middot; ", ". "]) + _sentence(r)
    return f'{_open(r, tag, ["footer", "site-footer", "copyright", "legal"], 0, 0.6 if tag == "footer" else 0)}{r.choice([f"<p>{line}</p>", line])}{_links(r, 3) if r.random() < 0.3 else ""}</{tag}>'


def _aside(r):
    tag = r.choice(["aside", "aside", "div"])
    body = r.choice([_links(r, r.randint(2, 7)), f"<p>{_prose(r)}</p>", f"<h3>{_words(r, 2)}</h3>{_links(r, 4)}", f"<h3>{_words(r, 2)}</h3><p>{_prose(r)}</p>"])
    return f'{_open(r, tag, ["sidebar", "side", "widget", "related", "recommended", "more-stories", "popular"], 0, 0.5 if tag == "aside" else 0)}{body}</{tag}>'


def _advert(r):
    tag = r.choice(["div", "div", "section", "aside", "p"])
    inner = _prose(r)
    return f'{_open(r, tag, ["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"], 0, 0)}{inner if tag == "p" else r.choice([inner, f"<p>{inner}</p>"])}</{tag}>'


def _notice(r):
    inner = r.choice([f"<p>{_prose(r)}</p><button>{_words(r, 1)}</button>", _prose(r)])
    return f'{_open(r, "div", ["cookie-notice", "cookie-banner", "consent", "gdpr", "newsletter", "notice", "popup", "subscribe", "alert"], 0, 0)}{inner}</div>'


def _form(r):
    return f'<form{r.choice(["", " class=search", " id=contact-form"])} data-main="0"><label>{_words(r, 2)}</label><input name=q><select><option>{_words(r, 1)}<option>{_words(r, 1)}</select><button>{_words(r, 1)}</button>{r.choice(["", f"<p>{_sentence(r)}</p>"])}</form>'


def _share(r):
    return f'{_open(r, "div", ["share", "social-links", "tags", "post-meta"], 0, 0)}{r.choice([_links(r, 3), f"<a href=/s>{_words(r, 1)}</a> <a href=/t>{_words(r, 1)}</a>"])}</div>'


def _comments(r):
    tag = r.choice(["section", "div", "ol"])
    each = "li" if tag == "ol" else r.choice(["div", "article"])
    inner = "".join(f'<{each} class="{r.choice(["comment", "reply", "comment-body"])}">{r.choice([f"<p>{_prose(r)}</p>", f"<b>{_words(r, 2)}</b><p>{_prose(r)}</p>"])}</{each}>' for _ in range(r.randint(1, 6)))
    head = f"<h3>{_words(r, 2)}</h3>" if tag != "ol" and r.random() < 0.5 else ""
    return f'{_open(r, tag, ["comments", "discussion", "comment-list", "responses", "user-comments"], 0, 0)}{head}{inner}</{tag}>'


def _body(r) -> str:
    """An article's blocks, with some that are not content between and after them."""
    out = [f"<h1>{_words(r, r.randint(3, 9)).capitalize()}</h1>"] if r.random() < 0.85 else []
    if out and r.random() < 0.15:
        out[0] = f"<header>{out[0]}</header>"
    closed = r.random() < 0.7
    for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
        kind = r.random()
        if kind < 0.7:
            block = f"<p>{_prose(r)}" + ("</p>" if closed or r.random() < 0.5 else "")
        elif kind < 0.78:
            block = f"<h{r.choice('234')}>{_words(r, r.randint(1, 5)).capitalize()}</h2>".replace("</h2>", "") + "</h2>"
            block = block[:-1].replace("</h2", f"</h{block[2]}>")
        elif kind < 0.84:
            block = "<ul>" + "".join(f"<li>{_sentence(r)}" for _ in range(r.randint(2, 5))) + "</ul>"
        elif kind < 0.89:
            block = f"<blockquote>{r.choice([_prose(r), f'<p>{_prose(r)}</p>'])}</blockquote>"
        elif kind < 0.92:
            block = "<table>" + "".join(f"<tr><td>{_words(r, 2)}<td>{_words(r, 1)}" for _ in range(3)) + "</table>"
        elif kind < 0.95:
            block = f"<pre>{_words(r, 9)}</pre>"
        else:
            block = f'<p><b>{_sentence(r)}<br>'
        out.append(block)
        if r.random() < 0.12:
            out.append(r.choice([_advert, _aside, _share, _notice, _form])(r))
    if r.random() < 0.2:
        out.append(_share(r))
    if r.random() < 0.12:
        out.append(_comments(r))
    return "".join(out)


def _page(r: random.Random) -> str:
    shell = r.random()
    if shell < 0.55:
        main = f'{_open(r, "article", ["post", "article", "entry", "story"], 1, 0.6)}{_body(r)}</article>'
        if r.random() < 0.35:
            main = f"<main>{main}{_comments(r) if r.random() < 0.3 else ''}</main>"
    elif shell < 0.8:
        tag = r.choice(["main", "div", "div", "section"])
        main = f'{_open(r, tag, ["content", "main-content", "article-body", "entry-content", "post-text", "story"], 1, 0.3 if tag == "main" else 0)}{_body(r)}</{tag}>'
    else:
        main = f'<div class="{r.choice(["c1", "wrap", "x", "col"])}" data-main="1">{_body(r)}</div>'
    before = [f(r) for f in (_header, _nav, _notice, _advert, _form) if r.random() < 0.45]
    after = [f(r) for f in (_aside, _comments, _advert, _notice, _form) if r.random() < 0.35]
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < 0.25:
        before.append(after.pop()) if after else None
    inner = "".join(before) + main + "".join(after) + (_footer(r) if r.random() < 0.85 else "")
    if r.random() < 0.35:
        inner = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title></head><body>{inner}" + ("</body></html>" if r.random() < 0.9 else "")
