"""Labelled pages: invented articles within many kinds of page frame."""

from __future__ import annotations

import random

_SOUNDS = "an be co de el fi ga ha in jo ka li mo ne or pa qui ra se ti un ver wi xa yo zu th st ing ed er".split()


def _sentence(r: random.Random, least: int, most: int) -> str:
    words = ["".join(r.choice(_SOUNDS) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "!", "?"])


def _named(r: random.Random, tags: list[str], names: list[str], inner: str) -> str:
    tag = r.choice(tags)
    name = r.choice([*names, ""]) if tag != "div" else r.choice(names)
    attr = f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""
    return f"<{tag}{attr}>{inner}</{tag}>"


def _link(r: random.Random) -> str:
    return f'<a href="/{r.randint(1, 999)}">{_sentence(r, 1, 3)[:-1]}</a>'


def _links(r: random.Random) -> str:
    links = [_link(r) for _ in range(r.randint(2, 9))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.75 else " ".join(links)


def _frame(r: random.Random, part: str) -> str:
    short = _sentence(r, 2, 14)
    wrapped = short if r.random() < 0.5 else f"<p>{short}</p>"
    return {
        "nav": lambda: _named(r, ["nav", "nav", "div"], ["nav", "menu", "main-menu", "breadcrumbs", "pagination"], _links(r)),
        "header": lambda: _named(r, ["header", "div"], ["header", "site-header", "masthead"], wrapped + (_links(r) if r.random() < 0.4 else "")),
        "footer": lambda: _named(r, ["footer", "footer", "div"], ["footer", "site-footer", "copyright"], r.choice(["&copy; ", "Copyright 2020 ", ""]) + wrapped + (_links(r) if r.random() < 0.3 else "")),
        "ad": lambda: _named(r, ["div", "div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "ad-banner", "promo"], wrapped),
        "side": lambda: _named(r, ["aside", "aside", "div"], ["sidebar", "side", "related", "widget"], f"<h3>{_sentence(r, 1, 4)}</h3>" * (r.random() < 0.6) + (_links(r) if r.random() < 0.6 else f"<p>{_sentence(r, 4, 30)}</p>")),
        "notice": lambda: _named(r, ["div", "section"], ["cookie-notice", "cookie", "consent", "notice", "popup", "alert"], wrapped + "<button>Ok</button>" * (r.random() < 0.5)),
        "form": lambda: f"<form><label>{_sentence(r, 1, 3)}</label><input name=q><button>{_sentence(r, 1, 1)}</button><select><option>A<option>B</select></form>" if r.random() < 0.6 else _named(r, ["div"], ["newsletter", "subscribe", "share", "social"], wrapped),
        "comments": lambda: _named(r, ["section", "div"], ["comments", "comment-list", "respond"], "".join(f'<div class="comment"><p>{_sentence(r, 3, 40)}</p></div>' for _ in range(r.randint(1, 5)))),
    }[part]()


def labelled_page(r: random.Random) -> tuple[str, set[str]]:
    content: set[str] = set()

    def keep(text: str) -> str:
        content.add(text)
        return text

    title = keep(_sentence(r, 1, 12))
    parts = [f"<h1>{title}</h1>"]
    for _ in range(r.randint(1, 14)):
        text = keep(" ".join(_sentence(r, 1, 18) for _ in range(r.choice([1, 1, 2, 4, 8]))))
        kind = r.random()
        if kind < 0.62:
            parts.append(f"<p>{text}</p>")
        elif kind < 0.70:
            parts.append(f"<p><b>{text}<br>")  # left open, as happens
        elif kind < 0.76:
            parts.append(f"<h2>{text}</h2>")
        elif kind < 0.82:
            parts.append("<ul>" + "".join(f"<li>{keep(_sentence(r, 2, 12))}</li>" for _ in range(r.randint(1, 4))) + "</ul><p>" + text + "</p>")
        elif kind < 0.87:
            parts.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.91:
            parts.append(f"<table><tr><td>{keep(_sentence(r, 1, 4))}</td><td>{text}</td></tr></table>")
        elif kind < 0.95:
            parts.append(f"<div>{text}</div>")
        else:
            parts.append(f"<pre>{text}</pre>")
        if r.random() < 0.04:
            parts.append(_frame(r, r.choice(["ad", "form", "side"])))
    body = "".join(parts)
    shape = r.random()
    if shape < 0.55:
        body = f"<article>{body}</article>"
    elif shape < 0.7:
        body = f"<main><article>{body}</article></main>"
    elif shape < 0.8:
        body = f"<main>{body}</main>"
    else:
        body = f'<div {r.choice(["class", "id"])}="{r.choice(["content", "article", "post", "entry-content", "main", "story-body"])}">{body}</div>'
    before = [_frame(r, p) for p in ("notice", "header", "nav", "ad", "side", "form") if r.random() < 0.5]
    after = [_frame(r, p) for p in ("comments", "side", "ad", "nav", "form", "notice", "footer") if r.random() < 0.45]
    inner = "".join(before) + body + "".join(after)
    if r.random() < 0.25:
        inner = f'<div class="{r.choice(["wrapper", "container", "page"])}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{inner}</body></html>", content


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, set[str]]]:
    """``n`` pages, each with the texts of its content blocks."""
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(n)]
