"""Labelled pages that the extraction model is trained from, written for this purpose: (html, texts of its content blocks).

They are made from a few layouts with invented words, so that the model learns from tags, names and shapes.
"""

from __future__ import annotations

import random


def _say(r: random.Random, n: int) -> str:
    words = [("".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 4)))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_say(r, 1)[:-1]}</a></li>' for i in range(n))


def _page(seed: int) -> tuple[str, list[str]]:
    """One page: the layout, its names and its noise follow from the seed."""
    r = random.Random(seed)
    title = _say(r, r.randint(3, 12))
    paragraphs = [_say(r, r.choice([4, 9, 20, 40, 90])) for _ in range(r.randint(1, 7))]
    bold = r.random() < 0.3
    body, kept = "", []
    heading = r.random() < 0.8
    if heading:
        body += f"<h1>{title}</h1>"
        kept.append(title)
    for i, p in enumerate(paragraphs):
        shape = r.random()
        if i and shape < 0.12:
            items = [_say(r, r.randint(2, 9)) for _ in range(3)]
            body += "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
            kept += items
        elif shape < 0.2:
            body += f"<blockquote><p>{p}</p></blockquote>"
            kept.append(p)
        elif shape < 0.28:
            sub = _say(r, 4)
            body += f"<h2>{sub}</h2><p>{p}</p>"
            kept += [sub, p]
        elif shape < 0.34:
            cells = [_say(r, 2) for _ in range(4)]
            body += "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>"
            kept += cells
        else:
            link = _say(r, 2)[:-1] if r.random() < 0.2 else ""
            body += f"<p>{'<b>' if bold and not i else ''}{p}{f' <a href=x>{link}</a>' if link else ''}{'' if r.random() < 0.1 else '</p>'}"
            kept.append(f"{p} {link}".strip())
    noise = {
        "ad": lambda: f'<div class="{r.choice(["ad", "ads", "advert", "sponsor promo", "banner"])}"><p>{_say(r, 12)}</p></div>' if r.random() < 0.5 else f'<div class="{r.choice(["ad", "ad-box", "advert"])}">{_say(r, 9)}</div>',
        "aside": lambda: f'<aside>{r.choice(["", "<h3>" + _say(r, 2) + "</h3>"])}<p>{_say(r, r.choice([8, 40]))}</p><ul>{_links(r, 4)}</ul></aside>',
        "sidebar": lambda: f'<div {r.choice(["class", "id"])}="{r.choice(["sidebar", "side", "widget", "related", "sidebar-right"])}"><h3>{_say(r, 2)}</h3><p>{_say(r, r.choice([6, 30]))}</p><ul>{_links(r, 3)}</ul></div>',
        "notice": lambda: f'<div class="{r.choice(["cookie-notice", "notice", "consent", "cookie", "alert", "popup", "modal"])}"><p>{_say(r, r.choice([10, 30]))}</p></div>',
        "dialog": lambda: f'<div role="dialog" class="popup">{_say(r, 12)}</div>',
        "comments": lambda: f'<{(t := r.choice(["div", "section"]))} {r.choice(["class", "id"])}="comments"><h2>{_say(r, 1)}</h2>'
        + "".join(f'<div class="comment"><p>{_say(r, r.choice([8, 30, 60]))}</p></div>' for _ in range(r.randint(1, 4)))
        + f"</{t}>",
        "form": lambda: f"<form><label>{_say(r, 2)}</label><input name=q><p>{_say(r, 8)}</p><button>{_say(r, 1)}</button></form>",
        "share": lambda: f'<div class="{r.choice(["share", "social", "tags", "breadcrumb"])}"><ul>{_links(r, 3)}</ul></div>',
        "newsletter": lambda: f'<div class="newsletter subscribe"><p>{_say(r, 14)}</p></div>',
    }
    pick = lambda p: "".join(noise[k]() for k in noise if r.random() < p)
    inner = pick(0.08)
    cut = r.random()
    body = inner + body if cut < 0.3 else body + inner
    main = r.choice(["<article>{}</article>"] * 4 + ["<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><div class="post entry">{}</div></div>', '<div class="article-body">{}</div>', "<div><article>{}</article></div>", "<section>{}</section>"])
    nav = f"<nav><ul>{_links(r, r.randint(3, 7))}</ul></nav>" if r.random() < 0.8 else f'<div class="{r.choice(["nav", "menu", "top-menu"])}"><ul>{_links(r, 5)}</ul></div>'
    header = "" if r.random() < 0.5 else f"<header><p>{_say(r, 5)}</p></header>" if r.random() < 0.6 else f'<div id="header"><h2>{_say(r, 3)}</h2></div>'
    footer = f"<footer>{r.choice(['&copy; ', ''])}{_say(r, r.choice([4, 20]))}</footer>" if r.random() < 0.8 else f'<div class="{r.choice(["footer", "copyright", "legal"])}"><p>{_say(r, 12)}</p></div>'
    before, after = pick(0.25), pick(0.3)
    page = f"<html><head><title>{title}</title><style>p{{}}</style></head><body>{header}{nav}{before}{main.format(body)}{after}{footer}</body></html>"
    return page, [" ".join(k.split()) for k in kept]


def _bare(seed: int) -> tuple[str, list[str]]:
    """A page whose text stands in its body itself, with little or nothing around."""
    r = random.Random(-1 - seed)
    kept = [_say(r, r.choice([2, 5])), *(_say(r, r.choice([6, 9, 20, 40])) for _ in range(r.randint(1, 5)))]
    tag = r.choice(["h1", "h2", "p"])
    body = (f"<{tag}>{kept[0]}</{tag}>" if r.random() < 0.7 else kept[0]) + "".join(f"<p>{k}</p>" for k in kept[1:])
    if r.random() < 0.2:
        kept, body = kept[:1], kept[0]
    before = f"<nav><ul>{_links(r, 4)}</ul></nav>" if r.random() < 0.4 else ""
    after = f"<footer><p>{_say(r, 5)}</p></footer>" if r.random() < 0.4 else ""
    return f"<html><body>{before}{body}{after}</body></html>", kept


PAGES = [_page(seed) for seed in range(120)] + [_bare(seed) for seed in range(24)]
