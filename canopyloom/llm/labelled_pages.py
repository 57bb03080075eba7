"""Labelled pages for training: written by a rule from page parts, with each content block marked by MARK.

Each part comes with several ways to write it, named after common practice, so that
the extractor learns from tags, class names, link density and text shape together.
"""

from __future__ import annotations

import random

MARK = "\ue000"
#: Words for texts; what they say doesn't matter, only that prose looks like prose.
WORDS = "the of and to in a that was for is on with as by at from river water light stone house green winter morning people city road small long early report market music history letter garden science number field result country village".split()


def sentence(r: random.Random, low: int = 5, high: int = 22) -> str:
    words = [r.choice(WORDS) for _ in range(r.randint(low, high))]
    if len(words) > 9 and r.random() < 0.5:
        words[r.randint(3, 6)] += ","
    return " ".join(words).capitalize() + r.choice("....?!")


def prose(r: random.Random, n: int) -> str:
    return " ".join(sentence(r) for _ in range(n))


def words(r: random.Random, low: int, high: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high)))


def open_tag(r: random.Random, names: str, tags: str = "div section", bare: float = 0.1) -> tuple[str, str]:
    """An element with one of the names as class or id, seldom without."""
    tag, name = r.choice(tags.split()), r.choice(names.split())
    how = r.random()
    if how < bare:
        return f"<{tag}>", f"</{tag}>"
    mark = f'class="{name}"' if how < 0.6 else f'id="{name}"' if how < 0.85 else f'class="box {name} {r.choice(["wide", "row", "block"])}"'
    return f"<{tag} {mark}>", f"</{tag}>"


def menu(r: random.Random) -> str:
    links = [f'<a href="/{i}">{words(r, 1, 3)}</a>' for i in range(r.randint(2, 9))]
    body = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.7 else " | ".join(links)
    a, b = ("<nav>", "</nav>") if r.random() < 0.5 else open_tag(r, "nav menu navbar main-nav topmenu breadcrumb breadcrumbs navigation toc", "div nav ul")
    return a + body + b


def header(r: random.Random) -> str:
    a, b = ("<header>", "</header>") if r.random() < 0.6 else open_tag(r, "header site-header masthead top banner page-header")
    return a + r.choice([f"<h1>{words(r, 1, 4)}</h1>", f"<p>{words(r, 2, 6)}</p>", f"<a href='/'>{words(r, 1, 2)}</a>", words(r, 1, 8)]) + (menu(r) if r.random() < 0.4 else "") + b


def footer(r: random.Random) -> str:
    a, b = ("<footer>", "</footer>") if r.random() < 0.7 else open_tag(r, "footer site-footer copyright bottom page-footer legal colophon")
    return a + r.choice([f"&copy; {words(r, 1, 2)} &middot; {sentence(r)}", f"<p>&copy; 2020 {words(r, 2, 5)}.</p>", prose(r, 1), f'<a href="/a">{words(r, 1, 2)}</a> <a href="/b">{words(r, 1, 2)}</a>', f"<p>{sentence(r)}</p>"]) + b


def advert(r: random.Random) -> str:
    a, b = open_tag(r, "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adbox ad-slot", "div div div aside section", 0)
    return a + r.choice([prose(r, 1), prose(r, 2), f"<p>{prose(r, 1)}</p>", f'<a href="/x">{words(r, 2, 7)}</a>', f"<p>{words(r, 2, 8)}</p>"]) + b


def sidebar(r: random.Random) -> str:
    a, b = ("<aside>", "</aside>") if r.random() < 0.5 else open_tag(r, "sidebar related widget side rail secondary recommended popular trending more-stories teaser", bare=0)
    items = "".join(f'<li><a href="/{i}">{words(r, 2, 7)}</a></li>' for i in range(r.randint(2, 6)))
    return a + r.choice([f"<h3>{words(r, 1, 3)}</h3><ul>{items}</ul>", f"<p>{prose(r, 1)}</p>", f"<h2>{words(r, 1, 3)}</h2><p>{prose(r, 2)}</p>"]) + b


def notice(r: random.Random) -> str:
    a, b = open_tag(r, "notice cookie cookies cookie-banner consent gdpr alert popup modal newsletter subscribe subscription paywall disclaimer message overlay toast", bare=0)
    return a + r.choice([prose(r, 1), f"<p>{prose(r, 2)}</p><button>{words(r, 1, 2)}</button>", f"<p>{sentence(r)} <a href='/p'>{words(r, 1, 2)}</a></p>"]) + b


def form(r: random.Random) -> str:
    fields = "".join(f"<label>{words(r, 1, 3)}</label><input name='f{i}'>" for i in range(r.randint(1, 4)))
    return f"<form action='/s'>{r.choice(['', f'<p>{sentence(r)}</p>', f'<h3>{words(r, 1, 4)}</h3>'])}{fields}<select><option>{words(r, 1, 2)}</option></select><button>{words(r, 1, 2)}</button></form>"


def share(r: random.Random) -> str:
    a, b = open_tag(r, "share social sharing tags meta byline author-box pagination pager follow tools", "div ul p", 0)
    return a + " ".join(f'<a href="#{i}">{words(r, 1, 2)}</a>' for i in range(r.randint(2, 5))) + b


def comments(r: random.Random) -> str:
    if r.random() < 0.3:
        items = "".join(f"<li><cite>{words(r, 1, 2)}</cite> <p>{prose(r, r.randint(1, 3))}</p></li>" for _ in range(r.randint(1, 4)))
        reply = f'<div id="{r.choice(["replyform", "respond", "commentform"])}"><h3>{words(r, 2, 3).capitalize()}</h3><form><textarea></textarea></form></div>'
        return f'<h3 id="comments">{r.randint(1, 40)} {words(r, 1, 2)}</h3><ol class="commentlist">{items}</ol>' + reply
    a, b = open_tag(r, "comments comment-list reader-comments replies discussion responses disqus respond comment-thread feedback", bare=0)
    one, two = r.choice([("<div class='comment'>", "</div>"), ("<li class='reply'>", "</li>"), ("<p>", "</p>"), ("<article class='comment'>", "</article>")])
    return a + r.choice([f"<h3>{words(r, 1, 3)}</h3>", ""]) + "".join(one + r.choice([prose(r, r.randint(1, 3)), f"<p>{prose(r, r.randint(1, 4))}</p>"]) + two for _ in range(r.randint(1, 4))) + b


def article(r: random.Random) -> str:
    """The content; every block of it is marked."""
    parts = []
    if r.random() < 0.8:
        parts.append(f"<h1>{MARK}{r.choice([words(r, 1, 8), sentence(r, 1, 12)])}</h1>")
    for _ in range(r.choice([1, 1, 2, 2, 3, 4, 5, 6, 7, 8])):
        kind = r.random()
        if r.random() < 0.1:
            parts.append(r.choice([
                f'<p><a href="/l">{MARK}{prose(r, r.randint(1, 2))}</a></p>',
                f"<dl><dt>{MARK}{words(r, 1, 2)}</dt><dd>{MARK}{sentence(r)}</dd><dt>{MARK}{words(r, 1, 2)}</dt><dd>{MARK}{prose(r, 2)}</dd></dl>",
                f"<pre><code>{MARK}{words(r, 1, 2)}({words(r, 1, 1)}) = {r.randint(0, 99)};</code></pre>",
                f"<p>{MARK}{rights(r)}</p>",
                f"<p>{MARK}All rights reserved.</p>",
                "".join(f"<section><h2>{MARK}{words(r, 1, 4)}</h2><p>{MARK}{prose(r, r.randint(1, 3))}</p></section>" for _ in range(r.randint(1, 3))),
                f"<table><tr><th>{MARK}{words(r, 1, 1)}</th><th>{MARK}{words(r, 1, 1)}</th></tr>" + "".join(f"<tr><td>{MARK}{words(r, 1, 2)}</td><td>{MARK}{r.randint(1, 99)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>",
                f"<figure><img src='i'><figcaption>{MARK}{sentence(r)}</figcaption></figure>",
                f"<p>{MARK}{prose(r, 1)} <a href='/r'>{sentence(r)}</a> {sentence(r)}</p>",
                "<ul>" + "".join(f'<li><a href="/{k}">{MARK}{sentence(r)}</a> {sentence(r)}</li>' for k in range(r.randint(2, 4))) + "</ul>",
            ]))
        text = MARK + r.choice([prose(r, 1), prose(r, r.randint(1, 6)), sentence(r, 1, 4), words(r, 1, 12), " | ".join(words(r, 1, 1) for _ in range(9)), " ".join(w + r.choice(["***", "$$$", "!!"]) for w in words(r, 4, 12).split())])
        if kind < 0.6:
            parts.append(f"<p>{text}</p>")
        elif kind < 0.7:
            parts.append(f"<p><b>{text}<br>")
        elif kind < 0.75:
            parts.append(f"<h2>{MARK}{words(r, 1, 6)}</h2>")
        elif kind < 0.8:
            parts.append("<ul>" + "".join(f"<li>{MARK}{sentence(r)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
        elif kind < 0.85:
            parts.append(f"<blockquote>{r.choice([text, f'<p>{text}</p>'])}</blockquote>")
        elif kind < 0.9:
            parts.append(f"<p>{text} <a href='/r'>{words(r, 1, 4)}</a> {sentence(r)}</p>")
        elif kind < 0.93:
            parts.append(f"<table><tr><td>{MARK}{words(r, 1, 4)}</td><td>{MARK}{words(r, 1, 3)}</td></tr></table>")
        elif kind < 0.96:
            parts.append(f"<pre>{text}</pre>")
        else:
            parts.append(f"<div>{text}</div>")
    for extra, share_of in ((advert, 0.2), (share, 0.2), (sidebar, 0.1), (notice, 0.08), (form, 0.06), (comments, 0.08)):
        if r.random() < share_of:
            parts.insert(r.randint(1, len(parts)), extra(r))
    if r.random() < 0.65:
        a, b = "<article>", "</article>"
        if r.random() < 0.4:
            own = r.choice(["", "", f" id='{r.choice(['m', 'main', 'top', 'x1'])}'", f" class='{words(r, 1, 1)}'"])
            a, b = r.choice([(f"<main{own}><article>", "</article></main>"), (f"<main{own}>", "</main>"), (f"<main{own}>", "</main>")])
    else:
        a, b = open_tag(r, "article content post entry-content main story article-body post-content text body-text question answer post-text maincontent", "div div main section", 0.05)
    if r.random() < 0.08:  # a container of sections
        parts = ["<section>" + "".join(parts) + "</section>"] + [f"<section><h2>{MARK}{words(r, 1, 4)}</h2><p>{MARK}{prose(r, r.randint(1, 4))}</p></section>" for _ in range(r.randint(1, 3))]
        a, b = r.choice([("<main>", "</main>"), ("<article>", "</article>"), ("<div id='content'>", "</div>")])
    return a + "".join(parts) + b


def body_parts(r: random.Random) -> str:
    """Content without a container of its own: headings and paragraphs, some unclosed as older pages have them."""
    out = [r.choice([f"<h1>{MARK}{words(r, 1, 6)}</h1>", f"<h2>{MARK}{words(r, 1, 6)}</h2>", f"<font size=5><b>{MARK}{words(r, 1, 6)}</b></font><br><br>"])]
    for _ in range(r.randint(2, 7)):
        end = r.choice(["</p>", "", "<br>"])
        out.append(r.choice([f"<p>{MARK}{prose(r, r.randint(1, 5))}{end}", f"<p>{MARK}{prose(r, 2)}{end}", f"<p>{MARK}{prose(r, 1)} <a href='/r'>{words(r, 1, 4)}</a> {prose(r, 1)}{end}"]))
    return "".join(out)


def links(r: random.Random, low: int = 2, high: int = 7) -> list[str]:
    return [f'<a href="/{i}">{words(r, 1, 3).capitalize()}</a>' for i in range(r.randint(low, high))]


def rights(r: random.Random) -> str:
    return r.choice(["Copyright 1999", "&copy; 2004", "(c) 2011", "Copyright &copy; 2016"]) + f" {words(r, 1, 3)}. " + r.choice(["All rights reserved.", "", sentence(r)])


def table_page(r: random.Random) -> str:
    """A layout by tables: links at the side, the text in a wide cell, rights below."""
    side = r.choice(["<br>", " ", "<p>"]).join(links(r))
    width = r.choice(["width=150", 'width="20%" valign=top', "bgcolor=#eeeeee"])
    cells = [f"<td {width}>{side}</td>", f"<td>{body_parts(r)}</td>"]
    if r.random() < 0.3:
        cells.append(f"<td {width}><b>{words(r, 1, 3)}</b><br>{r.choice([sentence(r), ' '.join(links(r, 1, 3))])}</td>")
    top = r.choice(["", f"<tr><td colspan=3>{words(r, 1, 4)}</td></tr>", f"<tr><td colspan=3><img src='l.gif'> {' | '.join(links(r))}</td></tr>"])
    return f"<table border=0>{top}<tr>{''.join(cells)}</tr><tr><td colspan=3>{r.choice(['<font size=1>', '<center>', ''])}{rights(r)}</td></tr></table>"


def grid_page(r: random.Random) -> str:
    """A layout by a grid's columns, whose names tell widths only."""
    wide, slim = r.choice([("col-md-8", "col-md-4"), ("col-sm-9", "col-sm-3"), ("grid_8", "grid_4"), ("large-8 columns", "large-4 columns"), ("u-2of3", "u-1of3")])
    boxes = [f"<h4>{words(r, 1, 3)}</h4><ul>{''.join(f'<li>{x}</li>' for x in links(r))}</ul>", f"<h4>{words(r, 1, 3)}</h4><p>{sentence(r)}</p><input><button>{words(r, 1, 2)}</button>", f"<div class='panel'><h4>{words(r, 2, 4)}</h4>{sentence(r)}</div>", f"<p>{sentence(r, 3, 9)} {r.choice(links(r, 1, 1))}</p>"]
    r.shuffle(boxes)
    columns = [f'<div class="{wide}">{body_parts(r)}</div>', f'<div class="{slim}">{"".join(boxes[: r.randint(1, 3)])}</div>']
    if r.random() < 0.25:
        columns.reverse()
    top = f'<div class="row"><div class="col-md-12">{" ".join(links(r))}</div></div>' if r.random() < 0.6 else ""
    return f'<div class="container">{top}<div class="row">{"".join(columns)}</div><div class="row"><div class="col-md-12"><p>{rights(r)}</p></div></div></div>'


def bare_page(r: random.Random) -> str:
    """Text straight in the body, with a line of links above or below."""
    row = r.choice(["<p>", "<div>", "<center>"]) + " | ".join(links(r)) + "</div>" * (r.random() < 0.3)
    return r.choice([row, ""]) + body_parts(r) + r.choice([f"<hr>{row}", ""]) + r.choice([f"<hr><address>{rights(r)}</address>", f"<p><small>{rights(r)}</small>", ""])


def page(r: random.Random) -> str:
    other = r.random()
    if other < 0.36:
        body = table_page(r) if other < 0.12 else grid_page(r) if other < 0.26 else bare_page(r)
        return f"<html><head><title>{words(r, 2, 6)}</title></head><body>{body}" + ("</body></html>" if r.random() < 0.8 else "")
    before = [f(r) for f, share_of in ((header, 0.5), (menu, 0.8), (advert, 0.5), (notice, 0.25), (form, 0.15), (share, 0.1)) if r.random() < share_of]
    after = [f(r) for f, share_of in ((share, 0.2), (sidebar, 0.4), (comments, 0.4), (advert, 0.3), (form, 0.2), (notice, 0.2), (menu, 0.15), (footer, 0.85)) if r.random() < share_of]
    r.shuffle(before)
    body = "".join(before) + article(r) + "".join(after)
    if r.random() < 0.15:
        a, b = open_tag(r, "page wrapper container layout site")
        body = a + body + b
    return f"<!DOCTYPE html><html><head><title>{words(r, 2, 6)}</title><script>var t='</p>';</script></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def pages(n: int = 700, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
