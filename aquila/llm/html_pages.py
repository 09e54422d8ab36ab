"""Labelled pages to train html_extraction.py on: random layouts of articles among menus, adverts, notices, comments and
the like. data-y marks an element and what it holds as content (1) or not (0)."""

from __future__ import annotations

import random

LETTERS = "etaoinshrdlucmfwypvbgk"


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice(LETTERS) for _ in range(self.r.randint(1, 9))) for _ in range(400)]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 2, high: int = 22) -> str:
        words = self.some(low, high).split(" ")
        if self.r.random() < 0.06:  # symbols, capitals and lists also occur in articles
            words = [w + self.r.choice(["***", "###", "&amp;&amp;", "!!", " |"]) for w in words]
        elif self.r.random() < 0.04:
            words = [w.upper() + "!!" for w in words]
        else:
            words = [w + ("," if self.r.random() < 0.08 else "") for w in words]
        text = " ".join(words)
        return text[:1].upper() + text[1:] + ("." if self.r.random() < 0.92 else "")

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{text}</a>'

    def name(self, *names: str) -> str:
        """class or id of one of the names, or of nothing that tells."""
        word = self.r.choice(names)
        word = self.r.choice([word, word, f"{word}-{self.r.choice(['box', 'wrap', 'area', 'inner', '1'])}", f"{self.r.choice(['site', 'page', 'js', 'c'])}-{word}"])
        return self.r.choice([f' class="{word}"', f' class="{word}"', f' id="{word}"', f' class="x{self.r.randint(1, 99)} {word}"'])

    def paragraph(self) -> str:
        text = self.sentences(1, self.r.choice([1, 1, 2, 5, 9]))
        if self.r.random() < 0.12:
            text = self.some(1, 2).capitalize() + "."
        if self.r.random() < 0.1:
            text += " " + self.link(self.some(1, 3)) + " " + self.sentence()
        if self.r.random() < 0.15:
            return f"<p><b>{text}<br>"
        if self.r.random() < 0.1:
            text = f"<{(t := self.r.choice(['b', 'em', 'span', 'strong']))}>{text}</{t}>"
        return f"<p>{text}</p>" if self.r.random() < 0.93 else f"<p>{text}"

    def block(self) -> str:
        k = self.r.random()
        if k < 0.80:
            return self.paragraph()
        if k < 0.87:
            return f"<h{(n := self.r.choice('2234'))}>{self.some(1, 8)}</h{n}>"
        if k < 0.91:
            return "<ul>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if k < 0.94:
            return f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>"
        if k < 0.96:
            return f"<pre>{self.some(5, 30)}</pre>"
        if k < 0.98:
            return "<table>" + "".join(f"<tr><td>{self.some(1, 4)}</td><td>{self.some(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><figcaption>{self.sentence()}</figcaption></figure>"

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link(self.some(1, 3))}</li>" for _ in range(self.r.randint(low, high))) + "</ul>"

    def noise(self) -> str:
        """Something that is not content."""
        r, k = self.r, self.r.randrange(11)
        y = ' data-y="0"'
        if k == 0:
            return f"<nav{y}>{self.links(3, 8)}</nav>" if r.random() < 0.6 else f"<div{self.name('nav', 'menu', 'navbar', 'breadcrumb')}{y}>{self.links(2, 8) if r.random() < 0.6 else self.link(self.some(1, 2)) + ' ' + self.link(self.some(1, 2))}</div>"
        if k in (1, 2):
            inside = r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", self.link(self.sentence())])
            return f"<{(t := r.choice(['div', 'div', 'aside', 'section']))}{self.name('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'advertisement')}{y}>{inside}</{t}>"
        if k == 3:
            inside = r.choice([f"<p>{self.sentences(1, 4)}</p>", self.sentences(1, 3)]) + (r.choice(["<button>Ok</button>", self.link("ok")]) if r.random() < 0.7 else "")
            return f"<{(t := r.choice(['div', 'section', 'aside']))}{self.name('cookie', 'notice', 'consent', 'alert', 'gdpr', 'popup')}{y}>{inside}</{t}>"
        if k == 4:
            inside = f"<h{(n := r.choice('234'))}>{self.some(1, 3)}</h{n}>" + r.choice([self.links(3, 7), f"<p>{self.sentences(1, 3)}</p>", self.links(2, 4) + f"<p>{self.sentence()}</p>"])
            return r.choice([f"<aside{y}>{inside}</aside>", f"<aside{self.name('sidebar', 'related', 'widget')}{y}>{inside}</aside>", f"<div{self.name('sidebar', 'related', 'widget', 'popular', 'rail')}{y}>{inside}</div>"])
        if k in (5, 6):
            one = lambda: r.choice([f"<div{self.name('comment', 'reply')}><p>{self.sentences(1, 4)}</p></div>", f"<p>{self.sentences(1, 3)}</p>", f"<li><b>{self.some(1, 2)}</b> <p>{self.sentences(1, 4)}</p></li>"])
            inside = (f"<h3>{self.some(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5)))
            return f"<{(t := r.choice(['section', 'div', 'ol', 'aside']))}{self.name('comments', 'comment-list', 'discussion', 'replies', 'respond', 'reader-comments')}{y}>{inside}</{t}>"
        if k == 7:
            inside = f"<label>{self.some(1, 4)}</label><input><p>{self.sentence()}</p>" if r.random() < 0.7 else f"<p>{self.sentences(1, 2)}</p><input>"
            return f"<form{self.name('search', 'newsletter', 'signup', 'login') if r.random() < 0.6 else ''}{y}>{inside}</form>"
        if k == 8:
            return f"<div{self.name('share', 'social', 'newsletter', 'subscribe', 'tags')}{y}>{r.choice([self.links(2, 5), self.sentence(), self.link(self.some(1, 2))])}</div>"
        if k == 9:
            return f"<script>var t='<p>{self.some(1, 4)}</p>';</script><style>p{{margin:0}}</style><!-- {self.some(1, 5)} -->"
        return f"<p{self.name('copyright', 'legal', 'disclaimer', 'tagline', 'advert')}{y}>{self.sentences(1, 2)}</p>"

    def article(self) -> str:
        r = self.r
        head = f"<h1>{self.some(1, 12)}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        blocks = [self.block() for _ in range(r.choice([1, 2, 4, 8, 12]))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), self.noise())
        inside = head + "".join(blocks)
        for _ in range(r.choice([0, 0, 1])):
            inside = f"<div{self.name('content', 'text', 'body', 'inner') if r.random() < 0.6 else ''}>{inside}</div>"
        kind = r.random()
        if kind < 0.6:
            return f'<article data-y="1">{inside}</article>'
        if kind < 0.75:
            return f'<main data-y="1">{inside}</main>'
        return f'<div{self.name("content", "article", "post", "entry", "story", "main") if r.random() < 0.8 else ""} data-y="1">{inside}</div>'

    def page(self) -> str:
        r = self.r
        y = ' data-y="0"'
        before, after = [self.noise() for _ in range(r.randint(0, 3))], [self.noise() for _ in range(r.randint(0, 4))]
        if r.random() < 0.6:
            before.insert(0, f"<nav{y}>{self.links(3, 8)}</nav>")
        if r.random() < 0.4:
            title = r.choice([f"<h1>{self.some(1, 3)}</h1>", f"<p>{self.sentence(2, 8)}</p>", f"<div{self.name('logo', 'brand')}>{self.link(self.some(1, 2))}</div>", self.sentence(2, 8)])
            before.insert(0, r.choice([f"<header{y}>{title}</header>", f"<div{self.name('header', 'masthead', 'top')}{y}>{title}</div>"]))
        if r.random() < 0.7:
            last = r.choice([f"&copy; {self.some(1, 2)} &middot; {self.sentences(1, 2)}", f"<p>{self.sentences(1, 2)}</p>", self.links(2, 5), f"&copy; {self.some(1, 3)}"])
            after.append(r.choice([f"<footer{y}>{last}</footer>", f"<footer{y}>{last}</footer>", f"<div{self.name('footer', 'copyright', 'legal')}{y}>{last}</div>"]))
        inside = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.3:
            inside = f"<div{self.name('page', 'wrapper', 'container') if r.random() < 0.7 else ''}>{inside}</div>"
        text = f"<!DOCTYPE html><html><head><title>{self.some(1, 6)}</title></head><body>{inside}</body></html>"
        if r.random() < 0.1:
            text = text[: r.randint(len(text) // 2, len(text))]
        return text


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    return [Writer(seed * 1_000_003 + i).page() for i in range(n)]
