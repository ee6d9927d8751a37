"""Labelled pages for the extractor's training, made from layout rules.

A page is a random choice of page furniture (menus, notices, adverts, forms, ...)
around an article, in markup styles found on the web; every block is made with its
label.  The words are random syllables, so nothing about a language can be learnt.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = "an ber cor da el fi gru ha in jo ka lo mi nu or pe qua ri so tu un ve wa xi yo zu é ü ñ".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, []

    def words(self, low: int, high: int, end: str = "") -> str:
        r = self.rng
        text = " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))
        return text.capitalize() + end

    def sentences(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.words(3, 14, self.rng.choice("...!?")) for _ in range(self.rng.randint(low, high)))

    def keep(self, text: str) -> str:
        self.main.append(text)
        return text

    def link_list(self, low: int, high: int) -> str:
        items = "".join(f'<li><a href="/{k}">{self.words(1, 4)}</a></li>' for k in range(self.rng.randint(low, high)))
        return f"<ul>{items}</ul>"

    def block(self, choices: str, inner: str) -> str:
        """``inner`` in one of the elements, written ``tag`` or ``tag.class``, ``tag#id``."""
        pick = self.rng.choice(choices.split())
        tag, sign, name = pick.partition("#" if "#" in pick else ".")
        attribute = {"": "", ".": f' class="{name.replace("+", " ")}"', "#": f' id="{name}"'}[sign]
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def styled(self, tag: str, inner: str) -> str:
        """A piece of the article, now and then with a class name for its look that also
        names page furniture."""
        if self.rng.random() < (0.12 if tag == "p" else 0.4 if tag == "div" else 0.05):
            name = self.rng.choice("more intro lead tags-intro top text-body note body-text side-note first related-text page-break wide".split())
            return f'<{tag} class="{name}">{inner}</{tag}>'
        return f"<{tag}>{inner}</{tag}>"

    def items(self, tag: str) -> str:
        return f"<{tag}>" + "".join(f"<li>{self.keep(self.words(2, 16))}</li>" for _ in range(self.rng.randint(2, 5))) + f"</{tag}>"

    def article(self) -> str:
        r, out = self.rng, []
        title = f"<h1>{self.keep(self.words(1, 12))}</h1>"
        out.append(f"<header>{title}</header>" if r.random() < 0.2 else title)
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.10:
                out.append(f"<p>{self.keep(self.words(1, 6, r.choice('...!?')))}</p>")
            elif x < 0.55:
                out.append(self.styled("p", self.keep(self.sentences())))
            elif x < 0.58:
                out.append(self.styled("div", self.keep(self.sentences())))
            elif x < 0.62:
                name = self.rng.choice("more intro tags-intro top-text note-body side-text related-intro row c1".split())
                out.append(f'<div class="{name}">' + "".join(f"<p>{self.keep(self.sentences())}</p>" for _ in range(r.randint(1, 2))) + "</div>")
            elif x < 0.69:
                out.append(self.styled(r.choice("h2 h2 h3 h3 h4".split()), self.keep(self.words(1, 6))))
            elif x < 0.73:
                out.append(f"<blockquote><p>{self.keep(self.sentences(1, 2))}</p></blockquote>")
            elif x < 0.79:
                out.append(self.items(r.choice(["ul", "ol", "ol"])))
            elif x < 0.81:
                out.append("<dl>" + "".join(f"<dt>{self.keep(self.words(1, 3))}</dt><dd>{self.keep(self.words(3, 14))}</dd>" for _ in range(r.randint(1, 3))) + "</dl>")
            elif x < 0.84:
                out.append(f'<figure><img src="x.png"><figcaption>{self.keep(self.words(2, 12, r.choice([".", ""])))}</figcaption></figure>')
            elif x < 0.88:
                out.append(f"<pre>{self.keep(self.words(3, 12))}</pre>")
            elif x < 0.91:
                out.append("<table><tr>" + "".join(f"<td>{self.keep(self.words(1, 3))}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(r.choice([self.advert, self.related, self.share, self.newsletter])())
        if r.random() < 0.2:
            out.append(self.comments())
        return "".join(out)

    def advert(self) -> str:
        inner = r if (r := self.sentences(1, 2)) and self.rng.random() < 0.5 else f"<p>{r}</p>"
        return self.block("div.ad div.ads div.advert div.advertisement aside.ad div#ad div.sponsored div.promo section.banner aside.promo div.ad-slot", inner)

    def menu(self) -> str:
        return self.block("nav nav div.menu div.navbar ul.nav div#navigation nav.breadcrumb div.breadcrumbs", self.link_list(3, 9))

    def site_header(self) -> str:
        inner = self.block("div.logo p h2 a", self.words(1, 4)) + (self.menu() if self.rng.random() < 0.5 else "")
        return self.block("header header div.header div#masthead header.site-header", inner + (f"<p>{self.sentences(1, 1)}</p>" if self.rng.random() < 0.3 else ""))

    def sidebar(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.rng.choice([self.link_list(2, 6), f"<p>{self.sentences(1, 3)}</p>"])
        return self.block("aside aside div.sidebar div#sidebar aside.widget div.side", inner)

    def notice(self) -> str:
        inner = f"<p>{self.sentences(1, 2)}</p>" + ("<button>" + self.words(1, 2) + "</button>" if self.rng.random() < 0.6 else "")
        return self.block("div.cookie-notice div#cookie-consent div.notice div.alert section.gdpr div.popup dialog div.cookies div.paywall", inner)

    def newsletter(self) -> str:
        inner = f"<label>{self.words(1, 5)}</label><p>{self.sentences(1, 1)}</p><input><button>{self.words(1, 2)}</button>"
        return self.block("form form div.newsletter form.subscribe form.search section.signup", inner)

    def related(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" + self.rng.choice([self.link_list(2, 5), f'<p><a href="/x">{self.words(3, 9)}</a></p>'])
        return self.block("div.related section.related aside.recommended div.more-stories div.popular section.teasers", inner)

    def share(self) -> str:
        return self.block("div.share div.social ul.share-buttons div.tags", "".join(f'<a href="#">{self.words(1, 2)}</a> ' for _ in range(3)))

    def comments(self) -> str:
        one = lambda: self.block("div.comment li.comment div.reply article.comment div.comment-body", f"<h4>{self.words(1, 2)}</h4><p>{self.sentences(1, 4)}</p>")
        inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 4)))
        return self.block("section.comments div#comments div.comments ol.comment-list section#comments div#disqus_thread", inner)

    def footer(self) -> str:
        inner = self.rng.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 1)}", f"<p>{self.sentences(1, 2)}</p>", self.link_list(2, 6)])
        return self.block("footer footer footer div.footer div#footer footer.site-footer", inner)

    def html(self) -> str:
        r = self.rng
        before = [f for f in (self.notice, self.site_header, self.menu, self.advert, self.newsletter, self.sidebar) if r.random() < 0.45]
        bare = r.random() < 0.15  # hardly anything but the article
        after = [] if bare else [f for f in (self.sidebar, self.related, self.comments, self.share, self.newsletter, self.advert, self.notice) if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        body = self.article() if r.random() < 0.96 else ""
        if body:
            plain = r.random()
            if plain < 0.12:
                pass  # straight in the body
            elif plain < 0.42:  # a container whose name says nothing
                made = "".join(r.choices(_SYLLABLES, k=2))
                body = self.block(f"div div div section div.wrap div.col-md-8 div.row div.inner div.{made} div.x{r.randint(1, 99)} div.l-{made}", body)
            else:
                body = self.block("article article article main main div.content div.post div#content div.entry-content div.article-body section.story div.main", body)
            if r.random() < 0.25:
                body = self.block("main div div.container div#page div.wrapper div.wrap div.row", body)
        tail = self.footer() if not bare and r.random() < 0.8 else ""
        return f"<html><body>{''.join(f() for f in before)}{body}{''.join(f() for f in after)}{tail}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> Iterator[tuple[str, frozenset[str]]]:
    """``n`` pages as (html, texts of the article's blocks)."""
    rng = random.Random(seed)
    for _ in range(n):
        page = _Page(rng)
        html = page.html()
        yield html, frozenset(page.main)
