"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is a chain of blocks, each content or not. The score of a labelling is the sum of weights of the features of the
content blocks (ancestor tags, words of their class, id and role, and shape of the text) and of transition weights; weights are learned by
stochastic gradient ascent of the conditional likelihood of labelled pages, and pages are decoded by Viterbi.
The labelled pages are drawn by rule from page layouts (`labelled_pages`), as the tables hold no labels; no page of the input is learned from.

Odd input: a null or empty page, and one without content, has the empty text; broken markup is read as far as it goes; repeated rows
each get their result; an empty table gives an empty result; columns other than page_id, url and html are never read. A tie goes to
content. Nothing of a content block is dropped or cut.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow
from quillspark.llm.html_blocks import Block, blocks


def text_features(b: Block) -> list[str]:
    """Shape of a block's text."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    found = ["bias", f"words:{min(7, int(math.log2(words)))}", f"links:{min(4, 5 * b.linked // max(n, 1))}"]
    if b.text[-1] in ".!?:;\"'»”…)":
        found.append("ends")
    if b.text[0] in "©" or "©" in b.text or "(c)" in b.text[:8].lower():
        found.append("rights")
    return found


def features(b: Block) -> list[str]:
    found = text_features(b)
    for e in b.path:
        found += e
    last = b.path[-1][0] if b.path else ""
    found.append(f"leaf:{next((x for x in b.path[-1] if x.startswith('in:')), last)}" if b.path else "leaf:none")
    return found


@dataclass
class Chain:
    """Two states; `weights` belong to content, `step[a][b]` to a transition, `start` to the first block's content."""

    weights: dict[str, float] = field(default_factory=dict)
    step: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    start: float = 0.0

    def emit(self, found: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in found)

    def viterbi(self, scores: list[float]) -> list[bool]:
        if not scores:
            return []
        (a00, a01), (a10, a11) = self.step
        zero, one = 0.0, self.start + scores[0]
        back: list[tuple[int, int]] = []
        for s in scores[1:]:
            to0 = 0 if zero + a00 > one + a10 else 1
            to1 = 0 if zero + a01 > one + a11 else 1
            zero, one = (zero + a00 if to0 == 0 else one + a10), (zero + a01 if to1 == 0 else one + a11) + s
            back.append((to0, to1))
        state = 0 if zero > one else 1
        path = [state]
        for choice in reversed(back):
            state = choice[state]
            path.append(state)
        return [bool(x) for x in reversed(path)]

    def marginals(self, scores: list[float]) -> tuple[list[float], list[list[float]], float]:
        """P(content) of every block, expected transitions, log of the normaliser."""
        ex = [[math.exp(x) for x in row] for row in self.step]
        n = len(scores)
        fwd, scale = [], []
        a0, a1 = 1.0, math.exp(min(30.0, self.start + scores[0]))
        log_z = 0.0
        for k in range(n):
            if k:
                e = math.exp(max(-30.0, min(30.0, scores[k])))
                a0, a1 = a0 * ex[0][0] + a1 * ex[1][0], (a0 * ex[0][1] + a1 * ex[1][1]) * e
            z = a0 + a1
            a0, a1 = a0 / z, a1 / z
            fwd.append((a0, a1))
            scale.append(z)
            log_z += math.log(z)
        b0 = b1 = 1.0
        content = [0.0] * n
        pairs = [[0.0, 0.0], [0.0, 0.0]]
        for k in range(n - 1, -1, -1):
            content[k] = fwd[k][1] * b1 / (fwd[k][0] * b0 + fwd[k][1] * b1)
            if k:
                e = math.exp(max(-30.0, min(30.0, scores[k])))
                p = [[fwd[k - 1][x] * ex[x][y] * (e * b1 if y else b0) for y in (0, 1)] for x in (0, 1)]
                z = sum(map(sum, p))
                for x in (0, 1):
                    for y in (0, 1):
                        pairs[x][y] += p[x][y] / z
                b0, b1 = (ex[0][0] * b0 + ex[0][1] * b1 * e) / scale[k], (ex[1][0] * b0 + ex[1][1] * b1 * e) / scale[k]
        return content, pairs, log_z


def fit(pages: list[tuple[list[list[str]], list[bool]]], passes: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Chain:
    """Maximise the conditional likelihood by AdaGrad, page by page."""
    chain, order = Chain(), random.Random(seed)
    seen: dict = {}
    pages = [p for p in pages if p[0]]

    def move(key, value: float, gradient: float) -> float:
        seen[key] = seen.get(key, 1e-6) + gradient * gradient
        return value + rate * (gradient - decay * value) / math.sqrt(seen[key])

    for _ in range(passes):
        order.shuffle(pages)
        for found, truth in pages:
            content, pairs, _ = chain.marginals([chain.emit(f) for f in found])
            gradient: dict[str, float] = {}
            for f, p, y in zip(found, content, truth):
                if abs(y - p) > 1e-4:
                    for x in f:
                        gradient[x] = gradient.get(x, 0.0) + (y - p)
            for x, g in gradient.items():
                chain.weights[x] = move(x, chain.weights.get(x, 0.0), g)
            chain.start = move("start", chain.start, truth[0] - content[0])
            real = [[0, 0], [0, 0]]
            for x, y in zip(truth, truth[1:]):
                real[x][y] += 1
            for x in (0, 1):
                for y in (0, 1):
                    chain.step[x][y] = move((x, y), chain.step[x][y], real[x][y] - pairs[x][y])
    return chain


class Maker:
    """Draws labelled pages: layouts of content and of everything around it. Content is marked by a control character, which
    is taken out again before features are made."""

    MARK = "\x01"

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        word = lambda: "".join(r.choice("aeiou") + r.choice("bdfglmnprst") for _ in range(r.randint(1, 4)))
        out = [word() for _ in range(r.randint(low, high))]
        for k in range(3, len(out) - 1, r.randint(5, 12)):
            out[k] += r.choice([",", ".", ".", ","])
        return " ".join(out)

    def sentence(self, low: int = 4, high: int = 80) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def named(self, tag: str, names: list[str], body: str, plain: float = 0.0) -> str:
        r = self.r
        if r.random() < plain:
            return f"<{tag}>{body}</{tag}>"
        name = r.choice(names)
        if r.random() < 0.3:
            name = f"{name}-{r.choice(['box', 'wrap', 'area', 'inner', 'list', 'main', 'block'])}"
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{body}</{tag}>'

    def links(self, low: int = 2, high: int = 8) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(self.r.randint(low, high))]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "<div>" + " ".join(items) + "</div>"])()

    def prose(self, low: int, high: int) -> str:
        return "".join(f"<p>{self.sentence()}</p>" for _ in range(self.r.randint(low, high)))

    def loose(self) -> str:
        """A short text, sentence-like or not, in a paragraph or not."""
        return self.r.choice([self.sentence(3, 25), f"<p>{self.sentence(3, 40)}</p>", self.words(1, 4), f"<span>{self.sentence(5, 15)}</span>"])

    def around(self) -> str:
        """Something that is not content."""
        r = self.r
        return r.choice([
            lambda: self.named("nav", ["nav", "menu", "navigation", "navbar", "breadcrumb", "toc"], self.links(), 0.5),
            lambda: self.named("div", ["menu", "nav", "navbar", "topnav", "breadcrumbs", "pagination", "pager", "tags", "links"], self.links()),
            lambda: self.named("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sponsor"], self.loose()),
            lambda: self.named("aside", ["sidebar", "related", "widget", "recommended", "popular", "ad"], r.choice([self.links, self.loose])() + r.choice(["", self.prose(1, 2)]), 0.5),
            lambda: self.named("div", ["sidebar", "related", "widget", "recommended", "rail", "trending"], r.choice([self.links, self.loose])() + r.choice(["", self.prose(1, 2)])),
            lambda: self.named("div", ["cookie", "cookies", "consent", "notice", "gdpr", "alert", "modal", "popup", "paywall", "message"], f"<p>{self.sentence(5, 30)}</p>"),
            lambda: f'<div role="{r.choice(["alert", "dialog", "banner", "navigation", "search", "complementary", "contentinfo"])}">{self.loose()}</div>',
            lambda: self.named("form", ["search", "newsletter", "subscribe", "signup", "login", "contact"], f"<label>{self.words(1, 4)}</label><p>{self.sentence(3, 20)}</p><input name=q><button>{self.words(1, 2)}</button>", 0.5),
            lambda: self.named("div", ["newsletter", "subscribe", "signup", "login", "search"], self.loose()),
            lambda: self.named("div", ["share", "social", "sharing", "follow", "buttons", "meta"], self.links(1, 4)),
        ])()

    def comments(self) -> str:
        r = self.r
        one = lambda: self.named("div", ["comment", "reply", "response", "review"], f"<h4>{self.words(1, 2)}</h4>{self.prose(1, 2)}")
        listed = "".join(one() for _ in range(r.randint(1, 4)))
        return self.named(r.choice(["section", "div", "ol"]), ["comments", "comment", "discussion", "responses", "disqus", "respond"], f"<h3>{self.words(1, 3)}</h3>{listed}")

    def content(self) -> str:
        r, m = self.r, self.MARK

        def mark(x: str) -> str:
            if r.random() < 0.15:  # odd texts are content too
                x = r.choice([x.replace(" ", " | "), x.replace(" ", "*** "), x.upper(), " ".join([x.split(" ")[0]] * r.randint(1, 40)), x.replace(" ", "&amp; "), f"&copy; {x}"])
            return m + x

        out = [f"<h1>{mark(self.sentence(2, 12))}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(r.randint(1, 10)):
            out.append(
                r.choice([
                    *[lambda: f"<p>{mark(self.sentence(1, 90))}</p>"] * 7,
                    lambda: f"<h2>{mark(self.words(1, 8))}</h2>",
                    lambda: "<ul>" + "".join(f"<li>{mark(self.sentence(1, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>",
                    lambda: f"<blockquote><p>{mark(self.sentence())}</p></blockquote>",
                    lambda: f"<pre>{mark(self.words(2, 20))}</pre>",
                    lambda: f"<figure><img src=x><figcaption>{mark(self.sentence(2, 15))}</figcaption></figure>",
                    lambda: "<table><tr>" + "".join(f"<td>{mark(self.words(1, 4))}</td>" for _ in range(r.randint(1, 4))) + "</tr></table>",
                    lambda: f"<div>{mark(self.sentence(3, 60))}</div>",
                    lambda: f'<p>{mark(self.sentence(2, 20))} <a href="/x">{self.words(1, 8)}</a> {self.words(1, 20)}.</p>',
                ])()
            )
            if r.random() < 0.08:
                out.append(self.around())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        body = self.content()
        inner = r.choice([
            *[lambda: f"<article>{body}</article>"] * 3,
            lambda: f"<main>{body}</main>",
            lambda: f"<main><article>{body}</article></main>",
            lambda: self.named("article", ["post", "entry", "story", "article"], body),
            lambda: self.named("div", ["content", "article", "post", "entry", "story", "body", "text", "main"], body),
            lambda: f'<div role="main">{body}</div>',
            lambda: f"<section>{body}</section>",
        ])()
        if r.random() < 0.25:
            inner += self.comments()
        elif r.random() < 0.1 and inner.endswith("</article>"):
            inner = inner[: -len("</article>")] + self.comments() + "</article>"
        if r.random() < 0.3:
            inner = f'<div {r.choice(["class", "id"])}="{r.choice(["page", "wrapper", "container", "site", "layout"])}">{inner}</div>'
        top = [self.around() for _ in range(r.randint(0, 3))]
        low = [self.around() for _ in range(r.randint(0, 3))]
        if r.random() < 0.5:
            top.insert(0, self.named("header", ["header", "masthead", "top", "site"], r.choice([self.links, self.loose])(), 0.5))
        if r.random() < 0.7:
            foot = r.choice([lambda: f"&copy; {self.words(1, 3)} &middot; {self.sentence(3, 30)}", lambda: f"<p>&copy; {self.words(2, 9)}</p>", self.links, self.loose])()
            low.append(self.named(r.choice(["footer", "footer", "div"]), ["footer", "bottom", "copyright", "legal"], foot) if r.random() < 0.5 else f"<footer>{foot}</footer>")
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{''.join(top)}{inner}{''.join(low)}</body></html>"

    def labelled(self) -> tuple[list[list[str]], list[bool]]:
        found = blocks(self.page())
        truth = [self.MARK in b.text for b in found]
        clean = [b._replace(text=b.text.replace(self.MARK, "").strip() or "x") for b in found]
        return [features(b) for b in clean], truth


def labelled_pages(number: int = 1200, seed: int = 11) -> list[tuple[list[list[str]], list[bool]]]:
    maker = Maker(seed)
    return [maker.labelled() for _ in range(number)]


@lru_cache(maxsize=1)
def model() -> Chain:
    """The chain, learned once a process."""
    return fit(labelled_pages())


def extract_text(page: str | None, chain: Chain) -> str:
    """The main text of a page."""
    found = blocks(page)
    keep = chain.viterbi([chain.emit(features(b)) for b in found])
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def html_extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or model())

    def extract(batches):
        c = shared.value
        for b in batches:
            found = [extract_text(x, c) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {x: pages.schema[x].dataType.simpleString() for x in ("page_id", "url")}
    return map_arrow(pages.select("page_id", "url", "html"), extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
