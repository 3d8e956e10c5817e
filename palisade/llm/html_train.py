"""Trains the block labeller on generated pages: python -m palisade.llm.html_train writes html_weights.json beside it.

Every generated page knows which of its blocks belong to the article. Layouts, tags, class names, order and lengths vary; words
are made of random syllables, so that the network learns structure rather than a language.
"""

from __future__ import annotations

import json
import random
import sys
from pathlib import Path

import numpy as np

from palisade.llm.html_extract import WIDTH, blocks, features, reversed_each, scores, sigmoid

MARK = "\u2063"  # set before each block of the article, and taken off before the features are made


class Writer:
    """Makes one page."""

    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.syllables = ["".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouéäö") + rng.choice(["", "n", "r", "s"]) for _ in range(1)) for _ in range(40)]

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 3))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(2, 18).capitalize()
            if self.r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            out.append(s + self.r.choice("....!?"))
        return " ".join(out)

    def attribute(self, names: list[str], chance: float = 1.0) -> str:
        if self.r.random() > chance:
            return ""
        extra = self.r.choice(["", "", " " + self.words(1, 1), " col-" + str(self.r.randint(1, 12))])
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}{extra}"'

    def links(self, low: int, high: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></{tag}>' for _ in range(self.r.randint(low, high)))

    def nav(self) -> str:
        inner = self.r.choice([f"<ul>{self.links(2, 9)}</ul>", self.links(2, 9, "div"), self.links(2, 7, "span"), f"<ol>{self.links(1, 4)}</ol>"])
        return self.r.choice([f"<nav>{inner}</nav>", f"<nav{self.attribute(['nav', 'menu', 'navbar'])}>{inner}</nav>", f"<div{self.attribute(['menu', 'nav', 'navigation', 'breadcrumbs', 'pagination', 'topbar'])}>{inner}</div>", inner if "<ul>" in inner or "<ol>" in inner else f"<div>{inner}</div>"])

    def header(self) -> str:
        inner = f"<{self.r.choice(['h1', 'h2', 'div', 'p'])}>{self.words(1, 4)}" + self.r.choice(["", f"<p>{self.words(2, 8)}</p>", self.nav()])
        return self.r.choice([f"<header{self.attribute(['header', 'site-header', 'masthead'], 0.5)}>{inner}</header>", f"<div{self.attribute(['header', 'masthead', 'top', 'logo', 'site-header'])}>{inner}</div>"])

    def footer(self) -> str:
        line = self.r.choice(["&copy; ", "© ", "Copyright ", "", "(c) "]) + self.words(1, 3) + self.r.choice(["", " &middot; "]) + self.r.choice([self.words(1, 8), self.sentences(1, 3), ""])
        inner = self.r.choice([line, f"<p>{line}</p>", f"<p>{line}</p><ul>{self.links(1, 5)}</ul>", f"<div>{line}</div><p>{self.sentences(1, 2)}</p>"])
        return self.r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}", f"<footer{self.attribute(['footer', 'site-footer'])}>{inner}</footer>", f"<div{self.attribute(['footer', 'foot', 'copyright', 'colophon', 'legal'])}>{inner}</div>"])

    def advert(self) -> str:
        inner = self.r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f'<a href="x">{self.words(2, 9)}</a>'])
        return self.r.choice(["", f"<!-- ad {self.r.randint(0, 9)} -->"]) + f"<{(t := self.r.choice(['div', 'div', 'aside', 'section']))}{self.attribute(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'ad-slot', 'commercial'])}>{inner}</{t}>"

    def notice(self) -> str:
        inner = self.r.choice([f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 3)]) + self.r.choice(["", f"<button>{self.words(1, 2)}</button>"])
        return f"<{(t := self.r.choice(['div', 'section', 'aside']))}{self.attribute(['cookie', 'cookie-notice', 'cookie-banner', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal', 'site-message', 'privacy-notice'])}>{inner}</{t}>"

    def sidebar(self) -> str:
        inner = "".join(self.r.choice([f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 6)}</ul>", f"<p>{self.sentences(1, 3)}</p>", f"<div><h4>{self.words(1, 4)}</h4><p>{self.sentences(1, 2)}</p></div>"]) for _ in range(self.r.randint(1, 3)))
        return self.r.choice([f"<aside{self.attribute(['sidebar', 'related', 'widget'], 0.6)}>{inner}</aside>", f"<div{self.attribute(['sidebar', 'side', 'right', 'rail', 'widget', 'related', 'recommended', 'popular', 'teaser', 'side-bar'])}>{inner}</div>"])

    def form(self) -> str:
        inner = "".join(self.r.choice([f"<label>{self.words(1, 3)}</label><input>", f"<p>{self.sentences(1, 2)}</p>", f"<select><option>{self.words(1, 1)}<option>{self.words(1, 1)}</select>", f"<textarea>{self.words(1, 4)}</textarea>", f"<h3>{self.words(1, 4)}</h3>"]) for _ in range(self.r.randint(1, 4))) + f"<button>{self.words(1, 2)}</button>"
        return self.r.choice([f"<form{self.attribute(['search', 'login', 'newsletter', 'subscribe', 'contact'], 0.5)}>{inner}</form>", f"<div{self.attribute(['newsletter', 'subscribe', 'signup', 'login', 'search-form', 'register'])}>{inner}</div>"])

    def comments(self) -> str:
        one = lambda: self.r.choice([f"<p>{self.sentences(1, 4)}</p>", f"<div>{self.words(1, 2)}</div><p>{self.sentences(1, 3)}</p>", self.sentences(1, 3)])
        tag = self.r.choice(["div", "li", "article", "section"])
        inner = "".join(f"<{tag}{self.attribute(['comment', 'reply', 'comment-body', 'response'], 0.8)}>{one()}</{tag}>" for _ in range(self.r.randint(1, 6)))
        title = self.r.choice(["", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 2)}</h3>"])
        outer = self.r.choice(["div", "section", "ol" if tag == "li" else "div"])
        return f"<{outer}{self.attribute(['comments', 'comment-list', 'reader-comments', 'discussion', 'replies', 'disqus_thread', 'respond', 'user-comments'])}>{title}{inner}</{outer}>"

    def share(self) -> str:
        return f"<div{self.attribute(['share', 'social', 'social-share', 'follow-us'])}>{self.r.choice([self.links(2, 5, 'span'), '<ul>' + self.links(2, 5) + '</ul>', self.words(1, 4)])}</div>"

    def article(self) -> str:
        r = self.r

        def piece() -> str:
            k = r.random()
            if k < 0.62:
                s = self.sentences(1, 8)
                if r.random() < 0.2:
                    s = f"<b>{s}</b>" if r.random() < 0.5 else f"<b>{s}<br>"
                if r.random() < 0.15:
                    s += f' <a href="/x">{self.words(1, 3)}</a> {self.words(1, 5)}.'
                return f"<p>{MARK}{s}" + r.choice(["</p>", "</p>", ""])
            if k < 0.72:
                return f"<h{(n := r.randint(2, 4))}>{MARK}{self.words(1, 7)}</h{n}>"
            if k < 0.78:
                return "<ul>" + "".join(f"<li>{MARK}{r.choice([self.words(1, 6), self.sentences(1, 2)])}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if k < 0.83:
                return f"<blockquote><p>{MARK}{self.sentences(1, 3)}</p></blockquote>"
            if k < 0.87:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"
            if k < 0.9:
                return f"<pre>{MARK}{self.words(3, 20)}</pre>"
            if k < 0.93:
                return f"<figure><img src=x><figcaption>{MARK}{self.words(2, 9)}</figcaption></figure>"
            if k < 0.965:
                return r.choice([self.advert, self.advert, self.sidebar, self.share, self.form, self.notice, self.comments, self.nav])()
            return f"<div>{MARK}{self.sentences(1, 4)}</div>"

        title = r.choice(["", f"<h1>{MARK}{self.words(3, 12)}</h1>", f"<h1>{MARK}{self.sentences(1, 2)}</h1>", f"<h2>{MARK}{self.words(2, 9)}</h2>", f"<header><h1>{MARK}{self.words(2, 9)}</h1></header>"])
        body = title + "".join(piece() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 20])))
        if "<p>" not in body:
            body += f"<p>{MARK}{self.sentences(1, 3)}</p>"
        return r.choice([f"<article>{body}</article>", f"<article{self.attribute(['post', 'story', 'entry'])}>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div{self.attribute(['content', 'main', 'post', 'entry-content', 'article-body', 'main-content', 'story', 'text', 'article'])}>{body}</div>", f"<div>{body}</div>", f"<section>{body}</section>", body])

    def page(self) -> str:
        r = self.r
        plain = r.random() < 0.25
        if plain:
            before, after = [self.nav, self.advert], [self.footer]
        else:
            before = r.sample([self.notice, self.header, self.nav, self.advert, self.form, self.share, self.sidebar], r.randint(0, 4))
            after = r.sample([self.comments, self.sidebar, self.share, self.form, self.advert, self.notice, self.nav], r.randint(0, 4)) + r.choice([[self.footer], [self.footer], []])
        middle = self.article() if r.random() > 0.03 else ""
        wrap = r.choice(["{}", "{}", "{}", "<div>{}</div>", '<div class="wrapper">{}</div>', '<div id="page"><div class="row">{}</div></div>'])
        rest = [f() for f in after]
        if r.random() < 0.2:
            # One container holds the article and what stands beside it.
            k, (start, stop) = r.randint(0, len(rest)), r.choice([("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ("<section>", "</section>"), ('<div class="container content-area">', "</div>")])
            middle, rest = start + middle + "".join(rest[:k]) + stop, rest[k:]
        inside = "".join(f() for f in before) + middle + "".join(rest)
        return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{wrap.format(inside)}' + r.choice(["</body></html>", "</body></html>", ""])


def example(rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    page = blocks(Writer(rng).page(), {})
    y = np.array([MARK in b.text for b in page], np.float32)
    for b in page:
        b.text = b.text.replace(MARK, "") or "-"
    return features(page), y


def run_lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    size = u.shape[0]
    h = c = np.zeros((len(x), size))
    out, kept = [], []
    for t in range(x.shape[1]):
        z = x[:, t] @ w + b + h @ u
        i, f, o = (sigmoid(z[:, k * size : (k + 1) * size]) for k in range(3))
        g = np.tanh(z[:, 3 * size :])
        before, held = h, c
        c = f * c + i * g
        h = o * np.tanh(c)
        kept.append((before, held, i, f, o, g, c))
        out.append(h)
    return np.stack(out, 1), kept


def back_lstm(x: np.ndarray, u: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = u.shape[0]
    dw, du, db = np.zeros((x.shape[2], 4 * size)), np.zeros_like(u), np.zeros(4 * size)
    dh = dc = np.zeros((len(x), size))
    for t in range(x.shape[1] - 1, -1, -1):
        before, held, i, f, o, g, c = kept[t]
        dh = dh + dout[:, t]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * held * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw += x[:, t].T @ dz
        du += before.T @ dz
        db += dz.sum(0)
        dh, dc = dz @ u.T, dc * f
    return dw, du, db


def train(n_pages: int = 3600, epochs: int = 16, size: int = 16, seed: int = 7, batch: int = 48, rate: float = 0.008) -> dict[str, np.ndarray]:
    rng, py = np.random.default_rng(seed), random.Random(seed)
    data = sorted((e for e in (example(py) for _ in range(n_pages)) if len(e[1])), key=lambda e: len(e[1]))
    p = {}
    for d in "fb":
        p[f"w{d}"] = rng.normal(0, 0.15, (WIDTH, 4 * size))
        p[f"u{d}"] = rng.normal(0, 0.15, (size, 4 * size))
        p[f"b{d}"] = np.zeros(4 * size)
        p[f"b{d}"][size : 2 * size] = 1
    p["v"], p["c"] = rng.normal(0, 0.2, (2 * size, 1)), np.zeros(1)
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    starts = list(range(0, len(data), batch))
    for epoch in range(epochs):
        py.shuffle(starts)
        loss = 0.0
        for at in starts:
            own = data[at : at + batch]
            lengths = np.array([len(y) for _, y in own])
            x = np.zeros((len(own), lengths.max(), WIDTH))
            y, mask = np.zeros(x.shape[:2]), np.zeros(x.shape[:2])
            for k, (a, b) in enumerate(own):
                # Some words and classes are hidden, so that no single sign decides.
                x[k, : len(b)] = a * (rng.random(WIDTH) > 0.06)
                y[k, : len(b)], mask[k, : len(b)] = b, 1
            xr = reversed_each(x, lengths)
            hf, kf = run_lstm(x, p["wf"], p["uf"], p["bf"])
            hb, kb = run_lstm(xr, p["wb"], p["ub"], p["bb"])
            h = np.concatenate([hf, reversed_each(hb, lengths)], 2)
            q = sigmoid((h @ p["v"])[:, :, 0] + p["c"])
            dz = (q - y) * mask / mask.sum()
            loss -= float((mask * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum() / mask.sum())
            g = {"v": np.einsum("pts,pt->s", h, dz)[:, None], "c": np.array([dz.sum()])}
            dh = dz[:, :, None] * p["v"][None, None, :, 0]
            g["wf"], g["uf"], g["bf"] = back_lstm(x, p["uf"], kf, dh[:, :, :size])
            g["wb"], g["ub"], g["bb"] = back_lstm(xr, p["ub"], kb, reversed_each(dh[:, :, size:], lengths))
            step += 1
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            now = rate * min(1.0, 2 * (1 - epoch / epochs))
            for k, v in g.items():
                v = v * min(1.0, 1 / (norm + 1e-12)) + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        print(epoch, round(loss / len(starts), 4), file=sys.stderr, flush=True)
    return p


def accuracy(weights: dict[str, np.ndarray], n_pages: int = 400, seed: int = 99) -> tuple[float, float]:
    """Share of blocks, and of pages, that are labelled right, on pages of another seed."""
    py = random.Random(seed)
    data = [e for e in (example(py) for _ in range(n_pages)) if len(e[1])]
    found = scores([x for x, _ in data], {k: np.asarray(v, np.float32) for k, v in weights.items()})
    right = [(z > 0) == (y > 0) for z, (_, y) in zip(found, data, strict=True)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    found = train()
    print(accuracy(found), file=sys.stderr)
    Path(__file__).with_name("html_weights.json").write_text(json.dumps({k: np.round(v, 4).tolist() for k, v in found.items()}))
