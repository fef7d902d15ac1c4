"""Train the block labeller: python -m strandgraph.llm.train_blocks TEXTS.parquet OUT.npz

Pages are composed at random: texts of the given table (any with a column text) as paragraphs, headings and lists of the main
part, and the parts that surround it in all sorts of markup, inside the main part or around it. As the composer knows what it
put where, every block has its label.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from .block_labeller import HIDDEN, INPUT, PATH_SLOTS, WIDTH, WORD_SLOTS, numbers, sigmoid, slots
from .html_blocks import blocks

MARK = "\ue000"  # after each text that belongs to the main part


class Composer:
    def __init__(self, texts: list[str], seed: int):
        self.r = random.Random(seed)
        self.texts = [t.split() for t in texts]

    def words(self, low: int, high: int) -> str:
        words = self.r.choice(self.texts)
        n = self.r.randint(low, high)
        a = self.r.randint(0, max(0, len(words) - n))
        return " ".join(words[a : a + n]).replace("&", "&amp;").replace("<", "&lt;") or "x"

    def some(self, *choices: str) -> str:
        return self.r.choice(choices)

    def attr(self, *names: str) -> str:
        kind = self.some("class", "class", "id")
        extra = self.some("", "", "", " box", "-wrapper", " col-4", "-inner", " clearfix")
        return f' {kind}="{self.r.choice(names)}{extra}"'

    def neutral(self) -> str:
        return self.some("", "", "", ' class="row"', ' class="wrap"', ' id="c1"', ' class="container"', ' class="block"')

    def links(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        kind = self.some("ul", "ul", "plain", "div")
        anchors = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n)]
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{a}</li>" for a in anchors) + "</ul>"
        return self.some(" | ", " ", "\n").join(anchors) if kind == "plain" else "".join(f"<div>{a}</div>" for a in anchors)

    def around(self, kind: str) -> str:
        """A part that isn't main text."""
        r, w = self.r, self.words
        if kind == "nav":
            return self.some(f"<nav{self.some('', self.attr('menu', 'navbar', 'main-nav'))}>{self.links(2, 8)}</nav>", f"<div{self.attr('nav', 'menu', 'navigation', 'topbar', 'breadcrumb', 'breadcrumbs')}>{self.links(1, 8)}</div>")
        if kind == "header":
            inner = self.some(w(1, 6), f"<h1>{w(1, 4)}</h1>", f'<a href="/">{w(1, 3)}</a><p>{w(2, 10)}</p>', f"<p>{w(2, 12)}</p>{self.links(2, 6)}")
            return self.some(f"<header{self.some('', self.attr('header', 'site-header'))}>{inner}</header>", f"<div{self.attr('header', 'masthead', 'logo', 'site-title', 'banner')}>{inner}</div>")
        if kind == "footer":
            inner = self.some("&copy; ", "&copy; 2024 ", "Copyright ", "") + f"site.example.com {self.some('&middot;', '-', '|')} " + w(1, 25)
            inner = self.some(inner, f"<p>{inner}</p>", f"<p>{w(3, 40)}</p>{inner}", f"{self.links(2, 6)}<p>{inner}</p>")
            return self.some(f"<footer{self.some('', self.attr('footer', 'site-footer'))}>{inner}</footer>", f"<div{self.attr('footer', 'copyright', 'legal', 'imprint', 'colophon')}>{inner}</div>")
        if kind == "ad":
            inner = self.some(w(1, 30), f"<p>{w(3, 40)}</p>", f'<a href="/x">{w(2, 12)}</a>', f"<h3>{w(1, 4)}</h3><p>{w(3, 40)}</p>")
            return f"{self.some('', '<!-- ad 7 -->')}<{(t := self.some('div', 'div', 'div', 'aside', 'section', 'p'))}{self.attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'promotion', 'sponsor')}>{inner}</{t}>"
        if kind == "aside":
            inner = self.some(f"<h3>{w(1, 4)}</h3>{self.links(2, 7)}", f"<p>{w(4, 40)}</p>", f"<h2>{w(1, 4)}</h2><p>{w(4, 40)}</p><p>{w(4, 30)}</p>", w(2, 25))
            return self.some(f"<aside{self.some('', self.attr('sidebar', 'widget'))}>{inner}</aside>", f"<div{self.attr('sidebar', 'widget', 'side', 'related', 'recommended', 'popular', 'trending', 'read-more', 'sidebar-right')}>{inner}</div>")
        if kind == "notice":
            text = self.some("We use cookies to improve your experience. ", "This site uses cookies. ", "Please accept our privacy policy. ", "", "") + w(2, 30)
            inner = self.some(text, f"<p>{text}</p><button>{self.some('Accept', 'OK', 'Close', 'Agree')}</button>")
            return f"<{(t := self.some('div', 'div', 'section', 'aside', 'dialog'))}{self.attr('cookie', 'cookies', 'consent', 'notice', 'gdpr', 'cookie-banner', 'alert', 'popup', 'modal', 'overlay', 'paywall', 'message')}>{inner}</{t}>"
        if kind == "form":
            label = self.some("Subscribe to our newsletter", "Email", "Search", "Sign up", "Log in", "Name") + self.some("", " " + w(1, 8))
            inner = self.some(f'<label>{label}</label><input type="text"><button>{self.some("Send", "Go", "Subscribe", w(1, 2))}</button>', f'<p>{w(2, 20)}</p><input name="q"><button>{w(1, 2)}</button>', f"<fieldset><legend>{label}</legend><p>{w(2, 15)}</p></fieldset>")
            return self.some(f"<form{self.some('', self.attr('search', 'newsletter', 'signup', 'login'))}>{inner}</form>", f"<div{self.attr('newsletter', 'subscribe', 'signup', 'search')}><form action='/s'>{inner}</form></div>")
        if kind == "comments":
            one = lambda: self.some(f"<div{self.attr('comment')}><p>{w(3, 60)}</p></div>", f"<li{self.attr('comment')}><b>{w(1, 2)}</b> {w(3, 60)}</li>", f"<article{self.attr('comment')}><p>{w(3, 60)}</p></article>", f"<p>{w(3, 60)}</p>")
            inner = self.some("", f"<h2>{self.some('Comments', 'Discussion', 'Responses', w(1, 3))}</h2>", f"<h3>{r.randint(1, 40)} comments</h3>") + "".join(one() for _ in range(r.randint(1, 6)))
            return f"<{(t := self.some('div', 'section', 'section', 'ul', 'aside'))}{self.attr('comments', 'comment-list', 'discussion', 'responses', 'reader-comments', 'disqus', 'replies')}>{inner}</{t}>"
        if kind == "noscript":
            inner = self.some("Please enable JavaScript to see this page. ", "This site needs JavaScript. ", "") + w(1, 20)
            return f"<noscript>{self.some(inner, f'<p>{inner}</p>', f'<div>{inner}</div>')}</noscript>"
        inner = self.some(f"<a href='/s'>{w(1, 2)}</a> <a href='/t'>{w(1, 2)}</a>", w(1, 6), self.links(2, 5))
        return f"<div{self.attr('share', 'social', 'meta', 'tags', 'byline-links', 'pagination', 'pager', 'toolbar', 'author-box')}>{inner}</div>"

    def paragraph(self) -> str:
        text = self.words(1, self.some(1, 6, 30, 120, 300)) + self.some("", "", "", "", "!", "!!", "?") + MARK
        if self.r.random() < 0.25:
            text = self.some(f"<b>{text}</b>", f"<b>{text}<br>", f"<em>{self.words(1, 3)}</em> {text}", f'{self.words(1, 9)} <a href="/l">{self.words(1, 4)}</a> {text}', f"{self.words(1, 30)}<br>{text}", f"<span>{text}</span>")
        return text

    def main(self) -> list[str]:
        r, out = self.r, []
        for _ in range(r.randint(60, 250) if r.random() < 0.001 else self.some(r.randint(1, 3), r.randint(2, 8), r.randint(4, 25))):
            x = r.random()
            if x < 0.78:
                out.append(f"<p>{self.paragraph()}{self.some('</p>', '</p>', '</p>', '</p>', '')}")
            elif x < 0.86:
                out.append(f"<h{(k := r.randint(2, 4))}>{self.words(1, 8)}{MARK}</h{k}>")
            elif x < 0.92:
                out.append("<ul>" + "".join(f"<li>{self.paragraph()}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.95:
                out.append(f"<blockquote>{self.some('<p>', '')}{self.paragraph()}</blockquote>")
            elif x < 0.97:
                out.append(f"<div>{self.paragraph()}</div>")
            else:
                out.append(f"<table><tr><td>{self.words(1, 4)}{MARK}</td><td>{self.words(1, 4)}{MARK}</td></tr></table>")
        return out

    def page(self) -> str:
        r = self.r
        kinds = ["nav", "header", "footer", "ad", "aside", "notice", "form", "comments", "other", "noscript"]
        body = self.main()
        heading = f"<h1>{self.words(1, 14)}{MARK}</h1>" if r.random() < 0.85 else ""
        for kind in ("ad", "aside", "form", "other", "notice", "comments", "nav", "noscript"):
            if r.random() < 0.1:
                body.insert(len(body) if kind == "comments" else r.randint(0, len(body)), self.around(kind))
        inner = self.some("{}", "{}", "{}", "<div>{}</div>", "<section>{}</section>").replace("{}", "".join(body))
        shape = self.some("article", "article", "article", "main", "mainarticle", "div", "div", "bare")
        if shape == "bare":
            inside = heading + inner
        elif shape == "mainarticle":
            inside = f"<main{self.neutral()}><article{self.neutral()}>{heading}{inner}</article></main>"
        elif shape == "div":
            name = self.attr("content", "post", "entry", "article", "article-body", "story", "main", "post-content", "text", "body-text", "entry-content")
            inside = f"<div{name}>{heading}{inner}</div>"
        else:
            inside = f"<{shape}{self.some('', '', self.neutral())}>{heading}{inner}</{shape}>"
        before = [self.around(k) for k in kinds if k != "footer" and k != "comments" and r.random() < (0.6 if k in ("nav", "header") else 0.2)]
        after = [self.around(k) for k in kinds if k not in ("nav", "header", "footer") and r.random() < 0.22]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(self.around("footer"))
        whole = "".join(before) + inside + "".join(after)
        whole = self.some(whole, whole, f"<div{self.neutral()}>{whole}</div>")
        end = self.some("</body></html>", "</body></html>", "")
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{whole}{end}"


def examples(composer: Composer, n: int) -> list[tuple[list, np.ndarray, np.ndarray]]:
    out = []
    while len(out) < n:
        page = blocks(composer.page())
        if page:
            y = np.array([MARK in b.text for b in page], float)
            for b in page:
                b.text = b.text.replace(MARK, "") or "x"
            out.append(([slots(b) for b in page], numbers(page), y))
    return out


def fresh(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {"path": r.normal(0, 0.3, (PATH_SLOTS, WIDTH)), "word": r.normal(0, 0.1, (WORD_SLOTS, WIDTH)), "o": np.zeros(())}
    for k in "fb":
        w |= {f"w{k}": r.normal(0, 0.2, (INPUT, 4 * HIDDEN)), f"u{k}": r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"b{k}": np.zeros(4 * HIDDEN), f"o{k}": r.normal(0, 0.2, HIDDEN)}
        w[f"b{k}"][HIDDEN : 2 * HIDDEN] = 1
    return w | {"oi": np.zeros(INPUT)}


def _forward(x, w, u, b, mask):
    steps, batch, _ = x.shape
    h, c, kept = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN)), []
    for t in range(steps):
        a = x[t] @ w + b + h @ u
        i, f, o, g = sigmoid(a[:, :HIDDEN]), sigmoid(a[:, HIDDEN : 2 * HIDDEN]), sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        was_h, was_c = h, c
        c = m * (f * c + i * g) + (1 - m) * c
        h = m * o * np.tanh(c) + (1 - m) * h
        kept.append((i, f, o, g, np.tanh(c), was_h, was_c, m))
    return kept


def _backward(x, w, u, kept, grad):
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), np.empty_like(x)
    dh, dc = np.zeros_like(kept[0][5]), np.zeros_like(kept[0][6])
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, g, tc, was_h, was_c, m = kept[t]
        dh = dh + grad[t]
        own_c = m * (dc + dh * o * (1 - tc**2))
        da = np.concatenate([own_c * g * i * (1 - i), own_c * was_c * f * (1 - f), m * dh * tc * o * (1 - o), own_c * i * (1 - g**2)], axis=1)
        dw += x[t].T @ da
        du += was_h.T @ da
        db += da.sum(axis=0)
        dx[t] = da @ w.T
        dc = own_c * f + (1 - m) * dc
        dh = da @ u.T + (1 - m) * dh
    return dw, du, db, dx


def step(batch, w) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of a batch of examples."""
    steps, n = max(len(e[2]) for e in batch), len(batch)
    x, y, mask = np.zeros((steps, n, INPUT)), np.zeros((steps, n)), np.zeros((steps, n))
    for c, (_, nums, label) in enumerate(batch):
        x[: len(label), c, 2 * WIDTH :], y[: len(label), c], mask[: len(label), c] = nums, label, 1
    places = np.array([(t, c) for c, e in enumerate(batch) for t in range(len(e[2]))]).T
    listed = {}
    for k, name in enumerate(("path", "word")):
        lists = [own[k] for e in batch for own in e[0]]
        sizes = np.array([len(own) for own in lists])
        listed[name] = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes), sizes
        means = np.add.reduceat(w[name][listed[name][0]], np.cumsum(sizes) - sizes) / sizes[:, None]
        x[places[0], places[1], k * WIDTH : (k + 1) * WIDTH] = means
    back = x[::-1]
    kf, kb = _forward(x, w["wf"], w["uf"], w["bf"], mask), _forward(back, w["wb"], w["ub"], w["bb"], mask[::-1])
    hidden = lambda kept: np.stack([k[7] * k[2] * k[4] for k in kept])
    hf, hb = hidden(kf), hidden(kb)[::-1]
    p = sigmoid(hf @ w["of"] + hb @ w["ob"] + x @ w["oi"] + w["o"])
    loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / mask.sum()
    d = mask * (p - y) / mask.sum()
    g = {"of": np.einsum("tb,tbh->h", d, hf), "ob": np.einsum("tb,tbh->h", d, hb), "oi": np.einsum("tb,tbh->h", d, x), "o": d.sum()}
    g["wf"], g["uf"], g["bf"], dxf = _backward(x, w["wf"], w["uf"], kf, d[:, :, None] * w["of"])
    g["wb"], g["ub"], g["bb"], dxb = _backward(back, w["wb"], w["ub"], kb, (d[:, :, None] * w["ob"])[::-1])
    dx = dxf + dxb[::-1] + d[:, :, None] * w["oi"]
    for k, (name, (at, of, sizes)) in enumerate(listed.items()):
        own = (dx[places[0], places[1], k * WIDTH : (k + 1) * WIDTH] / sizes[:, None])[of]
        g[name] = np.stack([np.bincount(at, own[:, c], len(w[name])) for c in range(WIDTH)], axis=1)
    return loss, g


def train(texts: list[str], seed: int = 3, rounds: int = 1500, batch: int = 24, rate: float = 0.006) -> dict[str, np.ndarray]:
    composer, w = Composer(texts, seed), fresh(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    running = 1.0
    for k in range(1, rounds + 1):
        loss, g = step(examples(composer, batch), w)
        norm = np.sqrt(sum((x**2).sum() for x in g.values()))
        own = rate * (1 - k / rounds) + rate / 50
        for name in w:
            x = g[name] * min(1, 1 / (norm + 1e-9))
            m[name], v[name] = 0.9 * m[name] + 0.1 * x, 0.999 * v[name] + 0.001 * x**2
            w[name] = w[name] - own * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)
        w["word"] *= 0.9995
        running = 0.98 * running + 0.02 * loss
        if k % 100 == 0:
            print(k, round(running, 4), flush=True)
    return w


def accuracy(w: dict[str, np.ndarray], pages: list) -> float:
    from .block_labeller import scores

    xs = []
    for names, nums, _ in pages:
        x = np.empty((len(names), INPUT))
        for t, (p, q) in enumerate(names):
            x[t, :WIDTH], x[t, WIDTH : 2 * WIDTH] = w["path"][p].mean(axis=0), w["word"][q].mean(axis=0)
        x[:, 2 * WIDTH :] = nums
        xs.append(x)
    right = [(s >= 0.5) == (e[2] > 0.5) for s, e in zip(scores(xs, w), pages)]
    return float(np.concatenate(right).mean())


def main(source: str, out: str) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(source, columns=["text"])["text"].to_pylist() if t and len(t) > 200][:4000]
    w = train(texts)
    print("accuracy on fresh pages", accuracy(w, examples(Composer(texts, 99), 300)))
    np.savez_compressed(out, **{k: x.astype(np.float16) for k, x in w.items()})


if __name__ == "__main__":
    main(*sys.argv[1:3])
