"""Main text of HTML pages by a recurrent block labeller in numpy.

A page becomes its sequence of text blocks (leaves of block-level elements), each with its tag path (element names and their class and
id words), link share and text. A block's input is a learned vector of its path, one of its hashed words, and a few numbers. A bidirectional
LSTM reads the whole sequence in both directions, so each block is classified with the whole page in view; blocks
labelled as content, in page order, are the main text.

No table labels blocks. The network learns from a bounded sample of pages whose blocks are labelled by what their markup states (inside an
article or main element, not inside menus, footers, asides, forms, or parts named as adverts, comments and the like), and from
variants of these pages: containers renamed to plain divisions with telling classes, and sidebars, notices, forms, comments added.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.sample import fitted

PATHS, WORDS, PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 1024, 512, 16, 6, 8, 16
PART = 2 << 20
SAMPLE, SAMPLE_BYTES, SAMPLE_BLOCKS = 240, 48 << 20, 400  # pages of a fit, their bytes together, and blocks of a page
# fixed values: elements of HTML
_RAW = frozenset("script style noscript template svg math iframe object textarea title canvas audio video select datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_MARK = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_AWAY_TAGS = frozenset("nav footer aside form button menu dialog fieldset header".split())
_AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsored sponsor promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar widget "
    "comment comments disqus reply replies respond cookie cookies consent notice alert warning popup modal newsletter subscribe signup login share sharing social related recommended".split()
)
_HERE_NAMES = frozenset("article content main post entry story".split())


def _element(name: str, attributes: str) -> tuple[str, ...]:
    """An element's name and the words of its class, id and role."""
    if not attributes or "=" not in attributes:
        return (name,)
    found = [w for m in _NAMES.finditer(attributes) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())]
    return (name, *dict.fromkeys(found))


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of linked characters) of each text block in page order; text has single spaces and decoded references."""
    out: list = []
    stack: list[tuple[str, ...]] = []
    parts: list[str] = []
    linked, in_link, at, low = 0, 0, 0, None

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((tuple(stack), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def take(piece: str):
        nonlocal linked
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    while True:
        m = _MARK.search(page, at)
        if m is None:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in _INLINE:
                in_link -= in_link > 0 and name == "a"
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    in_link = 0
                    break
            continue
        if name in _RAW:
            if not m[3].endswith("/"):
                low = low if low is not None else page.lower()
                end = low.find(f"</{name}", at) if len(low) == len(page) else next((x.start() for x in re.finditer(f"(?i)</{name}", page[at:])), -2 - at) + at
                at = len(page) if end < at else end
            continue
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
            in_link += name == "a"
            continue
        flush()
        if stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"))):
            stack.pop()
            in_link = 0
        if name not in _VOID and not m[3].endswith("/"):
            stack.append(_element(name, m[3]))
    flush()
    return out


def stated(path: tuple) -> bool:
    """What the markup says of a block: content or not."""
    here = False
    for tag, *names in path:
        if tag in _AWAY_TAGS and not (tag == "header" and here) or _AWAY_NAMES & set(names) and not (_HERE_NAMES & set(names) and tag in ("article", "main")):
            return False
        here = here or tag in ("article", "main") or bool(_HERE_NAMES & set(names))
    return here


_crc: dict[str, int] = {}


def _code(name: str) -> int:
    if len(_crc) > 50_000:
        _crc.clear()
    if name not in _crc:
        _crc[name] = zlib.crc32(name.encode()) % PATHS
    return _crc[name]


def inputs(pages: list[list]) -> dict:
    """Flat arrays for the blocks of several pages: path codes, word codes and numbers."""
    paths, path_of, numbers = [], [], []
    for page in pages:
        n = len(page)
        for i, (path, text, link) in enumerate(page):
            codes = {_code(name if k == 0 else f".{name}") for element in path for k, name in enumerate(element)}
            codes.add(_code(f">{path[-1][0]}" if path else ">"))
            path_of.append(len(codes))
            paths.extend(codes)
            size = len(text)
            numbers.append((np.log1p(size) / 5, link, text.count(" ") / size, text.count(".") * 10 / size, text.count(",") * 10 / size, i / n, len(path) / 8, 1.0))
    data, offs = W.utf8(pa.array([b[1] for page in pages for b in page], pa.string()))
    starts, ends, doc = W.spans(data, offs, W.ALNUM)
    words = (W.word_hashes(W.LOWER[data], starts, ends) % np.uint64(WORDS)).astype(np.int64)
    return {
        "path": np.array(paths, np.int64), "path_of": np.repeat(np.arange(len(path_of)), path_of), "words": words, "words_of": doc,
        "numbers": np.array(numbers, np.float32).reshape(-1, NUMBERS), "sizes": np.array([len(p) for p in pages], np.int64),
    }


def _mean(table: np.ndarray, codes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.maximum(np.bincount(of, minlength=n), 1).astype(np.float32)
    rows = table[codes]
    out = np.stack([np.bincount(of, weights=rows[:, k], minlength=n) for k in range(table.shape[1])], axis=1).astype(np.float32)
    return out / count[:, None], count


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block numbers by page and step, the same from the end, and which steps exist."""
    longest = int(sizes.max(initial=0))
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    step = np.arange(longest)[None]
    there = step < sizes[:, None]
    return np.where(there, first[:, None] + step, 0), np.where(there, first[:, None] + sizes[:, None] - 1 - step, 0), there


def _run(x: np.ndarray, there: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """One direction: states pages x steps x HIDDEN (and what the gradient needs)."""
    n, steps = there.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, saved = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = x[:, t] @ w + h @ u + b
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN] + 1), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = there[:, t, None]
        c2 = f * c + i * g
        th = np.tanh(c2)
        if keep:
            saved.append((h, c, i, f, o, g, th, m))
        h, c = np.where(m, o * th, h), np.where(m, c2, c)
        out[:, t] = h
    return out, saved


def _back(x, saved, dh_out, w, u):
    """Gradients of one direction: of w, u, b and of the inputs."""
    gw, gu, gb, gx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32), np.zeros_like(x)
    dh, dc = np.zeros_like(saved[0][0]), np.zeros_like(saved[0][0])
    for t in range(len(saved) - 1, -1, -1):
        h, c, i, f, o, g, th, m = saved[t]
        d = dh + dh_out[:, t]
        dt = np.where(m, d, 0)
        dct = np.where(m, dt * o * (1 - th * th) + dc, 0)
        dz = np.concatenate((dct * g * i * (1 - i), dct * c * f * (1 - f), dt * th * o * (1 - o), dct * i * (1 - g * g)), axis=1)
        gw += x[:, t].T @ dz
        gu += h.T @ dz
        gb += dz.sum(0)
        gx[:, t] = dz @ w.T
        dh = np.where(m, dz @ u.T, dh + dh_out[:, t])
        dc = np.where(m, dct * f, dc)
    return gw, gu, gb, gx


def _embed(data: dict, model: dict):
    n = len(data["numbers"])
    p, pc = _mean(model["paths"], data["path"], data["path_of"], n)
    q, qc = _mean(model["words"], data["words"], data["words_of"], n)
    return np.concatenate((p, q, data["numbers"]), axis=1), pc, qc


def predict(pages: list[list], model: dict) -> list[np.ndarray]:
    """For each page: is each of its blocks content?"""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    for k in range(0, len(order), 128):
        pick = order[k : k + 128]
        data = inputs([pages[i] for i in pick])
        x, _, _ = _embed(data, model)
        fwd, bwd, there = _layout(data["sizes"])
        a, _ = _run(x[fwd], there, model["wf"], model["uf"], model["bf"], False)
        b, _ = _run(x[bwd], there, model["wb"], model["ub"], model["bb"], False)
        score = np.zeros((len(x), 2 * HIDDEN), np.float32)
        score[fwd[there], :HIDDEN], score[bwd[there], HIDDEN:] = a[there], b[there]
        z = score @ model["out"] + x @ model["direct"]
        cut = np.cumsum(data["sizes"])[:-1]
        for i, part in zip(pick, np.split(z > 0, cut), strict=True):
            out[i] = part
    return out


def train(pages: list[list], labels: list[list[bool]], epochs: int = 6, batch: int = 16, seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    dim = PATH_DIM + WORD_DIM + NUMBERS
    new = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
    model = {
        "paths": new(PATHS, PATH_DIM), "words": new(WORDS, WORD_DIM), "wf": new(dim, 4 * HIDDEN), "uf": new(HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32),
        "wb": new(dim, 4 * HIDDEN), "ub": new(HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32), "out": new(2 * HIDDEN), "direct": np.zeros(dim, np.float32),
    }
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    usable = [i for i, p in enumerate(pages) if p]
    if not usable:
        return model | {"out": np.zeros_like(model["out"])}
    step, steps = 0, epochs * -(-len(usable) // batch)
    for _ in range(epochs):
        order = rng.permutation(usable)
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            data = inputs([pages[i] for i in pick])
            y = np.concatenate([labels[i] for i in pick]).astype(np.float32)
            x, pc, qc = _embed(data, model)
            fwd, bwd, there = _layout(data["sizes"])
            a, sa = _run(x[fwd], there, model["wf"], model["uf"], model["bf"], True)
            b, sb = _run(x[bwd], there, model["wb"], model["ub"], model["bb"], True)
            h = np.zeros((len(x), 2 * HIDDEN), np.float32)
            h[fwd[there], :HIDDEN], h[bwd[there], HIDDEN:] = a[there], b[there]
            d = ((_sigmoid(h @ model["out"] + x @ model["direct"]) - y) / len(y)).astype(np.float32)
            g = {"out": h.T @ d, "direct": x.T @ d}
            dh, dx = d[:, None] * model["out"][None], d[:, None] * model["direct"][None]
            da, db = np.where(there[:, :, None], dh[fwd][:, :, :HIDDEN], 0), np.where(there[:, :, None], dh[bwd][:, :, HIDDEN:], 0)
            g["wf"], g["uf"], g["bf"], xa = _back(x[fwd], sa, da, model["wf"], model["uf"])
            g["wb"], g["ub"], g["bb"], xb = _back(x[bwd], sb, db, model["wb"], model["ub"])
            dx[fwd[there]] += xa[there]
            dx[bwd[there]] += xb[there]
            for name, codes, of, count, cols in (
                ("paths", data["path"], data["path_of"], pc, slice(0, PATH_DIM)), ("words", data["words"], data["words_of"], qc, slice(PATH_DIM, PATH_DIM + WORD_DIM)),
            ):
                each = (dx[:, cols] / count[:, None])[of]
                g[name] = np.stack([np.bincount(codes, weights=each[:, k], minlength=len(model[name])) for k in range(each.shape[1])], axis=1).astype(np.float32)
            step += 1
            rate = 0.02 * (1 - 0.9 * step / steps)
            for k in model:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] * g[k] - second[k])
                model[k] = (model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


_PHRASES = {
    "notice": ("We use cookies to improve this site.", "Accept all", "This site uses cookies. Privacy policy"), "form": ("Subscribe to our newsletter", "Email address", "Send", "Search", "Your name"),
    "share": ("Share this", "Tweet", "Related articles", "Read more"), "comment": ("3 comments", "Leave a reply", "Reply", "Posted by reader"), "menu": ("Home", "About", "Contact", "News", "Log in"),
}
_ADDED = (  # kind, containers, typical phrases, whether running text occurs in it
    ("menu", (("nav",), ("header",), ("div", "menu"), ("ul", "navbar"), ("div", "header"), ("div", "top", "nav")), "menu", False),
    ("side", (("aside",), ("div", "sidebar"), ("div", "related"), ("div", "widget"), ("section", "recommended")), "share", True),
    ("notice", (("div", "cookie", "notice"), ("div", "notice"), ("div", "consent"), ("div", "alert"), ("section", "banner"), ("dialog",)), "notice", True),
    ("form", (("form",), ("form", "search"), ("div", "newsletter", "signup"), ("form", "login")), "form", False),
    ("comment", (("div", "comments"), ("section", "comments"), ("ol", "comment", "list"), ("div", "disqus"), ("div", "comment")), "comment", True),
    ("ad", (("div", "ad"), ("div", "advert"), ("aside", "ads"), ("div", "sponsored"), ("div", "promo")), "share", True),
    ("foot", (("footer",), ("div", "footer"), ("div", "site", "footer")), "menu", True),
)
_MAIN = (("article",), ("main",), ("article", "post"), ("div", "content"), ("div", "post"), ("div", "article", "body"), ("section", "entry", "content"), ("div", "main", "content"), ("div", "story"))


def variants(pages: list[list], seed: int = 12, copies: int = 3) -> tuple[list[list], list[list[bool]]]:
    """The pages and changed copies of them, with labels."""
    rng = np.random.default_rng(seed)
    pool = [b[1] for p in pages for b in p if len(b[1]) > 40][:4000] or ["some text"]
    out, labels = list(pages), [[stated(b[0]) for b in p] for p in pages]
    for page in pages:
        for _ in range(copies):
            main, rows = _MAIN[rng.integers(len(_MAIN))], []
            swap = {kind[0]: kind[1][rng.integers(len(kind[1]))] for kind in _ADDED}
            rename = {"nav": swap["menu"], "footer": swap["foot"], "article": main, "main": main}
            for path, text, link in page:
                rows.append((tuple(rename.get(e[0], swap["ad"] if "ad" in e[1:] else e) for e in path), text, link, stated(path)))
            for kind, containers, phrases, running in _ADDED:
                if rng.random() < 0.45:
                    inside = kind in ("ad", "comment", "form", "side") and rng.random() < 0.4
                    held = [i for i, r in enumerate(rows) if r[3]]
                    spot = held[rng.integers(len(held))] if inside and held else (0 if kind in ("menu", "notice") or rng.random() < 0.2 else len(rows))
                    base = (("html",), ("body",), *((main,) if inside else ()), containers[rng.integers(len(containers))])
                    extra = []
                    for _ in range(rng.integers(1, 6)):
                        leaf = ((), (("p",),), (("ul",), ("li",)), (("div",),), (("div", "text"), ("p",)), (("h3",),))[rng.integers(6)]
                        text = pool[rng.integers(len(pool))] if running and rng.random() < 0.6 else _PHRASES[phrases][rng.integers(len(_PHRASES[phrases]))]
                        extra.append((base + leaf, text, float(rng.random() < 0.4 and not running), False))
                    rows[spot:spot] = extra
            out.append([r[:3] for r in rows])
            labels.append([r[3] for r in rows])
    return out, labels


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> dict:
    """A labeller from at most `sample` pages, chosen by a hash of the page, trained in one task. Pages of any length take part.

    Where the sample has more than `most_bytes` bytes, its first pages up to them are taken (at least one); of a page with more
    than SAMPLE_BLOCKS blocks, so many in a row. Without a page that has a block, no block is content.
    """
    rows = pages.select(F.col(html_col).alias("t")).filter(F.length("t") > 0)
    every = max(1, pages.count() // (4 * sample))
    picked = rows.filter(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).distinct().select(F.xxhash64("t").alias("h"), "t").orderBy("h", "t").limit(sample)
    before = Window.orderBy("h", "t").rowsBetween(Window.unboundedPreceding, -1)  # over `sample` rows
    picked = picked.withColumn("b", F.coalesce(F.sum(F.octet_length("t")).over(before), F.lit(0))).filter(F.col("b") <= most_bytes)

    def learn(found: list[tuple]) -> dict:
        parts = []
        for h, page in found:
            every_block = blocks(page)
            start = h % (len(every_block) - SAMPLE_BLOCKS + 1) if len(every_block) > SAMPLE_BLOCKS else 0
            parts.append(every_block[start : start + SAMPLE_BLOCKS])
        return train(*variants(parts))

    return fitted(picked.select("h", "t"), learn)


def _extract(shared):
    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in W.slices(whole, "_html", PART):
                pages = [blocks(h or "") for h in batch["_html"].to_pylist()]
                texts = ["\n".join([b[1] for b, k in zip(p, keep, strict=True) if k]) for p, keep in zip(pages, predict(pages, model), strict=True)]
                names = [c for c in batch.schema.names if c != "_html"]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(texts, pa.string())], [*names, "text"])

    return run


def main_text(pages: DataFrame, model: dict, *keep: str, html_col: str = "html") -> DataFrame:
    """The columns `keep`, text (content blocks joined by a newline, empty if there are none) and n_chars of each page.

    Null pages count as empty; rows are independent. A tag that the end of the page cuts off is dropped, a reference that it cuts off stays.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers
    kinds = dict(pages.dtypes)
    rows = pages.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(html_col).alias("_html"))
    schema = ", ".join([f"_k{i} {kinds[c]}" for i, c in enumerate(keep)] + ["text string"])
    out = rows.mapInArrow(_extract(shared), schema)
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "text", F.length("text").cast("long").alias("n_chars"))
