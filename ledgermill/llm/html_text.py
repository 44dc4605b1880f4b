"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks in page order: runs of text between block-level tags, with
character references decoded, white space turned into one space, scripts, styles, the head and
markup left out. Each block has features of its ancestors (their tags, class, id and role
words), its own tag, length, link density and place. A linear-chain CRF (two labels: main
text or not; emission weights on hashed features, transition weights between neighbouring
blocks) is trained on labelled pages and decoded by Viterbi.

Labelled pages: pages whose markup names the article (an article or main element, or role
main). There a block is main text when it lies inside it and inside no navigation, header,
footer, aside, form, and no element whose class, id or role names boilerplate (adverts,
comments, sidebars, menus, notices). The CRF learns from at most TRAIN_PAGES such pages of up to
TRAIN_HTML characters each, taken by a hash of page_id, and is then applied to every page,
including those without such markup, from the blocks' own features.

Parsing and decoding run in tasks (mapInArrow); only the bounded training sample reaches the
driver, and only the model's weights (FEATURES x 2 numbers) are broadcast.
"""

from __future__ import annotations

import math
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 18  # hashed feature space of the emissions
TRAIN_PAGES = 600  # bound of the training sample (pages)
TRAIN_HTML = 200_000  # a training page has at most so many characters of html
STEPS = 300  # most optimisation steps
TOLERANCE = 1e-4  # the fit stops when the loss changes by less than this, relatively
L2 = 1e-3  # weight of the squared norm of the weights, per training block
RATE = 0.1  # Adam's step

# Fixed word lists of the reading rules.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset("head script style template noscript svg math iframe object canvas select option textarea".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_SELF = frozenset("p li dt dd tr td th".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav header footer aside form menu button dialog".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies "
    "disqus footer header menu nav navbar navigation newsletter notice popup promo related reply replies share "
    "sharing sidebar social sponsor sponsored subscribe widget".split()
)
SPACE = re.compile(r"[ \t\n\r\f]+")
WORD = re.compile(r"[a-z0-9]+")


class _Blocks(HTMLParser):
    """Leaf blocks of one page: (text, ancestors, words of ancestors, link characters, tag)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.hidden = 0
        self.parts: list[str] = []
        self.link = 0
        self.blocks: list[tuple] = []

    def _flush(self):
        text = SPACE.sub(" ", "".join(self.parts)).strip(" ")
        if text:
            tags = tuple(t for t, _ in self.stack)
            words = tuple(w for _, ws in self.stack for w in ws)
            own = next((t for t in reversed(tags) if t in BLOCK_TAGS), "")
            self.blocks.append((text, tags, words, self.link, own))
        self.parts, self.link = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            if tag == "br" and not self.hidden:
                self.parts.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag == "body":  # a head left open ends here
            while self.stack and self.stack[-1][0] in HIDDEN_TAGS:
                self.stack.pop()
            self.hidden = 0
        if tag in BLOCK_TAGS:
            self._flush()
        if tag in CLOSED_BY_SELF and any(t == tag for t, _ in self.stack):
            while self.stack:
                if self.stack.pop()[0] == tag:
                    break
        words = []
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                words += WORD.findall(value.lower())
        self.stack.append((tag, tuple(words)))
        if tag in HIDDEN_TAGS:
            self.hidden += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        if tag in BLOCK_TAGS:
            self._flush()
        while self.stack:
            top = self.stack.pop()[0]
            if top in HIDDEN_TAGS:
                self.hidden -= 1
            if top == tag:
                break

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if any(t == "a" for t, _ in self.stack):
                self.link += len(data)


def blocks(html: str | None) -> list[tuple]:
    """Leaf blocks of a page in order; null or empty html has none."""
    reader = _Blocks()
    if html:
        reader.feed(html)
        reader.close()
    reader._flush()
    return reader.blocks


def gold(block: tuple) -> int:
    """The reading rule of labelled pages: 1 for main text."""
    _, tags, words, _, _ = block
    inside = any(t in MAIN_TAGS for t in tags) or "main" in words
    return int(inside and not any(t in BOILER_TAGS for t in tags) and not any(w in BOILER_WORDS for w in words))


def labelled(page: list[tuple]) -> bool:
    return any(any(t in MAIN_TAGS for t in b[1]) or "main" in b[2] for b in page)


def _bucket(x: float) -> int:
    return int(math.log2(x + 1))


def features(page: list[tuple]) -> list[list[int]]:
    """Hashed features of each block of a page.

    The marks the labels are read from (article, main) are no features: the model must learn
    the main text from what every page has, and so reads pages without such marks too.
    """
    out = []
    n = len(page)
    for k, (text, tags, words, link, own) in enumerate(page):
        size = len(text)
        density = link / size if size else 0.0
        names = ["bias", f"tag={own}", f"len={_bucket(size)}", f"link={int(density * 4)}",
                 f"tag_link={own}:{int(density * 4)}", f"words={_bucket(text.count(' ') + 1)}",
                 f"stop={text[-1] in '.!?'}", f"pos={10 * k // max(n, 1)}", f"first={k == 0}", f"last={k == n - 1}"]
        names += [f"anc={t}" for t in set(tags) - MAIN_TAGS]
        names += [f"word={w}" for w in set(words) - {"main"}]
        names += [f"near={t}" for t in tags[-3:] if t not in MAIN_TAGS]
        out.append(sorted({zlib.crc32(x.encode()) % FEATURES for x in names}))
    return out


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _chunks(pages, cells: int = 1 << 21):
    """Pages sorted by length in padded arrays of at most about ``cells`` feature cells each."""
    pages = sorted(pages, key=lambda p: len(p[0]))
    out, start = [], 0
    while start < len(pages):
        L = len(pages[start][0])
        K = max(len(f) for f in pages[start][0])
        end = start + 1
        while end < len(pages):
            L2_, K2 = len(pages[end][0]), max(K, max(len(f) for f in pages[end][0]))
            if (end - start + 1) * L2_ * K2 > cells:
                break
            L, K, end = L2_, K2, end + 1
        part = pages[start:end]
        idx = np.full((len(part), L, K), FEATURES, np.int32)
        y = np.zeros((len(part), L), np.int64)
        mask = np.zeros((len(part), L), bool)
        for b, (feats, labels) in enumerate(part):
            for t, f in enumerate(feats):
                idx[b, t, : len(f)] = f
            y[b, : len(labels)] = labels
            mask[b, : len(labels)] = True
        out.append((idx, y, mask))
        start = end
    return out


def _loss_and_grads(W, T, S, idx, y, mask):
    """Negative log-likelihood of one chunk and its gradients, by forward-backward."""
    B, L, K = idx.shape
    E = W[idx].sum(axis=2)  # B x L x 2
    alpha = np.zeros((B, L, 2))
    alpha[:, 0] = S + E[:, 0]
    for t in range(1, L):
        new = _logsumexp(alpha[:, t - 1, :, None] + T[None], 1) + E[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    beta = np.zeros((B, L, 2))
    for t in range(L - 2, -1, -1):
        new = _logsumexp(T[None] + (E[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
    logz = _logsumexp(alpha[:, L - 1], 1)
    gold_score = (S[y[:, 0]] + (np.take_along_axis(E, y[..., None], 2)[..., 0] * mask).sum(1)
                  + (T[y[:, :-1], y[:, 1:]] * mask[:, 1:]).sum(1))
    node = np.exp(alpha + beta - logz[:, None, None]) * mask[..., None]
    one_hot = np.eye(2)[y] * mask[..., None]
    gW = np.zeros_like(W)
    np.add.at(gW, idx.reshape(-1), np.repeat((node - one_hot).reshape(-1, 2), K, axis=0))
    edge = np.exp(alpha[:, :-1, :, None] + T[None, None] + (E[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None])
    edge *= mask[:, 1:, None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
    return (logz - gold_score).sum(), gW, edge.sum((0, 1)) - seen, (node[:, 0] - one_hot[:, 0]).sum(0)


def fit(pages: list[tuple[list[list[int]], list[int]]]) -> dict:
    """Weights of the CRF by its conditional log-likelihood, with Adam, to a tolerance.

    pages: (features of each block, gold label of each block). Returns W (FEATURES x 2),
    T (2 x 2 transitions), S (2 starts) and the steps taken. Memory is bounded by chunks of
    pages of like length, whatever the longest page.
    """
    pages = [p for p in pages if p[0]]
    W, T, S = np.zeros((FEATURES + 1, 2)), np.zeros((2, 2)), np.zeros(2)
    if not pages:
        return {"W": W[:-1], "T": T, "S": S, "steps": 0}
    chunks = _chunks(pages)
    blocks_n = sum(int(m.sum()) for _, _, m in chunks)
    params = [W, T, S]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    last, step = None, 0
    for step in range(1, STEPS + 1):
        loss, grads = 0.0, [np.zeros_like(p) for p in params]
        for idx, y, mask in chunks:
            part, *g = _loss_and_grads(W, T, S, idx, y, mask)
            loss += part
            for total, one in zip(grads, g):
                total += one
        grads = [g / blocks_n for g in grads]
        grads[0][FEATURES] = 0
        grads[0] += L2 * W
        loss = loss / blocks_n + L2 * (W**2).sum() / 2
        for p, g, (m, v) in zip(params, grads, moments):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if last is not None and abs(last - loss) <= TOLERANCE * max(abs(loss), 1e-12):
            break
        last = loss
    return {"W": W[:-1], "T": T, "S": S, "steps": step, "loss": loss}


def viterbi(E: np.ndarray, T: np.ndarray, S: np.ndarray) -> np.ndarray:
    """The best labels of one page, ties to the smaller label."""
    n = len(E)
    if not n:
        return np.zeros(0, np.int64)
    back = np.zeros((n, 2), np.int64)
    score = S + E[0]
    for t in range(1, n):
        options = score[:, None] + T
        back[t] = options.argmax(0)
        score = options.max(0) + E[t]
    best = np.zeros(n, np.int64)
    best[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        best[t - 1] = back[t, best[t]]
    return best


def main_text(html: str | None, model: dict) -> str:
    """The main text of one page: its main blocks joined by one space; '' if none."""
    page = blocks(html)
    if not page:
        return ""
    W = model["W"]
    E = np.array([W[f].sum(0) for f in features(page)])
    keep = viterbi(E, model["T"], model["S"])
    return " ".join(b[0] for b, k in zip(page, keep) if k)


def _sample(pages: DataFrame):
    def read(batches):
        for batch in batches:
            out_feats, out_labels = [], []
            for html in batch.column("html").to_pylist():
                page = blocks(html)
                if not labelled(page):
                    out_feats.append(None)
                    out_labels.append(None)
                    continue
                out_feats.append(features(page))
                out_labels.append([gold(b) for b in page])
            yield pa.RecordBatch.from_pydict({"feats": out_feats, "labels": out_labels})

    return pages.mapInArrow(read, "feats array<array<long>>, labels array<long>").filter("feats is not null")


def train(pages: DataFrame, size: int = TRAIN_PAGES) -> dict:
    """The CRF fitted on at most ``size`` labelled pages of up to TRAIN_HTML characters."""
    # The sample is chosen by keys alone; only its pages' html is then read.
    keyed = pages.filter(F.length("html") <= TRAIN_HTML).select("html", F.xxhash64("page_id", "url").alias("_order"))
    first = keyed.select("_order").orderBy("_order").limit(size)
    chosen = keyed.join(F.broadcast(first), "_order", "left_semi").dropDuplicates(["_order"]).select("html")
    rows = _sample(chosen).collect()
    return fit([(r["feats"], r["labels"]) for r in rows])


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, by the CRF (trained here if not given).

    Input: page_id, url, html; more columns are ignored, whatever their names. Null or empty
    html gives text ''. Text is the main blocks in page order, each with character references
    decoded and white space (space, tab, line breaks, form feed) turned into one space,
    trimmed, joined by one space; n_chars counts its code points. Repeated rows give repeated
    rows. Empty input: no rows.
    """
    model = model if model is not None else train(pages)
    shared = pages.sparkSession.sparkContext.broadcast({k: model[k] for k in ("W", "T", "S")})

    def decode(batches):
        weights = shared.value
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                },
                schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]),
            )

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return chosen.mapInArrow(decode, "page_id long, url string, text string, n_chars long")
