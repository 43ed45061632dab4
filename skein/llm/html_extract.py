"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks. Each block is a vector of its tag path, its
hashed words and a few figures; a bidirectional LSTM, in numpy, reads the
page's whole sequence of them and says for each block whether it belongs to
the article.
"""

from __future__ import annotations

from functools import cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import load, map_rows
from .html_blocks import Block, blocks
from .html_samples import MARK, sample_pages

PATHS, WORDS, FIGURES = 1024, 1 << 15, 9
#: Characters that are no part of a word at its ends.
EDGES = ".,:;!?()|*#$%&"


def _figures(b: Block, i: int, n: int) -> list[float]:
    t = b.text
    size = len(t)
    words = t.count(" ") + 1
    return [np.log1p(words) / 3, np.log1p(size) / 5, b.linked / size, t[-1] in ".?!", t[0].isupper(), sum(map(t.count, "0123456789")) / size, (size - words + 1) / words / 10, i / n, (n - i) / n]


class Buckets(dict):
    """Hash buckets of names or words, kept so that each is hashed once; forgotten when there are too many."""

    def __init__(self, n: int, edges: str = ""):
        super().__init__()
        self.n, self.edges = n, edges

    def __missing__(self, name: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        k = self[name] = crc32(name.strip(self.edges).encode("utf-8", "replace")) % self.n
        return k


def vocabulary() -> tuple[Buckets, Buckets]:
    return Buckets(PATHS), Buckets(WORDS, EDGES)


class Encoded:
    """Blocks of some pages as numbers: figures, leaf tags, and the buckets of their path and words, block by block."""

    def __init__(self, pages: list[list[Block]], hashed: tuple[Buckets, Buckets], part: int = 8192):
        names, word = hashed
        self.sizes = np.array([len(p) for p in pages], np.int64)
        parts: list[list[np.ndarray]] = []
        figures, leaf, paths, words, path_n, word_n = held = ([], [], [], [], [], [])

        def pack():  # so that a long page is never a list of numbers as a whole
            parts.append([np.array(figures, np.float32).reshape(-1, FIGURES), *[np.array(x, np.int32) for x in held[1:]]])
            for x in held:
                x.clear()

        for page in pages:
            for i, b in enumerate(page):
                figures.append(_figures(b, i, len(page)))
                leaf.append(names[b.path[-1].tag if b.path else ""])
                at = len(paths)
                paths += [names["<" + e.tag] for e in b.path]
                paths += [names["." + x] for e in b.path for x in e.names]
                path_n.append(len(paths) - at)
                at = len(words)
                words += [word[x] for x in b.text.lower().split()]
                word_n.append(len(words) - at)
                if len(leaf) >= part or len(words) >= 32 * part or len(paths) >= 32 * part:
                    pack()
        pack()
        self.figures, self.leaf, self.path, self.word, self.path_n, self.word_n = (np.concatenate(x) for x in zip(*parts, strict=True))


def _mean(table: np.ndarray, ids: np.ndarray, n: np.ndarray, part: int = 1 << 16) -> np.ndarray:
    out = np.zeros((len(n), table.shape[1]), np.float32)
    ends = np.cumsum(n, dtype=np.int64)
    for at in range(0, len(n), part):  # table[ids] of a whole long page would be large
        m = n[at : at + part]
        lo = ends[at - 1] if at else 0
        some = ids[lo : ends[at + len(m) - 1]]
        if len(some):
            full = np.flatnonzero(m)
            starts = (ends[at : at + len(m)] - m - lo)[full]
            out[at + full] = np.add.reduceat(table[some], starts, 0) / m[full, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Embeddings, a forward and a backward LSTM, and a logistic layer over both states."""

    def __init__(self, dim: int = 12, hidden: int = 20, seed: int = 3):
        r = np.random.default_rng(seed)
        self.dim, self.hidden = dim, hidden
        wide = 3 * dim + FIGURES
        f = lambda *s, k=0.2: r.normal(0, k, s).astype(np.float32)
        self.p = {"path": np.zeros((PATHS, dim), np.float32), "leaf": np.zeros((PATHS, dim), np.float32), "word": np.zeros((WORDS, dim), np.float32), "out": f(2 * hidden, 1), "top": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {d + "x": f(wide, 4 * hidden), d + "h": f(hidden, 4 * hidden), d + "b": np.zeros(4 * hidden, np.float32)}
            self.p[d + "b"][hidden : 2 * hidden] = 1  # remember at first

    def inputs(self, e: Encoded) -> np.ndarray:
        return np.concatenate([_mean(self.p["path"], e.path, e.path_n), self.p["leaf"][e.leaf], _mean(self.p["word"], e.word, e.word_n), e.figures], 1)

    def _run(self, d: str, x: np.ndarray, keep: bool, stretch: int = 4096):
        """x: steps, pages, inputs. States of each step, and what the way back needs."""
        h = np.zeros((x.shape[1], self.hidden), np.float32)
        c, n = h, self.hidden
        states, held = np.empty((*x.shape[:2], n), np.float32), []
        wh = self.p[d + "h"]
        for t in range(len(x)):
            if t % stretch == 0:
                z = x[t : t + stretch] @ self.p[d + "x"] + self.p[d + "b"]
            g = z[t % stretch] + h @ wh
            s = _sigmoid(g[:, : 3 * n])
            i, f, o, a = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 3 * n :])
            c0, h0 = c, h
            c = f * c + i * a
            tc = np.tanh(c)
            h = o * tc
            states[t] = h
            if keep:
                held.append((i, f, o, a, c0, tc, h0))
        return states, held

    def _layout(self, sizes: np.ndarray):
        """Places (step, page) of every block, forwards and backwards."""
        page = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return step, np.repeat(sizes, sizes) - 1 - step, page

    def forward(self, e: Encoded, keep: bool = False):
        x = self.inputs(e)
        step, back, page = self._layout(e.sizes)
        states, ways = [], []
        for d, at in (("f", step), ("b", back)):
            grid = np.zeros((int(e.sizes.max(initial=0)), len(e.sizes), x.shape[1]), np.float32)
            grid[at, page] = x
            s, held = self._run(d, grid, keep)
            states.append(s[at, page])
            if keep:
                ways.append((grid, held))
        both = np.concatenate(states, 1)
        return x, both, ways, _sigmoid((both @ self.p["out"])[:, 0] + self.p["top"][0])

    def gradients(self, e: Encoded, y: np.ndarray) -> dict[str, np.ndarray]:
        x, both, ways, prob = self.forward(e, True)
        step, back, page = self._layout(e.sizes)
        d = ((prob - y) / len(y)).astype(np.float32)[:, None]
        g = {"out": both.T @ d, "top": d.sum(0)}
        dboth = d @ self.p["out"].T
        dx = np.zeros_like(x)
        n = self.hidden
        for k, (name, at) in enumerate((("f", step), ("b", back))):
            grid, held = ways[k]
            dh_all = np.zeros((*grid.shape[:2], n), np.float32)
            dh_all[at, page] = dboth[:, k * n : (k + 1) * n]
            dz = np.zeros((*grid.shape[:2], 4 * n), np.float32)
            dh = np.zeros((grid.shape[1], n), np.float32)
            dc = np.zeros_like(dh)
            gh = np.zeros_like(self.p[name + "h"])
            wh = self.p[name + "h"].T
            for t in range(len(grid) - 1, -1, -1):
                i, f, o, a, c0, tc, h0 = held[t]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc * tc)
                q = dz[t]
                q[:, :n], q[:, n : 2 * n] = dc * a * i * (1 - i), dc * c0 * f * (1 - f)
                q[:, 2 * n : 3 * n], q[:, 3 * n :] = dh * tc * o * (1 - o), dc * i * (1 - a * a)
                gh += h0.T @ q
                dh, dc = q @ wh, dc * f
            flat = dz.reshape(-1, 4 * n)
            g |= {name + "x": grid.reshape(-1, grid.shape[2]).T @ flat, name + "h": gh, name + "b": flat.sum(0)}
            dx += (dz @ self.p[name + "x"].T)[at, page]
        m = self.dim
        for key, ids, count, part in (("path", e.path, e.path_n, dx[:, :m]), ("word", e.word, e.word_n, dx[:, 2 * m : 3 * m])):
            g[key] = np.zeros_like(self.p[key])
            np.add.at(g[key], ids, np.repeat(part / np.maximum(1, count)[:, None], count, 0))
        g["leaf"] = np.zeros_like(self.p["leaf"])
        np.add.at(g["leaf"], e.leaf, dx[:, m : 2 * m])
        return g

    def fit(self, pages: list[list[Block]], labels: list[list[int]], epochs: int = 6, batch: int = 24, rate: float = 6e-3, seed: int = 9) -> BlockLabeller:
        r, hashed = np.random.default_rng(seed), vocabulary()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        order = np.argsort([len(p) for p in pages], kind="stable")
        groups = [(Encoded([pages[k] for k in order[at : at + batch]], hashed), np.array([y for k in order[at : at + batch] for y in labels[k]], np.float32)) for at in range(0, len(order), batch)]
        for epoch in range(epochs):
            now = rate * (0.3 if epoch >= epochs - 2 else 1)
            for k in r.permutation(len(groups)):
                g = self.gradients(*groups[k])
                t += 1
                for key in self.p:
                    if key == "word":  # what only tells apart invented words fades
                        g[key] += 2e-4 * self.p[key]
                    m[key] += 0.1 * (g[key] - m[key])
                    v2[key] += 0.005 * (g[key] ** 2 - v2[key])
                    self.p[key] -= (now * (m[key] / (1 - 0.9**t)) / (np.sqrt(v2[key] / (1 - 0.995**t)) + 1e-7)).astype(np.float32)
        return self

    def main_text(self, pages: list[str | None], hashed: tuple[Buckets, Buckets], batch: int = 64, cells: int = 1 << 15) -> list[str]:
        """The blocks labelled as main text of each whole page, joined by line feeds."""
        out = [""] * len(pages)
        for i, text in self.main_texts(pages, hashed, batch, cells):
            out[i] = text
        return out

    def main_texts(self, pages: list[str | None], hashed: tuple[Buckets, Buckets], batch: int = 64, cells: int = 1 << 15):
        """Places and main texts of pages, in any order. Pages that are read side by side take at most ``cells`` steps altogether, the shorter ones' padding counted; a longer page is read by itself."""
        cut = [blocks(p) for p in pages]
        order = sorted(range(len(cut)), key=lambda k: len(cut[k]))
        at = 0
        while at < len(order):
            n = 1
            while n < batch and at + n < len(order) and (n + 1) * len(cut[order[at + n]]) <= cells:
                n += 1
            some = order[at : at + n]
            e = Encoded([cut[k] for k in some], hashed)
            keep = np.split(self.forward(e)[3] > 0.5, np.cumsum(e.sizes)[:-1])
            del e
            for k, mask in zip(some, keep, strict=True):
                yield k, "\n".join(b.text for b, x in zip(cut[k], mask, strict=True) if x)
                cut[k] = []
            at += n


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a sample page without its marks, and whether each was marked."""
    cut = blocks(page)
    return [b._replace(text=b.text.replace(MARK, "") or "-") for b in cut], [int(MARK in b.text) for b in cut]


@cache
def trained(pages: int = 2000, seed: int = 5) -> BlockLabeller:
    """The labeller fitted to so many invented pages; the same each time."""
    got = [labelled(p) for p in sample_pages(pages, seed)]
    return BlockLabeller().fit([b for b, _ in got], [y for _, y in got])


def extract(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html).

    Null and empty pages, and those without main text, have an empty text.
    Pages are read whole, whatever their length. Rows alike are treated one
    by one; other columns are ignored; no rows give none.
    """
    model = model or trained()
    kind = pages.schema["page_id"].dataType.simpleString()

    def make():
        hashed = vocabulary()

        def fn(rows):
            for i, t in model.main_texts([r["html"] for r in rows], hashed):
                yield rows[i]["page_id"], rows[i]["url"], t, len(t)

        return fn

    return map_rows(pages.select("page_id", "url", "html"), make, f"page_id {kind}, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(load(spark, sf_dir, "pages"))
