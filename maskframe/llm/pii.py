"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans of four kinds. A BiLSTM-CRF in numpy is trained on windows of characters labelled with
them, three forms of each rewritten (no plus before a phone number, other separators, a card number with a wrong digit), so
that it tags forms that the patterns miss. Texts are cut into overlapping windows; each character's tag scores are averaged over
the windows that cover it, and one Viterbi pass over each stretch of joined windows decides (global reconciliation).
Spans that are long enough for their kind and overlap no base span are added.

All kinds need a digit or an @, so windows without either hold only "outside" tags and are skipped; that is exact.

The fit takes at most `sample` rows with a digit or @ (smallest hashes of the id), of each the first `chars` characters, in
four forms each up to 4 spans and 2 other places, and `windows` windows in all; everything else covers all rows and whole
texts. Only ids are sorted, and only the chosen texts reach the driver. Without any labelled span in the sample no
model can be trained, and nothing is added. Runs of 14 to 19 digits count as cards for the model even if their check digit is
wrong, as a mistyped number is still personal.

Edge cases: null texts are empty; very long texts are more windows; equal texts get equal spans; of overlapping new spans the
earlier, then the longer one stays; further columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import Span, as_text, free_of, ordered

KINDS = ("email", "ip", "card", "phone")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
WINDOW, STRIDE = 48, 24
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Digits that a span of a kind must have.
DIGITS = {"email": (0, 99), "ip": (4, 12), "card": (14, 19), "phone": (10, 15)}


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    if not TRIGGER.search(text):
        return []
    out: list[Span] = []
    free = 0
    if "@" in text:
        for m in AT.finditer(text):  # a match's part before @ is all that the class allows after the last match
            a = m.start()
            while a > free and text[a - 1] in LOCAL:
                a -= 1
            if a < m.start():
                out.append(("email", a, m.end()))
                free = m.end()
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ordered(out, KINDS)


MARKS = "@.-+()_/:%#=,'\"!?;|$&*"
CLASSES = 7 + len(MARKS)


def classes(text: str) -> np.ndarray:
    """Character classes: 0 padding, 1 other, digit, lower, upper, blank, beyond ASCII, then each mark."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return TABLE[np.minimum(codes, 128)]


TABLE = np.ones(129, dtype=np.int8)
TABLE[48:58], TABLE[97:123], TABLE[65:91], TABLE[128] = 2, 3, 4, 6
TABLE[[9, 10, 11, 12, 13, 32]] = 5
for _i, _c in enumerate(MARKS):
    TABLE[ord(_c)] = 7 + _i


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Net:
    """Embedding, two LSTMs, a linear layer and CRF transitions."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 3, embed: int = 8, hidden: int = 14) -> "Net":
        rng = np.random.default_rng(seed)
        p = {"emb": rng.normal(0, 0.5, (CLASSES, embed)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in ("f", "b"):
            p[f"w{d}"] = rng.normal(0, 0.3, (embed + hidden, 4 * hidden))
            p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        return Net({k: v.astype(np.float32) for k, v in p.items()})

    def lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        w, c0 = self.p[f"w{d}"], self.p[f"c{d}"]
        n, t, e = x.shape
        hid = w.shape[1] // 4
        h = c = np.zeros((n, hid), dtype=np.float32)
        out, tape = np.empty((n, t, hid), dtype=np.float32), []
        given = x.reshape(-1, e) @ w[:e] + c0
        given = given.reshape(n, t, -1)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = given[:, i] + h @ w[e:]
            s = sigmoid(z[:, : 3 * hid])
            a, f, o, g = s[:, :hid], s[:, hid : 2 * hid], s[:, 2 * hid :], np.tanh(z[:, 3 * hid :])
            before, prior = c, h
            c = f * c + a * g
            tc = np.tanh(c)
            h = o * tc
            out[:, i] = h
            if keep:
                tape.append((i, a, f, o, g, before, tc, prior))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self.p["emb"][x]
        both = np.concatenate([self.lstm(e, d, False)[0] for d in "fb"], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (n, t) = self.p, x.shape
        e = p["emb"][x]
        runs = {d: self.lstm(e, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        em = (both @ p["out"] + p["bias"]).astype(np.float64)
        m = np.exp(p["trans"].astype(np.float64))
        ex = np.exp(em - em.max(axis=2, keepdims=True))
        alpha, beta, pairs = np.empty_like(ex), np.ones_like(ex), np.zeros((TAGS, TAGS))
        alpha[:, 0] = ex[:, 0] / ex[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            a = (alpha[:, i - 1] @ m) * ex[:, i]
            alpha[:, i] = a / a.sum(axis=1, keepdims=True)
        for i in range(t - 2, -1, -1):
            r = ex[:, i + 1] * beta[:, i + 1]
            b = r @ m.T
            beta[:, i] = b / b.sum(axis=1, keepdims=True)
            scale = 1 / np.einsum("ni,ij,nj->n", alpha[:, i], m, r)
            pairs += ((alpha[:, i] * scale[:, None]).T @ r) * m
        post = alpha * beta
        de = post / post.sum(axis=2, keepdims=True)
        de[np.arange(n)[:, None], np.arange(t), y] -= 1
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        de = (de / n).astype(np.float32)
        g = {"trans": (pairs / n).astype(np.float32), "bias": de.sum(axis=(0, 1)), "out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS)}
        dh_all, dx = de @ p["out"].T, np.zeros_like(e)
        hid = both.shape[2] // 2
        for k, d in enumerate("fb"):
            w = p[f"w{d}"]
            gw, gc = np.zeros_like(w), np.zeros_like(p[f"c{d}"])
            dh = dc = np.zeros((n, hid), dtype=np.float32)
            width = e.shape[2]
            for i, a, f, o, gg, before, tc, prior in reversed(runs[d][1]):
                dh = dh + dh_all[:, i, k * hid : (k + 1) * hid]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * gg * a * (1 - a), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * a * (1 - gg**2)], axis=1)
                gw += np.concatenate([e[:, i], prior], axis=1).T @ dz
                gc += dz.sum(axis=0)
                back = dz @ w.T
                dx[:, i] += back[:, :width]
                dh, dc = back[:, width:], dc * f
            g[f"w{d}"], g[f"c{d}"] = gw, gc
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], x.ravel(), dx.reshape(-1, dx.shape[2]))
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 5) -> "Net":
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                step += 1
                for k, g in self.gradients(x[some], y[some]).items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        trans, back = self.p["trans"], np.empty(em.shape, dtype=np.int8)
        s = em[0]
        for i in range(1, len(em)):
            total = s[:, None] + trans
            back[i] = total.argmax(axis=0)
            s = total.max(axis=0) + em[i]
        path = np.empty(len(em), dtype=np.int64)
        path[-1] = s.argmax()
        for i in range(len(em) - 1, 0, -1):
            path[i - 1] = back[i][path[i]]
        return path


def rewritten(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with its spans in other forms."""
    out, new, at, length = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        out.append(text[at:a])
        length += a - at
        s = text[a:b]
        if kind == "phone":
            s = s.lstrip("+")
            s = [s, s.replace(" ", "-"), s.replace("(", "").replace(")", ""), digits_of(s)[-10:]][rng.integers(4)]
        elif kind == "card":
            d = digits_of(s)
            d = d[:-1] + str((int(d[-1]) + int(rng.integers(1, 9))) % 10)
            sep = ["", " ", "-", "."][rng.integers(4)]
            s = sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        elif kind == "ip":
            s = s.replace(".", [" . ", "[.]", "-"][rng.integers(3)])
        else:
            s = s.replace("@", [" @ ", "[@]", "@"][rng.integers(3)])
        new.append((kind, length, length + len(s)))
        out.append(s)
        length += len(s)
        at = b
    return "".join([*out, text[at:]]), new


def examples(texts: list[str], windows: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """Labelled windows around spans and other triggers, and how many spans they hold."""
    rng, xs, ys, count = np.random.default_rng(seed), [], [], 0
    for text in texts:
        base = base_spans(text)
        for form in range(4):
            t, spans = (text, base) if form == 0 else rewritten(text, base, rng)
            tags = np.zeros(len(t), dtype=np.int64)
            for kind, a, b in spans:
                k = KINDS.index(kind)
                tags[a:b], tags[a] = 2 + 2 * k, 1 + 2 * k
            cls = classes(t)
            places = [a for _, a, _ in spans[:4]] + [m.start() for m in list(TRIGGER.finditer(t))[:: max(1, len(t) // 200)][:2]]
            for a in places:
                lo = max(0, a - int(rng.integers(0, WINDOW - 8)))
                x, y = np.zeros(WINDOW, dtype=np.int64), np.zeros(WINDOW, dtype=np.int64)
                part = cls[lo : lo + WINDOW]
                x[: len(part)], y[: len(part)] = part, tags[lo : lo + WINDOW]
                xs.append(x)
                ys.append(y)
            count += len(spans)
        if len(xs) >= windows:
            break
    return np.array(xs[:windows]), np.array(ys[:windows]), count


def trained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 400, windows: int = 1600, chars: int = 20_000, epochs: int = 8) -> Net | None:
    able = df.filter(F.col(text_col).rlike("[0-9@]") & F.col(id_col).isNotNull())
    ids = [r["id"] for r in able.select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    rows = able.filter(F.col(id_col).isin(ids)).select(F.substring(text_col, 1, chars).alias("t")).orderBy("t").limit(2 * sample).collect()
    x, y, count = examples(random.Random(0).sample(texts := [r["t"] for r in rows], len(texts)), windows)
    return Net.new().train(x, y, epochs) if count else None  # without any labelled span there is nothing to learn


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of window starts (first, count): windows at multiples of STRIDE that hold a trigger."""
    last, out = max(0, len(text) - 1) // STRIDE, []
    starts: set[int] = set()
    for m in TRIGGER.finditer(text):
        w = m.start() // STRIDE
        starts.add(w)
        if w:
            starts.add(w - 1)
    for w in sorted(s for s in starts if s <= last):
        if out and out[-1][0] + out[-1][1] == w:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((w, 1))
    return out


def model_spans(net: Net, texts: list[str], block: int = 512) -> list[list[Span]]:
    """Spans that the model sees in each text, after global reconciliation of its windows."""
    runs = [(i, w, n) for i, t in enumerate(texts) for w, n in stretches(t)]
    out: list[list[Span]] = [[] for _ in texts]
    if not runs:
        return out
    cls = {i: classes(texts[i]) for i in dict.fromkeys(r[0] for r in runs)}
    jobs = [(i, (w + k) * STRIDE) for i, w, n in runs for k in range(n)]
    done = 0
    pending: list[np.ndarray] = []
    run = 0
    for lo in range(0, len(jobs), block):
        x = np.zeros((min(block, len(jobs) - lo), WINDOW), dtype=np.int64)
        for r, (i, a) in enumerate(jobs[lo : lo + block]):
            part = cls[i][a : a + WINDOW]
            x[r, : len(part)] = part
        pending.extend(net.emissions(x))
        while run < len(runs) and len(pending) - done >= runs[run][2]:
            i, w, n = runs[run]
            a, size = w * STRIDE, min((n - 1) * STRIDE + WINDOW, len(texts[i]) - w * STRIDE)
            total, seen = np.zeros(((n - 1) * STRIDE + WINDOW, TAGS), dtype=np.float32), np.zeros(((n - 1) * STRIDE + WINDOW, 1), dtype=np.float32)
            for k in range(n):
                total[k * STRIDE : k * STRIDE + WINDOW] += pending[done + k]
                seen[k * STRIDE : k * STRIDE + WINDOW] += 1
            done += n
            run += 1
            out[i] += tagged(net.viterbi((total / seen)[:size]), a, texts[i])
        pending, done = pending[done:], 0
    return out


def tagged(path: np.ndarray, at: int, text: str) -> list[Span]:
    out, i = [], 0
    inside = np.flatnonzero(path)
    while len(inside) and i < len(path):
        later = inside[np.searchsorted(inside, i) :]
        if not len(later):
            break
        a = int(later[0])
        k = (int(path[a]) - 1) // 2
        b = a + 1
        while b < len(path) and path[b] == 2 + 2 * k:
            b += 1
        i = b
        lo, hi = at + a, at + b
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and (text[hi - 1].isspace() or text[hi - 1] in ".,;:!?"):
            hi -= 1
        s, kind = text[lo:hi], KINDS[k]
        least, most = DIGITS[kind]
        if least <= len(digits_of(s)) <= most and (kind != "email" or ("@" in s and "." in s.split("@")[-1])):
            out.append((kind, lo, hi))
    return out


def find(df: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of df."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            more = model_spans(net, texts) if net else [[] for _ in texts]
            rows = []
            for t, new in zip(texts, more, strict=True):
                base = base_spans(t)
                spans = ordered(base + free_of(new, base), KINDS) if new else base
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "id", b["id"].array)
            yield out

    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, trained(docs))
