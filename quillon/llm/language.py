"""Operator 8: language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of the lower-cased text in both directions and gives every byte a distribution over the
languages; a document's distribution is the normalised mean of its bytes' log probabilities. All bytes of the whole
text are read in their order. A text is cut into spans of ``SPAN`` bytes, and each is read with ``MARGIN`` bytes more
on both sides, in which the states warm up and which are not counted, so spans of many texts go through the network at once.

The network is trained in numpy by backpropagation through time on a bounded sample: at most about
``sample`` documents of each language, chosen by a hash of their ids, and of each ``pieces`` pieces of ``PIECE`` bytes, which
are cut out in the tasks.

Defined results: null texts and texts without a letter are ``und`` with score 0; documents whose language
is null are not learned from; of more than ``most_languages`` languages the most frequent ones are learned; if nothing
can be learned, all are ``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, held_out, written
from .workers import lean

SPAN, MARGIN, PIECE = 192, 16, 64
PAD = 32


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text) if not text[:1].isalpha() else True


def text_bytes(text: str) -> bytes:
    return text.lower().encode()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Weights of the network; one set of gates (update, reset, candidate) for each direction."""

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[d + "E"] = (r.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)  # embedding times input weights
            self.p[d + "U"] = init(hidden, 3 * hidden)
            self.p[d + "b"] = np.zeros(3 * hidden, dtype=np.float32)
        self.p["W"] = init(2 * hidden, len(languages))
        self.p["c"] = np.zeros(len(languages), dtype=np.float32)

    def _scan(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each step of x (steps, batch); with ``keep``, what the way back needs."""
        H, U, E, b = self.hidden, self.p[d + "U"], self.p[d + "E"], self.p[d + "b"]
        h = np.zeros((x.shape[1], H), dtype=np.float32)
        out, tape = np.empty((*x.shape, H), dtype=np.float32), []
        for t in range(len(x)):
            a = E[x[t]]
            a += b
            g = _sigmoid(a[:, : 2 * H] + h @ U[:, : 2 * H])
            z, r = g[:, :H], g[:, H:]
            rh = r * h
            n = np.tanh(a[:, 2 * H:] + rh @ U[:, 2 * H:])
            new = h + z * (n - h)
            if keep:
                tape.append((h, z, r, n, rh))
            out[t] = h = new
        return out, tape

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, list]:
        f, tf = self._scan("f", x, keep)
        b, tb = self._scan("b", x[::-1], keep)
        return np.concatenate([f, b[::-1]], axis=2), tf, tb

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of (steps, batch, languages)."""
        z = self.states(x)[0] @ self.p["W"] + self.p["c"]
        z -= z.max(2, keepdims=True)
        return z - np.log(np.exp(z).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over the positions that count, and its gradients through time."""
        H, s = self.hidden, None
        s, tf, tb = self.states(x, True)
        z = s @ self.p["W"] + self.p["c"]
        z -= z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        n, at = mask.sum(), np.arange(x.shape[1])
        loss = -(np.log(p[:, at, y] + 1e-12) * mask).sum() / n
        dz = p
        dz[:, at, y] -= 1
        dz *= (mask / n)[:, :, None]
        g = {"W": s.reshape(-1, 2 * H).T @ dz.reshape(-1, dz.shape[2]), "c": dz.sum((0, 1))}
        ds = dz @ self.p["W"].T
        self._back("f", x, tf, ds[:, :, :H], g)
        self._back("b", x[::-1], tb, ds[::-1, :, H:], g)
        return float(loss), g

    def _back(self, d: str, x: np.ndarray, tape: list, ds: np.ndarray, g: dict) -> None:
        H, U = self.hidden, self.p[d + "U"]
        dU, da_all = np.zeros_like(U), np.empty((*x.shape, 3 * H), dtype=np.float32)
        dh = np.zeros((x.shape[1], H), dtype=np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, rh = tape[t]
            dh = dh + ds[t]
            da = da_all[t]
            dn = dh * z * (1 - n * n)
            drh = dn @ U[:, 2 * H:].T
            da[:, :H] = dh * (n - h) * z * (1 - z)
            da[:, H: 2 * H] = drh * h * r * (1 - r)
            da[:, 2 * H:] = dn
            dU[:, : 2 * H] += h.T @ da[:, : 2 * H]
            dU[:, 2 * H:] += rh.T @ dn
            dh = dh * (1 - z) + drh * r + da[:, : 2 * H] @ U[:, : 2 * H].T
        g[d + "U"] = dU
        g[d + "b"] = da_all.sum((0, 1))
        g[d + "E"] = np.zeros_like(self.p[d + "E"])
        np.add.at(g[d + "E"], x.ravel(), da_all.reshape(-1, 3 * H))


class Reader:
    """The network's way forward over many spans at once: units stand in rows and spans in columns, which keeps inner loops long."""

    def __init__(self, net: ByteGru):
        H = net.hidden
        self.hidden, self.many = H, len(net.languages)
        self.dirs = []
        for k, d in enumerate("fb"):
            E, U = net.p[d + "E"] + net.p[d + "b"], net.p[d + "U"]
            half = np.ones(3 * H, dtype=np.float32)
            half[: 2 * H] = 0.5  # a sigmoid is a tanh of half its argument
            self.dirs.append((np.ascontiguousarray((E * half).T), np.ascontiguousarray((U[:, : 2 * H] * 0.5).T), np.ascontiguousarray(U[:, 2 * H:].T),
                              np.ascontiguousarray(net.p["W"][k * H: (k + 1) * H].T)))
        self.c = net.p["c"][:, None]

    def _scan(self, d: int, x: np.ndarray, out: np.ndarray) -> None:
        """Adds this direction's share of the languages' scores to out (steps, languages, spans)."""
        E, U, V, W = self.dirs[d]
        H, n = self.hidden, x.shape[1]
        h, rh, zr, c = (np.zeros((k * H, n), dtype=np.float32) for k in (1, 1, 2, 1))
        a = np.empty((3 * H, n), dtype=np.float32)
        z, r = zr[:H], zr[H:]
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            np.take(E, x[t], axis=1, out=a, mode="clip")
            np.matmul(U, h, out=zr)
            zr += a[: 2 * H]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(r, h, out=rh)
            np.matmul(V, rh, out=c)
            c += a[2 * H:]
            np.tanh(c, out=c)
            c -= h
            c *= z
            h += c
            out[t] += W @ h

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of (steps, languages, spans)."""
        out = np.empty((len(x), self.many, x.shape[1]), dtype=np.float32)
        out[:] = self.c
        self._scan(0, x, out)
        self._scan(1, x, out)
        out -= out.max(1, keepdims=True)
        out -= np.log(np.exp(out).sum(1, keepdims=True))
        return out

    def sums(self, texts: list[bytes], spans: int = 2048) -> np.ndarray:
        """Each text's sum of its bytes' log probabilities."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        # Margins of blanks keep texts apart; a span's margins lie in its own text or in these.
        edge = b"\x20" * MARGIN
        flat = np.frombuffer(b"".join([edge + t + edge for t in texts]) + b"\x20" * (SPAN + 2 * MARGIN), dtype=np.uint8)
        start = np.concatenate(([0], np.cumsum(size + 2 * MARGIN)))[:-1]
        many = -(-size // SPAN)
        who = np.repeat(np.arange(len(texts)), many)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        begin = start[who] + nth * SPAN
        count = np.minimum(size[who] - nth * SPAN, SPAN)
        total = np.zeros((len(texts), self.many))
        # Spans of one length go together, so that short texts cost little.
        order = np.argsort(count, kind="stable")
        lo = 0
        while lo < len(order):
            part = order[lo: lo + spans]
            wide = int(count[part[-1]])
            if count[part[0]] < wide - 16:
                part = part[: max(1, int(np.searchsorted(count[part], count[part[0]] + 16, side="right")))]
                wide = int(count[part[-1]])
            at = np.arange(wide + 2 * MARGIN)[:, None] + begin[part][None, :]
            # Beyond a shorter span's own margin stands what follows it: blanks, or its text.
            x = np.where(at < (start + size + 2 * MARGIN)[who[part]][None, :], flat[at], PAD).astype(np.intp)
            p = self.log_probs(x)[MARGIN: MARGIN + wide]
            p *= (np.arange(wide)[:, None] < count[part][None, :])[:, None, :]
            np.add.at(total, who[part], p.sum(0, dtype=np.float64).T)
            lo += len(part)
        return total


def fit(pieces: list[tuple[bytes, int]], languages: list[str], *, hidden: int = 12, steps: int = 800, batch: int = 128,
        rate: float = 0.02, seed: int = 7) -> ByteGru:
    """Adam over random batches of pieces; each language is drawn as often as the others."""
    net, r = ByteGru(languages, hidden, seed), np.random.default_rng(seed)
    x = np.frombuffer(b"".join(p.ljust(PIECE)[:PIECE] for p, _ in pieces), dtype=np.uint8).reshape(-1, PIECE)
    size = np.array([min(len(p), PIECE) for p, _ in pieces])
    y = np.array([k for _, k in pieces])
    share = 1 / np.bincount(y, minlength=len(languages))[y]
    share /= share.sum()
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    draws = r.choice(len(x), (steps, batch), p=share)
    for step in range(1, steps + 1):
        i = draws[step - 1]
        mask = (np.arange(PIECE)[:, None] < size[i][None, :]).astype(np.float32)
        _, g = net.gradients(np.ascontiguousarray(x[i].T), y[i], mask)
        now = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k, grad in g.items():
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.01 * (grad * grad - v[k])
            net.p[k] -= (now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def text_pieces(text: str | None, number: int, most: int) -> list[bytes]:
    """At most ``most`` pieces of a text, spread over it; ``number`` moves them."""
    data = text_bytes(text or "")
    if len(data) <= PIECE:
        return [data] if data else []
    return [data[a: a + PIECE] for a in sorted({(number * 7919 + i * len(data) // most) % (len(data) - PIECE + 1) for i in range(most)})]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 300,
          pieces: int = 16, most_languages: int = 500, **options) -> ByteGru | None:
    """None if no document has a language and a letter."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    per = known.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["l"]: r["n"] for r in per.orderBy(F.desc("n"), "l").limit(most_languages).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, sample / n)])
    chosen = known.where(draw < share[F.col(lang_col)])
    rows = chosen.select(F.xxhash64(F.col(id_col)).alias("o"), F.col(lang_col).alias("l"), F.col(text_col).cast("string").alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(o, lang, p) for o, lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for p in text_pieces(t, o, pieces)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["o", "l", "p"])

    # Pieces of a fixed size, not texts, come to the driver; they are written first, as sorting would read the documents twice.
    drawn = written(rows.mapInArrow(lean(cut), "o long, l string, p binary"), "pieces")
    found = drawn.orderBy("o", "l", "p").collect()
    discard(drawn)
    place = {lang: i for i, lang in enumerate(languages)}
    return fit([(bytes(r["p"]), place[r["l"]]) for r in found], languages, **options) if found else None


class Labeller:
    """Document labels."""

    def __init__(self, net: ByteGru):
        self.net, self.reader = net, Reader(net)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if at:
            data = [text_bytes(texts[i]) for i in at]
            for i, d, total in zip(at, data, self.reader.sums(data), strict=True):
                mean = total / len(d)
                p = np.exp(mean - mean.max())
                p /= p.sum()
                best = int(p.argmax())
                names[i], scores[i] = self.net.languages[best], float(p[best])
        return names, scores


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, or of one row."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def predict(docs: DataFrame, net: ByteGru | None, *, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id, lang_pred, score``."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if net is None:
        return src.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))  # weights of a fixed size
    schema = T.StructType([src.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Labeller(pickle.loads(blob.value))
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], slice_bytes):
                names, scores = who.label(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=schema.names)

    return src.mapInArrow(lean(run), schema)
