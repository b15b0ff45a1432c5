"""Personal data: patterns with exact offsets, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: base spans found by pattern in a bounded sample of the corpus, and
generated ones in the same contexts, in other spellings than the patterns know (numbers without a plus, spelled-out
addresses, spaced digits), beside look-alikes that aren't personal data. Every character of every text goes through the
network, in overlapping windows, and has its scores from the window that holds it nearest to its middle. One Viterbi path
over the whole text reconciles the windows: where a character is outside of all spans on the best path (``sure``, an exact bound on what a span can gain), the path falls
apart, so only the stretches between such characters are decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents
from .textblocks import pieces

KINDS = ("email", "ip", "card", "phone")
BLOCK_BYTES = 512 << 10
TAGS = 1 + 2 * len(KINDS)  # outside, and beginning and inside of each kind
#: Texts with candidates that contexts and labelled spans are taken from, at most.
SAMPLE = 400
EXAMPLES, STEPS, BATCH, RATE = 4000, 1200, 64, 0.015
HIDDEN, EMBED = 12, 12
#: Characters of a window, those at either end that only give context to its middle, and windows that go through the network together.
WINDOW, CONTEXT, TOGETHER = 128, 12, 1024
#: Characters of a training example.
EXAMPLE = 64
#: Weight of the loss of single characters.
ALONE = 0.3
#: A span of the network counts if the path has it and its characters' share of the probability is this large.
CERTAIN = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each at sign, so that long runs cost linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind: leftmost, non-overlapping, failing matches dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _HINT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out["phone"].append(m.span())
    return out


# Characters as a few dozen classes: ASCII letters by themselves, other scripts as one.
_CODES = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 .,-+()@[]{}:;/_=%\"'\n#*!?|&$")}
SYMBOLS = len(_CODES) + 3
_code: np.ndarray | None = None


def encode(text: str) -> np.ndarray:
    """Class of each character; 0 stands for what is outside of a text."""
    global _code
    if _code is None:
        _code = np.array([_CODES.get(chr(c).lower() if c < 128 else chr(c), SYMBOLS - 1 if chr(c).isalpha() else SYMBOLS - 2) for c in range(0x110000)], np.uint8)
    return _code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


class Tagger:
    """Bidirectional LSTM over characters, and a linear-chain CRF over its tags."""

    def __init__(self, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        self.p = {"E": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "O": g(2 * HIDDEN, TAGS), "o": np.zeros(TAGS), "A": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS)}
        for side in "fb":
            self.p |= {f"W{side}": g(EMBED, 4 * HIDDEN), f"U{side}": g(HIDDEN, 4 * HIDDEN), f"c{side}": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])}
        # A span goes on only with its own kind.
        self.barred = np.zeros((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            self.barred[:, 2 + 2 * k] = True
            self.barred[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
        self.first = np.array([t > 0 and t % 2 == 0 for t in range(TAGS)])

    def transitions(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.barred, -1e4, self.p["A"]), np.where(self.first, -1e4, self.p["S"])

    def _side(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        n, T = x.shape[:2]
        h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        pre = x @ self.p[f"W{side}"] + self.p[f"c{side}"]
        out, kept = np.empty((n, T, HIDDEN), x.dtype), []
        for t in range(T) if side == "f" else range(T - 1, -1, -1):
            a = pre[:, t] + h @ self.p[f"U{side}"]
            gates = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            before, old = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            kept.append((t, before, old, f, i, o, g, tc))
        return out, kept

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.p["E"][x]
        (hf, kf), (hb, kb) = self._side(e, "f"), self._side(e, "b")
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["O"] + self.p["o"], (e, h, kf, kb)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags, on the paths and by the single characters' scores, and its gradient.

        The second part keeps characters apart without the transitions' help, so that few of them are unsure.
        """
        em, (e, h, kf, kb) = self.emissions(x)
        n, T, _ = em.shape
        A, S = self.transitions()
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = S + em[:, 0]
        for t in range(1, T):
            alpha[:, t] = em[:, t] + _lse(alpha[:, t - 1, :, None] + A, 1)
        for t in range(T - 2, -1, -1):
            beta[:, t] = _lse(A + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        share = np.exp(alpha + beta - z[:, None, None])
        gold = S[y[:, 0]] + np.take_along_axis(em, y[..., None], 2)[..., 0].sum(1) + A[y[:, :-1], y[:, 1:]].sum(1)
        d = share.copy()
        np.put_along_axis(d, y[..., None], np.take_along_axis(d, y[..., None], 2) - 1, 2)
        dS = d[:, 0].sum(0) / n
        alone = np.exp(em - _lse(em, 2)[..., None])
        single = -np.log(np.take_along_axis(alone, y[..., None], 2)).sum() / n
        np.put_along_axis(alone, y[..., None], np.take_along_axis(alone, y[..., None], 2) - 1, 2)
        d = (d + ALONE * alone) / n
        dA = np.zeros((TAGS, TAGS))
        for t in range(1, T):
            dA += np.exp(alpha[:, t - 1, :, None] + A + (em[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(dA, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
        g = {"A": np.where(self.barred, 0, dA / n), "S": np.where(self.first, 0, dS), "o": d.sum((0, 1)), "O": np.einsum("nth,ntk->hk", h, d)}
        dh = d @ self.p["O"].T
        de = np.zeros_like(e)
        for side, kept, part in (("f", kf, dh[..., :HIDDEN]), ("b", kb, dh[..., HIDDEN:])):
            W, Us = self.p[f"W{side}"], self.p[f"U{side}"]
            gW, gU, gc = np.zeros_like(W), np.zeros_like(Us), np.zeros(4 * HIDDEN)
            later, carry = np.zeros((n, HIDDEN), e.dtype), np.zeros((n, HIDDEN), e.dtype)
            for t, before, old, f, i, o, gg, tc in reversed(kept):
                dhid = part[:, t] + later
                dc = dhid * o * (1 - tc**2) + carry
                da = np.concatenate([dc * old * f * (1 - f), dc * gg * i * (1 - i), dhid * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                carry, later = dc * f, da @ Us.T
                gW += e[:, t].T @ da
                gU += before.T @ da
                gc += da.sum(0)
                de[:, t] += da @ W.T
            g |= {f"W{side}": gW, f"U{side}": gU, f"c{side}": gc}
        gE = np.zeros_like(self.p["E"])
        np.add.at(gE, x.reshape(-1), de.reshape(-1, EMBED))
        return float((z - gold).mean() + ALONE * single), g | {"E": gE}

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 4) -> None:
        """Adam in single precision."""
        rng = np.random.Generator(np.random.PCG64(seed))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            part = rng.integers(0, len(x), BATCH)
            _, g = self.loss(x[part], y[part])
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / (STEPS + 1)))
            for k, v in g.items():
                v = v.astype(np.float32) * np.float32(min(1.0, 5 / (norm + 1e-9)))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v**2
                self.p[k] = self.p[k] - np.float32(rate) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def path(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of a stretch that begins a text or follows an outside character, and ends a text or comes before one; shares of the probability."""
        A, S = self.transitions()
        T = len(em)
        score, back = np.empty_like(em), np.zeros(em.shape, np.int64)
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        score[0] = alpha[0] = S + em[0]
        for t in range(1, T):
            step = score[t - 1][:, None] + A
            back[t] = step.argmax(0)
            score[t] = em[t] + step.max(0)
            alpha[t] = em[t] + _lse(alpha[t - 1][:, None] + A, 0)
        for t in range(T - 2, -1, -1):
            beta[t] = _lse(A + (em[t + 1] + beta[t + 1])[None, :], 1)
        tags = np.zeros(T, np.int64)
        tags[-1] = score[-1].argmax()
        for t in range(T - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        share = np.exp(alpha + beta - _lse(alpha[-1], 0))
        return tags, share[np.arange(T), tags]

    def sure(self, em: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Characters that are outside on the best path of their text, whatever else is on it. Scores by tag; ``ends``: offsets of texts.

        A span of the best path must gain something over outside characters in its place, as these are always allowed. Its
        gain is at most what entering and leaving it can give, and what its first and its later characters give; the largest
        such sum over all stretches that hold a character comes from running maxima of prefix sums.
        """
        A, S = self.transitions()
        after = [t for t in range(TAGS) if not self.barred[0, t]]  # what may follow an outside character
        size = np.diff(ends)
        out = np.ones(em.shape[1], bool)
        texts = np.flatnonzero(size)
        for kind in range(len(KINDS)):
            b, i = 1 + 2 * kind, 2 + 2 * kind
            enter = max(S[b] - S[0], *(A[p, b] - A[p, 0] for p in range(TAGS)))
            leave = max(0.0, *(A[last, q] - A[0, q] for last in (b, i) for q in after))
            slack = float(enter + leave) + 1e-2
            begin, later = em[b] - em[0], em[i] - (em[0] - np.float32(max(A[b, i], A[i, i]) - A[0, 0]))
            # Texts in which no character gives anything need no sums.
            some = texts[(np.maximum.reduceat(begin, ends[texts]) + slack >= 0) | (np.maximum.reduceat(later, ends[texts]) >= 0)]
            if not len(some):
                continue
            n = size[some]
            own = np.repeat(ends[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.arange(len(own)) + np.repeat(np.arange(len(some)), n)
            # No stretch goes on into the next text.
            total, first = np.full(len(own) + len(some), -1e8), np.full(len(own) + len(some), -1e8)
            total[place], first[place] = later[own], begin[own]
            np.cumsum(total, out=total)
            first -= total
            np.maximum.accumulate(first, out=first)
            first += np.maximum.accumulate(total[::-1])[::-1]
            out[own] &= first[place] + slack < 0
        return out


class Fast:
    """The network's emissions in single precision, many windows at a time, all gates by one exponential."""

    def __init__(self, tagger: Tagger):
        p = {k: v.astype(np.float32) for k, v in tagger.p.items()}
        scale = np.ones(4 * HIDDEN, np.float32)
        scale[3 * HIDDEN :] = 2  # tanh(x) = 2 / (1 + exp(-2 x)) - 1
        self.sides = [(-(p["E"] @ p[f"W{s}"] + p[f"c{s}"]) * scale, -p[f"U{s}"] * scale) for s in "fb"]
        self.O, self.o = p["O"], p["o"]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of the tags, by place and window, for the middles of windows of codes."""
        T, n = x.shape
        a, b, g = np.empty((n, 4 * HIDDEN), np.float32), np.empty((n, 4 * HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
        out = None
        for side, (table, U) in enumerate(self.sides):
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            states = np.empty((T, n, HIDDEN), np.float32)
            for t in range(T - CONTEXT) if side == 0 else range(T - 1, CONTEXT - 1, -1):
                np.take(table, x[t], axis=0, out=a, mode="clip")
                a += np.matmul(h, U, out=b)
                np.exp(a, out=a)
                a += 1
                np.reciprocal(a, out=a)
                np.multiply(a[:, 3 * HIDDEN :], 2, out=g)
                g -= 1
                c *= a[:, :HIDDEN]
                g *= a[:, HIDDEN : 2 * HIDDEN]
                c += g
                h = np.tanh(c, out=states[t])
                h *= a[:, 2 * HIDDEN : 3 * HIDDEN]
            part = states[CONTEXT : T - CONTEXT].reshape(-1, HIDDEN) @ self.O[side * HIDDEN : (side + 1) * HIDDEN]
            out = part if out is None else out + part
        return (out + self.o).reshape(T - 2 * CONTEXT, n, TAGS)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def text_emissions(codes: np.ndarray, ends: np.ndarray, fast: Fast) -> np.ndarray:
    """Scores of the tags, by tag, for every character of the texts."""
    step, size = WINDOW - 2 * CONTEXT, np.diff(ends)
    count = -(-size // step)
    text = np.repeat(np.arange(len(size)), count)
    start = ends[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    out = np.empty((TAGS, len(codes)), np.float32)
    for lo in range(0, len(text), TOGETHER):
        first, last, begin = start[lo : lo + TOGETHER], ends[1:][text[lo : lo + TOGETHER]], ends[:-1][text[lo : lo + TOGETHER]]
        at = first + np.arange(-CONTEXT, WINDOW - CONTEXT)[:, None]
        inside = (at >= begin) & (at < last)
        np.clip(at, 0, len(codes) - 1, out=at)
        em = fast.emissions(codes[at] * inside)
        middle = slice(CONTEXT, WINDOW - CONTEXT)
        use = inside[middle].T
        # Middles lie one after the other, without the places past their texts' ends.
        got = em.transpose(2, 1, 0)[:, use]
        out[:, first[0] : first[0] + got.shape[1]] = got
    return out


def found_spans(texts: list[str], tagger: Tagger, fast: Fast | None = None) -> list[list[tuple[str, int, int]]]:
    """Spans of the network in each whole text."""
    fast = fast or Fast(tagger)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if not ends[-1]:
        return out
    em = text_emissions(encode("".join(texts)), ends, fast)
    unsure = ~tagger.sure(em, ends)
    edge = np.diff(np.concatenate([[0], unsure.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Stretches end with their text.
    cuts = ends[(ends > 0) & (ends < ends[-1])]
    cuts = cuts[unsure[cuts] & unsure[cuts - 1]]
    lo, hi = np.sort(np.concatenate([lo, np.unique(cuts)])), np.sort(np.concatenate([hi, np.unique(cuts)]))
    row = np.searchsorted(ends, lo, "right") - 1
    S = tagger.transitions()[1]
    A = tagger.transitions()[0]
    for i, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
        start, stop = int(ends[i]), int(ends[i + 1])
        part = em[:, a:b].T.astype(np.float64)
        if a > start:
            part[0] += A[0] - S  # an outside character stands before, not a text's beginning
            part[0, tagger.first] = -1e4
        if b < stop:
            part[-1] += A[:, 0]
        tags, share = tagger.path(part)
        t = 0
        while t < len(tags):
            if tags[t] % 2 == 1:
                kind, end = int(tags[t] // 2), t + 1
                while end < len(tags) and tags[end] == tags[t] + 1:
                    end += 1
                x, y = a - start + t, a - start + end
                if share[t:end].min() >= CERTAIN and plausible(KINDS[kind], texts[i][x:y], texts[i], x, y):
                    out[i].append((KINDS[kind], x, y))
                t = end
            else:
                t += 1
    return out


def plausible(kind: str, span: str, text: str, start: int, end: int) -> bool:
    """Whether a span has what its kind must have and is no part of a longer word or number."""
    n = sum(c.isdigit() for c in span)
    if (start and text[start - 1].isalnum() and span[0].isalnum()) or (end < len(text) and text[end].isalnum() and span[-1].isalnum()):
        return False
    if kind == "email":
        return "." in span and ("@" in span or bool(re.search(r"[\[( ](at|AT)[\]) ]", span)))
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= n <= 19 and luhn(digits)
    return 9 <= n <= 15 and span[0] in "+(0123456789"


def examples(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of characters and tags: spans and look-alikes, put into contexts of the given texts."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda options: options[rng.integers(len(options))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    letters = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))

    def card() -> str:
        body = str(rng.integers(3, 7)) + digits(int(rng.integers(11, 18)))
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        gap = pick(["", " ", "-", " ", "."])
        return number if gap == "" else gap.join(number[i : i + 4] for i in range(0, len(number), 4))

    def email() -> str:
        name = letters(3, 9) + pick(["", ".", "_"]) + pick(["", digits(2), letters(2, 6)])
        host, end = letters(3, 9) + pick(["", digits(1)]), pick(["com", "org", "net", "example.com", "co.uk", "de", "fr"])
        return pick([f"{name}@{host}.{end}", f"{name}@{host}.{end}", f"{name} [at] {host}.{end}", f"{name} (at) {host}.{end}", f"{name} at {host}{digits(1)}.{end}"])

    def ip() -> str:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return pick([".", ".", ".", " . ", "[.]"]).join(parts)

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(3)} {digits(6)}", f"{a}.{b}.{c}", f"+{digits(2)}-{digits(3)}-{digits(3)}-{digits(2)}"])

    def other() -> str:
        v = digits(1)
        return pick([
            f"{v}.", f"{v}.{digits(1)}.", f"{v}.{digits(2)}", f"{v}.{digits(1)}.{digits(1)}", digits(4), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}",
            "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "password=" + "".join(pick("0123456789abcdef") for _ in range(18)), "".join(pick("0123456789abcdef") for _ in range(40)), f"@{letters(3, 8)}", digits(8), digits(12), f"{letters(2, 6)}{digits(2)}", f"{digits(2)} @ {digits(2)}",
        ])

    makers = (email, ip, card, phone)
    contexts = [t for t in texts if len(t) > EXAMPLE] or ["the words of this text stand around what is found in it, and so on for a while. " * 2]
    x, y = np.zeros((EXAMPLES, EXAMPLE), np.int64), np.zeros((EXAMPLES, EXAMPLE), np.int64)
    for n in range(EXAMPLES):
        t = pick(contexts)
        at = int(rng.integers(0, len(t) - EXAMPLE))
        around = t[at : at + EXAMPLE]
        if n % 8 == 7:  # as the corpus has it, with its base spans
            where = next((a for s in base_spans(t).values() for a, _ in s), at)
            lo = max(0, min(where - int(rng.integers(0, EXAMPLE // 2)), len(t) - EXAMPLE))
            around = t[lo : lo + EXAMPLE]
            marks = [(k, a - lo, b - lo) for k, (_, s) in enumerate(base_spans(t).items()) for a, b in s if a < lo + EXAMPLE and b > lo]
            text = around
        else:
            text, marks = "", []
            cut = int(rng.integers(5, 30))
            text = around[:cut].rsplit(" ", 1)[0] + " "
            for _ in range(int(rng.integers(1, 3))):
                k = int(rng.integers(0, 7))
                item = makers[k]() if k < 4 else other()
                if k < 4:
                    marks.append((k, len(text), len(text) + len(item)))
                text += item + pick([" ", ", ", ". ", " ", "\n"])
            text += around[cut:]
        # Some begin a text: nothing stands before them in their window.
        gap = int(rng.integers(0, CONTEXT + 1)) if n % 4 == 0 else 0
        c = encode(text[: EXAMPLE - gap])
        x[n, gap : gap + len(c)] = c
        for k, a, b in marks:
            a, b = max(a, 0) + gap, min(b + gap, EXAMPLE)
            if a < b:
                y[n, a:b] = 2 + 2 * k
                y[n, a] = 1 + 2 * k
    return x, y


def learn(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Train on the contexts of about ``sample`` texts, taken by a hash of id and text and cut around their first candidate.

    The bound on the hash comes from the number of rows, so what reaches the driver is about 2 * ``sample`` short strings
    whatever the size of the table; a table that repeats one row more often than that gives fewer contexts.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("lot"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    n = rows.count()
    share = min(1.0, 4 * sample / max(1, n))
    few = rows.where(F.col("lot") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).where(F.col("text").rlike("[0-9@]"))
    near = F.regexp_extract("text", r"(?s)([^0-9@]{0,100}[0-9@].{0,200})", 1)
    chosen = few.select("lot", F.substring(near, 1, 301).alias("near")).dropDuplicates(["lot"]).orderBy("lot").limit(sample).collect()
    tagger = Tagger()
    tagger.train(*examples([r["near"] for r in chosen]))
    return tagger


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _find(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, fast = shared.value, Fast(shared.value)
        for batch in batches:
            for part in pieces(batch, most=BLOCK_BYTES):
                texts = [x or "" for x in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                rows = []
                for b, more in zip(base, found_spans(texts, tagger, fast), strict=True):
                    flat = [(k, x, y) for k in KINDS for x, y in b[k]]
                    added = [s for s in more if not any(s[1] < y and x < s[2] for _, x, y in flat)]
                    rows.append((*(len(b[k]) for k in KINDS), hashlib.sha256(_joined(flat).encode()).hexdigest(), _joined(flat + added), len(added)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def personal_data(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Base spans and the network's further spans of every row, in code points.

    Null and empty texts have none. Spans of the network that touch a base span are left out, base spans always stay. Rows
    are judged one by one, so repeated rows get equal results; extra columns are ignored, no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(tagger)), _OUT)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return personal_data(docs, learn(docs))
