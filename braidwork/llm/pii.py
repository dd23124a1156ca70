"""Personal data by exact patterns and by weak supervision.

Four kinds have exact patterns, whose matches always count. Beyond them, looser candidates (national phone numbers,
disguised addresses, credentials) get votes from labelers: strict form, gazetteers, words around, checksums and shape,
and being part of a longer token. The votes on all candidates of the corpus are counted by pattern; expectation
maximisation estimates from the counts how reliable each labeler is on each kind and how likely each candidate is to be
real, and a logistic classifier of span features is trained on those likelihoods. It decides on the candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, utf8

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails at the first digit of a run fails at the others too; the lookbehind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE = (
    ("phone", re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
    # a run of local characters is entered at its first one only, and not gone back into, so that long runs stay linear
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]+)+")),
    ("secret", re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_-]?key)\x20*+[=:]\x20*+[\"']?([A-Za-z0-9+/_=-]{8,})", re.IGNORECASE)),
)
#: Texts without any of these bytes hold no candidate.
_HINT = np.zeros(256, dtype=bool)
_HINT[[*b"0123456789@[(=:"]] = True

#: Gazetteers: fixed values. Top-level domains in wide use, and words that stand before personal data in English, German,
#: French and Spanish.
_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro io co me app dev ai xyz online site shop "
    "at au be br ca ch cn cz de dk es eu fi fr gr hk hu ie il in it jp kr mx nl no nz pl pt ro ru se sg sk tr tw ua uk us za".split()
)
_CUES = {
    "email": ("mail", "contact", "write to", "reach", "kontakt", "schreib", "courriel", "correo", "contacto", "@"),
    "ip": ("ip", "host", "server", "address", "adresse", "serveur", "servidor", "gateway", "dns"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "kredit", "carte", "tarjeta", "zahlung"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "contact", "anruf", "handy", "portable", "llamar", "movil"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "passwort", "mot de passe", "clave", "contrase"),
}


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if n % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the exact patterns, leftmost and non-overlapping per kind; linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    out += [(*m.span(), "card") for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Looser spans that no base span overlaps."""
    found = [(*m.span(m.lastindex or 0), kind) for kind, pattern in _LOOSE for m in pattern.finditer(text)]
    taken, out, i = sorted(b[:2] for b in base), [], 0
    reach = 0
    for s in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1])):
        while i < len(taken) and taken[i][0] < s[1]:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= s[0]:
            out.append(s)
            reach = max(reach, s[1])
    return out


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """One vote per labeler: 1 real, 2 not, 0 abstains."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 1]
    d = _digits(span)
    strict = {
        "email": "@" in span or bool(re.search(r"[\[(](at|AT)[\])]", span)),
        "ip": span.count(".") == 3,
        "card": len(d) >= 14,
        "phone": span[0] == "+" or len(d) == 10,
        "secret": len(span) >= 12,
    }[kind]
    tail = re.split(r"[.\]) ]+", span.lower())[-1]
    known = {
        "email": 1 if tail in _DOMAINS else 2,
        "ip": 0 if span[0] != "0" else 2,
        "card": 1 if d[:1] in "3456" else 2,
        "phone": 1 if d[:1] not in "01" or span[0] == "+" else 2,
        "secret": 2 if span.lower() in _CUES["secret"] or span.isalpha() else 0,
    }[kind]
    cue = 1 if any(c in before.lower() for c in _CUES[kind]) else 0
    shape = {
        "email": 1 if len(span) <= 100 else 2,
        "ip": 1 if all(p.isdigit() and int(p[:9]) <= 255 for p in span.split(".")) else 2,
        "card": 1 if luhn(d) else 2,
        "phone": 1 if 10 <= len(d) <= 15 and len(set(d)) > 2 else 2,
        "secret": 1 if len(set(span)) >= 8 and d else 2,
    }[kind]
    within = 2 if (before[-1:].isalnum() or after.isalnum()) else 1
    return (1 if strict else 2, known, cue, shape, within)


def features(text: str, start: int, end: int, kind: str) -> str:
    """The span's votes and coarse form as one key; there are few distinct keys, whatever the corpus."""
    span = text[start:end]
    size, part = min((end - start) // 8, 4), min(4 * len(_digits(span)) // max(len(span), 1), 3)
    edge = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    return f"{KINDS.index(kind)}{''.join(map(str, votes(text, start, end, kind)))}{size}{part}{edge(text[max(start - 1, 0) : start])}{edge(text[end : end + 1])}"


def reliabilities(keys: list[str], counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability that a candidate with each key is real: two-class EM over votes, separately for each kind."""
    kinds = np.array([int(k[0]) for k in keys])
    v = np.array([[int(c) for c in k[1:6]] for k in keys])
    out = np.zeros(len(keys))
    for kind in np.unique(kinds):
        own = kinds == kind
        x, n = v[own], counts[own].astype(float)
        p = np.clip(((x == 1).sum(1) + 0.5) / ((x > 0).sum(1) + 1), 0.05, 0.95)  # start from the majority
        for _ in range(rounds):
            prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
            log_real, log_not = np.full(len(x), np.log(prior)), np.full(len(x), np.log(1 - prior))
            for j in range(x.shape[1]):
                for value in (1, 2):
                    is_, voted = x[:, j] == value, x[:, j] > 0
                    agree = 4.0 if value == 1 else 1.0  # prior counts: labelers are more often right than wrong
                    real = ((n * p)[is_].sum() + agree) / ((n * p)[voted].sum() + 5)
                    fake = ((n * (1 - p))[is_].sum() + 5 - agree) / ((n * (1 - p))[voted].sum() + 5)
                    log_real[is_] += np.log(real)
                    log_not[is_] += np.log(fake)
            p = 1 / (1 + np.exp(np.clip(log_not - log_real, -30, 30)))
        out[own] = p
    return out


def _design(keys: list[str]) -> np.ndarray:
    """One-hot columns for every position of the key, by kind where it is a vote."""
    x = np.zeros((len(keys), 1 + 10 + 5 * 15 + 4 * 5))
    for i, k in enumerate(keys):
        kind, own = int(k[0]), [int(c) for c in k]
        x[i, 0] = x[i, 1 + kind] = 1
        for j in range(5):
            x[i, 11 + 15 * j + 3 * kind + own[1 + j]] = 1
        for j in range(4):
            x[i, 86 + 5 * j + own[6 + j]] = 1
    return x


def train(keys: list[str], counts: np.ndarray, steps: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights of the span classifier, fitted to the EM likelihoods of the counted keys."""
    if not keys:
        return np.zeros(106)
    x, y, n = _design(keys), reliabilities(keys, counts), np.sqrt(counts.astype(float))
    w, n = np.zeros(x.shape[1]), n / n.sum()
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _hinted(part: pa.RecordBatch, column: str = "t") -> list[str | None]:
    """The texts that can hold a span; None for the others."""
    data, at = utf8(part.column(column))
    seen = np.concatenate([[0], np.cumsum(_HINT[data])])
    some = seen[at[1:]] > seen[at[:-1]]
    return [t.as_py() if s else None for t, s in zip(part.column(column), some.tolist())]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "t"):
        count: dict[str, int] = {}
        for t in _hinted(part):
            if t is not None:
                base = base_spans(t)
                for s in [*base, *candidates(t, base)]:
                    k = features(t, *s)
                    count[k] = count.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["k", "n"])


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def learned(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Weights of the span classifier, from the vote patterns of all candidates in docs."""
    counted = docs.select(F.col(text_col).alias("t")).mapInArrow(_keys, "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
    return train([r.k for r in counted], np.array([r.n for r in counted]))


class _Spans:
    """The exact spans of a text, and all of them; what the classifier says of a key is kept."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.sure = weights, {}

    def real(self, key: str) -> bool:
        if key not in self.sure:
            self.sure[key] = bool((_design([key]) @ self.weights)[0] > 0)
        return self.sure[key]

    def __call__(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        base = base_spans(text)
        more = [s for s in candidates(text, base) if self.real(features(text, *s))]
        return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, counts and digest of the exact spans, and all spans as text.

    Spans are kind:start:end in code points, end exclusive. A null or empty text has none. Repeated rows give repeated
    rows, null ids stay, an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    weights, kind = learned(docs, text_col), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _Spans(weights)
        for part in slices(batches, "t"):
            out: list[tuple] = []
            for t in _hinted(part):
                base, every = spans(t) if t is not None else ([], [])
                n = [sum(s[2] == k for s in base) for k in BASE]
                out.append((*n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part.column("i"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["i", *names])

    return rows.mapInArrow(run, f"i {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string").withColumnRenamed("i", id_col)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans replaced by <KIND>; spans that overlap are one, under the kinds of all of them."""
    joined: list[list] = []
    for a, b, k in sorted(spans):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
            joined[-1][2] += [k] * (k not in joined[-1][2])
        else:
            joined.append([a, b, [k]])
    out, at = [], 0
    for a, b, k in joined:
        out += [text[at:a], f"<{'/'.join(sorted(k, key=KINDS.index)).upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """docs with every span of the text masked; weights are those learned from docs, unless given.

    All rows and columns stay as they are otherwise, also repeated ones; a null text stays null."""
    weights = learned(docs, text_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _Spans(weights)
        for part in slices(batches, text_col):
            texts = [masked(h, spans(h)[1]) if h else t for h, t in zip(_hinted(part, text_col), part.column(text_col).to_pylist())]
            place = part.schema.get_field_index(text_col)
            yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
