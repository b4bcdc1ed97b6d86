"""Personal data by a skip-chain conditional random field over mentions.

Base spans come from fixed patterns per kind (email, ip, card, phone) with their checks.
Further mentions that could be personal data (runs of digits and separators, disguised
addresses) become nodes of a field beside the base spans.  Neighbouring mentions share a chain
potential; mentions that repeat or resemble each other anywhere in the document share a skip
potential, so that a variant written without its plus sign or at its full length takes the
label of the occurrence that a pattern proves.  Labels come from loopy belief propagation;
base spans are clamped to their kind.  Mentions that get a kind are added as spans.

The weights are learned by pseudo-likelihood from the base labels of a bounded share of the
documents; a mention that resembles a base span without being one has no label there.

Defined results: a null or empty text has no spans; rows with the same ``doc_id`` are searched
one by one; spans of different kinds may overlap; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import ship, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Documents that the weights are learned from, about; chosen by hashed id.
TRAIN_DOCS = 20_000
ROUNDS = 20
DAMPING = 0.5
CHAIN_REACH = 200
TAIL = 7  # digits at the end that make two numbers similar
CLAMP = 40.0
#: Least log odds against personal data of a mention that no pattern proves, before its neighbours are heard.
DOUBT = 6.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its start only: a match from its inside would end alike
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[ ().-]{0,3}[0-9]){6,30}(?![0-9A-Za-z])")
_DISGUISED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,64})+", re.I)


# ---------------------------------------------------------------- base spans
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text by start, then kind; positions are code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            d = _only_digits(m.group()) if m.end() - m.start() <= 38 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


# ---------------------------------------------------------------- the field of one document
def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(label, start, end): base spans with their kind's label, other mentions with -1."""
    found = [(LABELS.index(k), a, b) for k, a, b in base]
    more: list[tuple[int, int]] = []
    if _DIGIT.search(text):
        more += [m.span() for m in _NUMBER.finditer(text) if 7 <= len(_only_digits(m.group())) <= 19]
    low = text.lower()
    if "@" in text or "(at)" in low or "[at]" in low:
        more += [m.span() for m in _DISGUISED.finditer(text)]
    taken = sorted((a, b) for _, a, b in found)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    for a, b in more:
        i = int(np.searchsorted(starts, b)) - 1  # base spans that start before its end
        if i < 0 or reach[i] <= a:
            found.append((-1, a, b))
    return sorted(found, key=lambda m: (m[1], m[2], m[0]))


def features(s: str) -> list[float]:
    d = _only_digits(s)
    parts = s.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
    return [1.0, "+" in s, "@" in s, "(at)" in s.lower() or "[at]" in s.lower(), any(c.isalpha() for c in s), 7 <= len(d) <= 9,
            10 <= len(d) <= 11, 12 <= len(d) <= 13, 14 <= len(d) <= 15, len(d) == 16, 17 <= len(d) <= 19, quad,
            quad and all(_byte(p) for p in parts), bool(14 <= len(d) <= 19 and luhn(d)), "(" in s, "-" in s, " " in s]


N_FEATURES = len(features("0"))


def form(s: str) -> str:
    """What a mention has in common with its variants."""
    if any(c.isalpha() for c in s):
        s = re.sub(r"[(\[]at[)\]]", "@", s.lower())
        return re.sub(r"[(\[]dot[)\]]", ".", s).replace(" ", "").strip(".")
    return _only_digits(s)


def edges(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip): pairs of mentions.  Similar mentions are tied to the one before and to
    the first of their group, so the edges grow with the mentions and not with their square."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][1] - found[i][2] <= CHAIN_REACH]
    groups: dict[str, list[int]] = defaultdict(list)
    for i, (_, a, b) in enumerate(found):
        f = form(text[a:b])
        groups[f].append(i)
        if f.isdigit() and len(f) > TAIL:
            groups["~" + f[-TAIL:]].append(i)
        elif f.isdigit():
            groups["~" + f].append(i)
    skip = set()
    for g in groups.values():
        # the first base span leads its group
        lead = next((i for i in g if found[i][0] > 0), g[0])
        skip.update((min(x, y), max(x, y)) for x, y in zip(g, g[1:]))
        skip.update((min(lead, x), max(lead, x)) for x in g if x != lead)
    return chain, sorted(skip)


def propagate(unary: np.ndarray, pairs: list[tuple[int, int]], weight: np.ndarray) -> np.ndarray:
    """Marginals by loopy sum-product with damping; an edge adds its weight where labels agree."""
    if not pairs:
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    a, b = np.asarray(pairs, np.int64).T
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    w = np.exp(np.concatenate([weight, weight]))[:, None]
    log_m = np.zeros((len(src), unary.shape[1]))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, log_m)
        out = belief[src] - log_m[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(out.sum(1, keepdims=True) + (w - 1) * out)
        new -= new.max(1, keepdims=True)
        new = DAMPING * log_m + (1 - DAMPING) * new
        done = np.abs(new - log_m).max() < 1e-6
        log_m = new
        if done:
            break
    belief = unary.copy()
    np.add.at(belief, dst, log_m)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Field:
    """Learned weights: one row per label over the features, then the two agreement weights."""

    def __init__(self, unary: np.ndarray, chain: float, skip: float):
        self.unary, self.chain, self.skip = unary, chain, skip

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans) of a text."""
        base = base_spans(text)
        found = mentions(text, base)
        if all(m[0] >= 0 for m in found):
            return base, base
        x = np.asarray([features(text[a:b]) for _, a, b in found], float)
        unary = x @ self.unary.T
        for i, (label, _, _) in enumerate(found):
            if label >= 0:
                unary[i, label] += CLAMP
            else:  # the patterns have spoken: features alone cannot make it personal data
                unary[i] = np.clip(unary[i] - unary[i, 0], -DOUBT - 3.0, -DOUBT)
                unary[i, 0] = 0.0
        chain, skip = edges(text, found)
        weight = np.asarray([self.chain] * len(chain) + [self.skip] * len(skip))
        label = propagate(unary, chain + skip, weight).argmax(1)
        added = [(LABELS[label[i]], a, b) for i, (own, a, b) in enumerate(found) if own < 0 and label[i] > 0]
        return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---------------------------------------------------------------- learning
def fit(rows: list, l2: float = 1.0, steps: int = 400) -> Field:
    """Pseudo-likelihood: each labelled mention given its neighbours' labels.  A row is
    (label, features, [chain neighbours per label], [skip neighbours per label])."""
    n = len(LABELS)
    if not rows:
        prior = np.zeros((n, N_FEATURES))
        prior[0, 0] = 4.0
        return Field(prior, 0.0, DOUBT + 5.0)
    y = np.asarray([r[0] for r in rows])
    x = np.asarray([r[1] for r in rows], float)
    c, s = (np.asarray([r[i] for r in rows], float) for i in (2, 3))
    w, wc, ws = np.zeros((n, N_FEATURES)), 0.0, 0.0
    hot = np.eye(n)[y]
    rate = 4.0 / len(rows)
    moment = [np.zeros_like(w), 0.0, 0.0]
    for _ in range(steps):
        z = x @ w.T + wc * c + ws * s
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = hot - p
        grads = (g.T @ x - l2 * w, float((g * c).sum()) - l2 * wc, float((g * s).sum()) - l2 * ws)
        moment = [0.9 * m + rate * d for m, d in zip(moment, grads)]
        w, wc, ws = w + moment[0] * 0.1, wc + moment[1] * 0.1, ws + moment[2] * 0.1
    # a proved occurrence must be able to carry its variants, and chain neighbours must not
    return Field(w, min(max(wc, 0.0), DOUBT / 4), max(ws, DOUBT + 5.0))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    ship(docs.sparkSession)
    n = docs.count()
    share = min(1.0, train_docs / max(n, 1))
    rows = docs.select(text_or_empty().alias("text")).where(
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("weights")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(LABELS)
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                found = mentions(t, base_spans(t))
                if not found:
                    continue
                chain, skip = edges(t, found)
                sides = np.zeros((2, len(found), k))
                proved = [False] * len(found)
                for which, pairs in enumerate((chain, skip)):
                    for a, b in pairs:
                        for x, y in ((a, b), (b, a)):
                            sides[which, x, max(found[y][0], 0)] += 1
                            proved[x] |= which == 1 and found[y][0] > 0
                for i, (label, a, b) in enumerate(found):
                    if label >= 0 or not proved[i]:
                        out.append((max(label, 0), [float(v) for v in features(t[a:b])], sides[0, i].tolist(), sides[1, i].tolist()))
            if out:
                yield pd.DataFrame(out, columns=["y", "x", "c", "s"])

    got = rows.mapInPandas(examples, "y int, x array<double>, c array<double>, s array<double>").collect()
    return fit(sorted(tuple(r) for r in got))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(field)

    def listed(spans) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = held.value
        nothing = hashlib.sha256(b"").hexdigest()
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                base, spans = f.spans(t)
                if spans:
                    kinds = [k for k, _, _ in spans]
                    out.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(listed(base).encode()).hexdigest(),
                                listed(spans), len(spans) - len(base)))
                else:
                    out.append((0, 0, 0, 0, nothing, "", 0))
            frame = pd.DataFrame(out, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
            frame.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield frame

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(
        run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def op5_pii_crf(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs))
