"""Personal data: exact patterns, and a skip-chain conditional random field that adds spans.

The field's nodes are the tokens that hold a digit or an at sign (tokens without
either can only be ``none`` and act through the features of their neighbours).
Consecutive nodes of a document share a potential, and so do nodes that repeat or
resemble an earlier one, however far away. Pattern matches are observed labels.
Loopy sum-product messages carry them to the other mentions; a node whose
marginal passes the threshold becomes a span. The weights are fitted by
pseudo-likelihood on documents that are made by rule, so that they don't depend
on the corpus.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import per_row, ship, table

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
THRESHOLD, DAMPING = 0.95, 0.3
#: Messages are passed until none changes by more than TOLERANCE, in ROUNDS rounds at most.
TOLERANCE, ROUNDS = 1e-4, 300

Span = tuple[int, int, int]  # kind, start, end

# ---------------------------------------------------------------- patterns

#: Possessive forms of the contract's patterns: the same matches, in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, by kind, then start; code points, end exclusive."""
    out: list[Span] = []
    if "@" in text:
        past = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > past and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                past = m.end()
                out.append((0, start, past))
    if _ANY.search(text) is None:
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x) < 4 and int(x) <= 255 or int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# ---------------------------------------------------------------- the field

#: Tokens with a digit or an at sign; tried at the starts of tokens only and possessive, so that it takes linear time.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_NUMBER = re.compile(r"[0-9()+.\-/]+\Z")
_CUES = (("mail", "write", "contact"), ("ip", "host", "server", "address", "login"), ("card", "visa", "paid", "credit", "pay"), ("phone", "call", "tel", "mobile", "fax", "dial"), ("version", "year", "page", "no", "id", "order", "section", "license", "total", "in"))
_STRIP = ".,;:!?\"'<>[]{}|*#$%&-"
FEATURES = ["bias", "at", "at+dot", "letters", "len<=4", "4<len<=6", "7<=len<=9", "10<=len<=12", "13<=len<=15", "16<=len", "dots3", "dots1", "dots2", "luhn16", "parens", "dashes2", "plus", "year", "date", "hex", *(f"cue {c[0]}" for c in _CUES)]


def nodes(text: str) -> list[tuple[int, int]]:
    """Spans of the nodes: tokens with a digit or @, without punctuation around them; neighbouring number tokens are one."""
    out: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _STRIP:
            a += 1
        while b > a and text[b - 1] in _STRIP:
            b -= 1
        if a == b:
            continue
        if out and a - out[-1][1] == 1 and text[a - 1] == " " and b - out[-1][0] <= 30 and _NUMBER.match(text, out[-1][0], out[-1][1]) and _NUMBER.match(text, a, b):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def features(text: str, a: int, b: int) -> list[int]:
    """Indexes in FEATURES of those that hold for a node."""
    s = text[a:b]
    d = re.sub("[^0-9]", "", s)
    n, letters = len(d), bool(re.search("[^0-9().+/ @-]", s))
    got = [0]
    if "@" in s:
        got.append(2 if re.search(r"@[^@]+\.", s) else 1)
    if letters:
        got.append(3)
    got.append(4 if n <= 4 else 5 if n <= 6 else 6 if n <= 9 else 7 if n <= 12 else 8 if n <= 15 else 9)
    dots = len(re.findall(r"[0-9]\.(?=[0-9])", s))
    if dots:
        got.append({3: 10, 1: 11, 2: 12}.get(dots, 12))
    if not letters and 16 <= n <= 19 and luhn(d):
        got.append(13)
    if "(" in s or ")" in s:
        got.append(14)
    if len(re.findall("[0-9][ -](?=[0-9])", s)) >= 2:
        got.append(15)
    if "+" in s:
        got.append(16)
    if re.fullmatch("(1[89]|20)[0-9][0-9]", s):
        got.append(17)
    if re.fullmatch("[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}", s):
        got.append(18)
    if re.fullmatch("[0-9a-fA-F]{12,}", s) and letters:
        got.append(19)
    before = re.findall("[a-z]+", text[max(0, a - 24) : a].lower())[-2:]
    got += [20 + i for i, cue in enumerate(_CUES) if any(w in cue for w in before)]
    return got


def key(text: str, a: int, b: int) -> str:
    """Nodes with the same key are mentions of the same thing: the last seven digits, or the name before @."""
    s = text[a:b]
    if "@" in s:
        return "@" + s.partition("@")[0].lower()
    d = re.sub("[^0-9]", "", s)
    return d[-7:] if len(d) >= 7 and not re.search("[A-Za-z]", s) else "=" + s.lower()


def graph(texts: list[str], bases: list[list[Span]]) -> dict:
    """The nodes of several texts as one graph: features, observed labels (-1: none), and edges of both sorts."""
    at, spans, active, observed, chain, skip = [], [], [], [], [], []
    for t, (text, base) in enumerate(zip(texts, bases, strict=True)):
        found = nodes(text)
        taken, seen, j = sorted((a, b, k) for k, a, b in base), {}, 0
        for first, (a, b) in enumerate(found):
            while j < len(taken) and taken[j][1] <= a:
                j += 1
            i = len(spans)
            at.append(t)
            spans.append((a, b))
            active.append(features(text, a, b))
            observed.append(taken[j][2] if j < len(taken) and taken[j][0] < b else -1)
            if first:
                chain.append((i - 1, i))
            k = key(text, a, b)
            if k in seen and seen[k] != i - 1:
                skip.append((seen[k], i))
            elif k in seen:
                skip.append((i - 1, i))
            seen[k] = i
    x = np.zeros((len(spans), len(FEATURES)))
    for i, f in enumerate(active):
        x[i, f] = 1
    return {"at": at, "spans": spans, "x": x, "observed": np.array(observed, int), "chain": np.array(chain, int).reshape(-1, 2), "skip": np.array(skip, int).reshape(-1, 2)}


def _norm(m: np.ndarray) -> np.ndarray:
    top = m.max(axis=1, keepdims=True)
    return m - (top + np.log(np.exp(m - top).sum(axis=1, keepdims=True)))


def marginals(g: dict, w: dict) -> np.ndarray:
    """Each node's label probabilities, by damped loopy sum-product messages over all edges at once, until they settle."""
    unary = _norm(g["x"] @ w["unary"])
    seen = g["observed"] >= 0
    unary[seen] = -30.0
    unary[seen, g["observed"][seen]] = 0.0
    edges = np.concatenate([g["chain"], g["skip"]])
    if len(edges):
        n = len(edges)
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.empty((2 * n, NONE + 1, NONE + 1))
        c = len(g["chain"])
        table[:c], table[n : n + c] = w["chain"], w["chain"].T
        table[c:n], table[n + c :] = w["skip"], w["skip"]
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        sent = np.zeros((2 * n, NONE + 1))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, sent)
            out = (belief[src] - sent[back])[:, :, None] + table
            top = out.max(axis=1, keepdims=True)
            new = DAMPING * sent + (1 - DAMPING) * _norm(np.log(np.exp(out - top).sum(axis=1)) + top[:, 0])
            change, sent = np.abs(new - sent).max(), new
            if change <= TOLERANCE:
                break
        belief = unary.copy()
        np.add.at(belief, dst, sent)
    else:
        belief = unary
    return np.exp(_norm(belief))


def made_documents(n: int = 600, seed: int = 7) -> list[tuple[str, dict[tuple[int, int], int]]]:
    """Documents made by rule, with the spans of their mentions; what isn't in the spans is ``none``."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def card() -> str:
        d = r.choice("45") + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def mention(kind: int, thing: str) -> str:
        if kind == 0:
            return r.choice([thing, thing, thing.split(".")[0] if "." in thing.split("@")[1] else thing])
        if kind == 1:
            return r.choice([thing, thing, thing.replace(".", "-"), thing + ":80"])
        if kind == 2:
            return r.choice([thing, " ".join(thing[i : i + 4] for i in range(0, 16, 4)), ".".join(thing[i : i + 4] for i in range(0, 16, 4))])
        a, b, c = thing[:3], thing[3:6], thing[6:]
        return r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", thing])

    def noise() -> str:
        return r.choice([lambda: r.choice(["19", "20"]) + num(2), lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: num(r.randint(1, 5)), lambda: num(r.randint(6, 15)), lambda: f"20{num(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: name() + num(2), lambda: f"{num(2)},{num(3)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(32)), lambda: "@" + name(), lambda: f"{num(3)}-{num(4)}", lambda: num(16)])()

    docs = []
    for _ in range(n):
        things = [(k, [f"{name()}@{name()}.com", ".".join(str(r.randint(1, 255)) for _ in range(4)), card(), r.choice("23456789") + num(9)][k]) for k in r.choices(range(4), k=r.randint(0, 3))]
        rest = [noise() for _ in range(r.randint(0, 3))]
        text, spans = "", {}
        for _ in range(r.randint(2, 12)):
            text += " ".join(name() for _ in range(r.randint(1, 6))) + " "
            p = r.random()
            if p < 0.55 and things:
                k, thing = r.choice(things)
                if r.random() < 0.5:
                    text += r.choice(_CUES[k]) + " "
                m = mention(k, thing)
                spans[len(text), len(text) + len(m)] = k
                text += m + r.choice(["", ".", ",", " and"]) + " "
            elif rest:
                if r.random() < 0.3:
                    text += r.choice(_CUES[4]) + " "
                text += (r.choice(rest) if r.random() < 0.5 else noise()) + r.choice(["", ".", ","]) + " "
        docs.append((text, spans))
    return docs


@cache
def fitted() -> dict:
    """The weights: of the features, and of the labels of neighbours on the chain and over skip edges."""
    docs = made_documents()
    g = graph([t for t, _ in docs], [[(k, *s) for s, k in spans.items()] for _, spans in docs])
    y, labels = np.where(g["observed"] >= 0, g["observed"], NONE), NONE + 1
    one = np.eye(labels)[y]
    near = np.zeros((len(y), 3, labels))  # labels before, after, and over skip edges
    for slot, (edges, a, b) in enumerate([(g["chain"], 0, 1), (g["chain"], 1, 0), (g["skip"], 0, 1), (g["skip"], 1, 0)]):
        np.add.at(near[:, min(slot, 2)], edges[:, b], one[edges[:, a]])
    unary, chain, skip = np.zeros((len(FEATURES), labels)), np.zeros((labels, labels)), np.zeros((labels, labels))
    step, n = 0.5, len(y)
    for _ in range(600):  # gradient ascent on the pseudo-likelihood
        p = np.exp(_norm(g["x"] @ unary + near[:, 0] @ chain + near[:, 1] @ chain.T + near[:, 2] @ skip))
        e = (one - p) / n
        unary += step * (g["x"].T @ e - 1e-4 * unary)
        chain += step * (near[:, 0].T @ e + e.T @ near[:, 1] - 1e-3 * chain)
        d = near[:, 2].T @ e
        skip += step * ((d + d.T) / 2 - 1e-3 * skip)
    return {"unary": unary, "chain": chain, "skip": skip}


def find(texts: list[str | None], weights: dict, threshold: float = THRESHOLD) -> list[tuple[list[Span], list[Span]]]:
    """For each text: the patterns' spans, and those that the field adds beside them."""
    texts = [t or "" for t in texts]
    bases = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    some = [i for i, t in enumerate(texts) if _ANY.search(t)]
    for i in range(0, len(some), 256):
        part = some[i : i + 256]
        g = graph([texts[j] for j in part], [bases[j] for j in part])
        if g["spans"]:
            p = marginals(g, weights)
            best = p.argmax(axis=1)
            for n in np.flatnonzero((best != NONE) & (g["observed"] < 0) & (p.max(axis=1) >= threshold)):
                added[part[g["at"][n]]].append((int(best[n]), *g["spans"][n]))
    return list(zip(bases, added, strict=True))


def private_data(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, counts and digest of the patterns' spans, and ``spans``, all spans, with their number ``n_spans``.

    A null or empty text has no spans (zero counts, the digest of "", an empty
    string). Null keys and repeated rows stay, each judged alone; texts are
    searched whole, whatever their length, in linear time.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fitted())

    def make():
        def f(ids, texts):
            found = find(texts, weights.value, threshold)
            base = [spell(b) for b, _ in found]
            counts = [[sum(s[0] == k for s in b) for b, _ in found] for k in range(len(KINDS))]
            return [ids, *counts, [hashlib.sha256(b.encode()).hexdigest() for b in base], [spell([*b, *a]) for b, a in found], [len(b) + len(a) for b, a in found]]

        return f

    kind = dict(docs.dtypes)[key].replace("bigint", "long")
    return per_row(docs, [key, text], make, f"{key} {kind},n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string,n_spans long")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch of overlapping spans replaced by its first kind in brackets."""
    out, past = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= past:
            out += [text[past:a], f"[{KINDS[k].upper()}]"]
        past = max(past, b)
    return "".join(out) + text[past:]


def mask_private(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs``, personal data in ``text`` replaced; ``length``, if there, follows. Null texts stay null."""
    ship(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(fitted())
    length = length if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            old = b.column(i).to_pylist()
            found = find(old, weights.value, threshold)
            new = [t if not (x or y) else masked(t, [*x, *y]) for t, (x, y) in zip(old, found, strict=True)]
            b = b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))
            if length:
                j = b.schema.get_field_index(length)
                was = b.column(j).to_pylist()
                b = b.set_column(j, b.schema.field(j), pa.array([n if t == u else len(u) for n, t, u in zip(was, old, new, strict=True)], b.schema.field(j).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data(table(spark, sf_dir, "documents"))
