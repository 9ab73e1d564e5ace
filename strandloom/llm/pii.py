"""Personal data: patterns, and a skip-chain conditional random field around them.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Tokens that hold a
digit or ``@`` are the nodes of the field (any other token carries the label *none* with
certainty and so separates the chain).  Neighbouring nodes share a chain potential;
occurrences of the same or a similar token anywhere in the document share a skip
potential with one of them, a pattern span where there is one, so that links grow with
the nodes and evidence is one or two links away in a text of any length.  Tokens of
pattern spans are observed; damped loopy message passing, until messages stay the same,
labels the others, which makes a number that is a phone number in one place one in all
places.

Weights are fitted by pseudo-likelihood on a bounded sample of documents, where the
patterns give the labels.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bounded, map_batches, texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive, and only from the first digit of a run: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EVIDENCE = re.compile(r"[0-9@]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NOT_WORD = re.compile(r"[^\w@]+")

Span = tuple[int, int, int]  # start, kind, end: sorts as spans are listed


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and non-overlapping per kind, in order."""
    if not _EVIDENCE.search(text):
        return []
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if local else None
        if match:
            out.append((at - local, 0, match.end()))
        last = match.end() if match else at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


NONE = len(KINDS)  # label of tokens that are nothing
LABELS = NONE + 1
SHAPES = 25


def _shape(token: str) -> list[int]:
    """Features of a token that are on."""
    digits = sum(map(token.count, "0123456789"))
    letters = sum(map(str.isalpha, token[:64]))
    on = [0, 1 + min(digits, 18) // 2, 11 + min(token.count("."), 3), 15 + min(token.count("-"), 2)]
    for i, yes in enumerate(("@" in token, token[0] == "+", token[0] == "(", not letters, not digits, len(token) > 30, letters > digits)):
        if yes:
            on.append(18 + i)
    return on


@dataclass
class Graph:
    """Nodes and links of one or more documents."""

    shapes: list[list[int]]
    observed: list[int]  # label of a pattern span, or -1
    places: list[tuple[int, int]]  # start and end of the token's core
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph_of(text: str, spans: list[Span]) -> Graph:
    graph = Graph([], [], [], [], [])
    if not _EVIDENCE.search(text):
        return graph
    by_place = sorted((s, e, k) for s, k, e in spans)
    reach, nearest, k = -1, [], 0
    last_end = -1
    groups: dict[str, list[int]] = {}
    for node, m in enumerate(_NODE.finditer(text)):
        token = m.group()
        core = token.strip(".,;:!?()[]{}\"'<>|*#&$%") or token
        begin = m.start() + token.index(core)
        end = begin + len(core)
        while k < len(by_place) and by_place[k][0] < end:
            nearest.append(by_place[k])
            k += 1
        nearest = [s for s in nearest if s[1] > begin]
        graph.shapes.append(_shape(token))
        graph.observed.append(nearest[0][2] if nearest else -1)
        graph.places.append((begin, end))
        if last_end >= 0 and text[last_end : m.start()].isspace():
            graph.chain.append((node - 1, node))
        last_end = m.end()
        digits = _NOT_DIGIT.sub("", core)
        names = ["t" + _NOT_WORD.sub("", core).casefold()]
        if len(digits) >= 4:
            names.append("d" + digits)
        if len(digits) >= 7:
            names.append("e" + digits[-7:])
        for n in names:
            groups.setdefault(n, []).append(node)
    links: set[tuple[int, int]] = set()
    for nodes in groups.values():
        hubs: dict[int, int] = {}  # first node of each observed kind
        for node in nodes:
            if graph.observed[node] >= 0:
                hubs.setdefault(graph.observed[node], node)
        for hub in hubs.values() or nodes[:1]:
            links.update((hub, node) for node in nodes if node != hub and (node, hub) not in links)
    graph.skip = sorted(links)
    return graph


@dataclass(frozen=True)
class Settings:
    """At most ``sample`` documents and ``nodes`` of their tokens are fitted; a label
    needs the belief ``sure``; messages are passed with ``damping`` until none changes by
    ``tolerance``; a warning tells if that takes more than ``rounds`` rounds.
    ``agreement`` is the prior weight of equal labels at the ends of a skip link, from
    which the fitted weights depart only as the sample demands."""

    sample: int = 20_000
    nodes: int = 200_000
    steps: int = 150
    l2: float = 1e-3
    rounds: int = 2000
    tolerance: float = 1e-8
    damping: float = 0.5
    sure: float = 0.9
    agreement: float = 3.0


@dataclass
class Weights:
    unary: np.ndarray  # shape by label
    chain: np.ndarray  # label by label
    skip: np.ndarray


def fit(shapes: np.ndarray, labels: np.ndarray, near: np.ndarray, far: np.ndarray, settings: Settings) -> Weights:
    """Pseudo-likelihood: each node given the labels of its links.

    ``near`` and ``far`` count the labels at the other ends of a node's links.
    """
    x = np.concatenate([shapes, near, far], 1)
    prior = np.zeros((x.shape[1], LABELS))
    prior[0, NONE] = 1.0  # without evidence a token is nothing
    prior[-LABELS:] = settings.agreement * np.eye(LABELS)
    w = prior.copy()
    target = np.eye(LABELS)[labels]
    # Full-batch gradient steps with momentum; the loss is convex.
    speed = np.zeros_like(w)
    scale = 1 / (0.5 * np.mean((x * x).sum(1)) + settings.l2)
    for _ in range(settings.steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - scale * (x.T @ (p - target) / len(x) + settings.l2 * (w - prior))
        w += speed
    a, b = shapes.shape[1], shapes.shape[1] + LABELS
    chain, skip = w[a:b], w[b:]
    return Weights(w[:a], (chain + chain.T) / 2, (skip + skip.T) / 2)


def beliefs(graphs: list[Graph], weights: Weights, settings: Settings) -> np.ndarray:
    """Label probabilities of the nodes of all graphs, one after the other."""
    n = sum(len(g.shapes) for g in graphs)
    local = np.zeros((n, LABELS))
    ends: list[tuple[int, int]] = []
    kinds: list[int] = []
    at = 0
    for g in graphs:
        for i, (on, seen) in enumerate(zip(g.shapes, g.observed)):
            if seen >= 0:
                local[at + i] = -1e9  # no number of messages outweighs a pattern span
                local[at + i, seen] = 0.0
            else:
                local[at + i] = weights.unary[on].sum(0)
        for kind, links in enumerate((g.chain, g.skip)):
            for a, b in links:
                ends.append((at + a, at + b))
                kinds.append(kind)
        at += len(g.shapes)
    if ends:
        pair = np.array(ends)
        source = np.concatenate([pair[:, 0], pair[:, 1]])
        target = np.concatenate([pair[:, 1], pair[:, 0]])
        back = np.concatenate([np.arange(len(pair)) + len(pair), np.arange(len(pair))])
        potential = np.stack([weights.chain, weights.skip])[np.array(kinds * 2)]
        message = np.zeros((len(source), LABELS))
        for _ in range(settings.rounds):
            total = local.copy()
            np.add.at(total, target, message)
            inside = total[source] - message[back]
            joint = inside[:, :, None] + potential
            top = joint.max(1, keepdims=True)
            new = np.log(np.exp(joint - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = (1 - settings.damping) * (new - message)
            message += change
            if np.abs(change).max() < settings.tolerance:
                break
        else:
            warnings.warn(f"messages still change after {settings.rounds} rounds")
        np.add.at(local, target, message)
    p = np.exp(local - local.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(graph: Graph, belief: np.ndarray, text: str, settings: Settings) -> list[Span]:
    """Spans of tokens outside the patterns that the field labels; neighbours join."""
    out: list[Span] = []
    for (begin, end), seen, p in zip(graph.places, graph.observed, belief):
        kind = int(np.argmax(p))
        if seen >= 0 or kind == NONE or p[kind] < settings.sure:
            continue
        if out and out[-1][1] == kind and text[out[-1][2] : begin].isspace():
            out[-1] = (out[-1][0], kind, end)
        else:
            out.append((begin, kind, end))
    return out


def _training_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    ids = bounded(docs.select("doc_id").where("doc_id is not null").distinct(), settings.sample, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")

    def start():
        def step(batch: pa.RecordBatch) -> dict | None:
            shapes, labels, near, far = [], [], [], []
            for text in texts(batch):
                g = graph_of(text, pattern_spans(text))
                own = [s if s >= 0 else NONE for s in g.observed]
                counts = [np.zeros((len(own), LABELS), int), np.zeros((len(own), LABELS), int)]
                for table, links in zip(counts, (g.chain, g.skip)):
                    for a, b in links:
                        # A hub has no bounded number of members, a member few hubs.
                        if table is counts[0] or own[b] != NONE:
                            table[a, own[b]] += table is counts[0] or not table[a, own[b]]
                        table[b, own[a]] += 1
                for i, label in enumerate(own):
                    # What a pattern span is linked to has no known label without a pattern.
                    if label == NONE and counts[1][i, :NONE].any():
                        continue
                    shapes.append(g.shapes[i])
                    labels.append(label)
                    near.append(counts[0][i].tolist())
                    far.append(counts[1][i].tolist())
            return {"shapes": shapes, "label": labels, "near": near, "far": far} if labels else None

        return step

    return map_batches(rows, "shapes array<int>, label int, near array<int>, far array<int>", start)


def train(docs: DataFrame, settings: Settings = Settings()) -> Weights | None:
    """Weights from a bounded sample, or None where the patterns find nothing in it."""
    held = _training_rows(docs, settings).limit(settings.nodes).toArrow()
    labels = held.column("label").to_numpy()
    if not len(labels) or (labels == NONE).all():
        return None
    shapes = np.zeros((len(labels), SHAPES))
    for i, on in enumerate(held.column("shapes").to_pylist()):
        shapes[i, on] = 1
    near, far = (np.array(held.column(c).to_pylist(), float).reshape(-1, LABELS) for c in ("near", "far"))
    return fit(shapes, labels, near, far, settings)


def all_spans(many: list[str], weights: Weights | None, settings: Settings) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and all spans of each text."""
    base = [pattern_spans(t) for t in many]
    if weights is None:
        return [(b, b) for b in base]
    graphs = [graph_of(t, b) for t, b in zip(many, base)]
    belief, at, out = beliefs(graphs, weights, settings), 0, []
    for text, own, g in zip(many, base, graphs):
        more = added_spans(g, belief[at : at + len(g.shapes)], text, settings)
        at += len(g.shapes)
        out.append((own, sorted(own + more)))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out.append(text[at:s] + f"<{KINDS[k]}>")
        at = max(at, e)
    return "".join(out) + text[at:]


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and hash are of the pattern spans; ``spans`` lists all.  Null texts are empty
    and have no spans; in a document without pattern spans shapes and links alone decide;
    repeated rows are labelled alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, settings))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            found = all_spans(texts(batch), sent.value, settings)
            out = {f"n_{name}": [sum(s[1] == k for s in base) for base, _ in found] for k, name in enumerate(KINDS)}
            return out | {
                "doc_id": batch.column("doc_id"),
                "base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found],
                "spans": [listed(spans) for _, spans in found],
                "n_added": [len(spans) - len(base) for base, spans in found],
            }

        return step

    counts = ", ".join(f"n_{name} long" for name in KINDS)
    return map_batches(
        docs.select("doc_id", "text"),
        f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long",
        start,
    )
