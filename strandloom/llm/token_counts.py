"""Token counts that follow edits.

A document is cut into leaves, runs of whole pre-tokens, below a tree that sums characters
and tokens.  An edit finds its leaves by descending the tree, cuts only their text into
pre-tokens, and goes back to a pre-token start that the edit cannot move.  From there new
pre-tokens are made until one starts where an old one did; from that place on both cuts
agree.  Only the new pre-tokens in between are encoded, and the sums above the touched
leaves are updated.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm.bpe import PieceEncoder, encoder, pieces_of, uncollected
from strandloom.llm.common import map_batches, texts

LEAF = 32  # pieces of a leaf
REMEMBERED = 500_000  # pieces per Python worker, and as many older ones
CONTEXT = 4  # characters before an edit that fix the pre-token start ahead of them


class PieceCounts:
    """Token counts of pieces and pre-tokens, remembered while the worker lives."""

    def __init__(self, pieces: PieceEncoder):
        self.pieces = pieces

    def learn(self, found: set[str]) -> None:
        """Count the tokens of what is not known yet, all at once.

        Pieces without white space are cut into words as one text: the space ahead of each
        opens a word, so it tells where the next piece begins.
        """
        v, counted = self.pieces.vocabulary, self.pieces.counted
        new = counted.missing(found)
        plain = [p for p in new if p.split() == [p]] if v.special_split is None else []
        odd = list(new.difference(plain))
        joined = v.split.findall(" " + " ".join(plain)) if plain else []
        cut = [v.words_of(" " + p) for p in odd]
        raw = {w: w.encode() for w in set(joined)}
        every = {w for ws in cut for w in ws if type(w) is bytes}.union(raw.values())
        v.encode_words({w for w in every if w not in v._words})
        sizes = {w: len(v._words[b]) for w, b in raw.items()}
        totals: list[int] = []
        for w in joined:
            if w[0] == " ":
                totals.append(sizes[w])
            else:
                totals[-1] += sizes[w]
        counted.update(zip(plain, totals, strict=True))
        counted.update(
            (p, sum(len(v._words[w]) if type(w) is bytes else 1 for w in ws)) for p, ws in zip(odd, cut)
        )
        v.trim()

    def words(self, found: list[str]) -> int:
        """Tokens of whole words."""
        v = self.pieces.vocabulary
        raw = [x.encode() for x in found]
        if missing := set(raw).difference(v._words):
            v.encode_words(missing)
        return sum(map(len, map(v._words.__getitem__, raw)))


def leaf_words(words: list[str], share: int) -> list[list[str]]:
    """Words in runs of at least ``share``, so in no more runs than that asks for.

    A run ends behind white space only at the end of the text: how white space is cut
    depends on what follows it.
    """
    out, begin = [], 0
    for i, word in enumerate(words, 1):
        if i - begin >= share and not word[-1].isspace():
            out.append(words[begin:i])
            begin = i
    if begin < len(words):
        out.append(words[begin:])
    return out


class EditedText:
    """A text under edits, with the number of its tokens at hand."""

    def __init__(self, text: str, counts: PieceCounts, leaf: int = LEAF):
        self.counts, self.leaf = counts, leaf
        self.split = counts.pieces.vocabulary.split
        self.encoded = 0  # pre-tokens encoded because of edits
        self._build(text)

    def _build(self, text: str) -> None:
        pieces = pieces_of(text)
        counted = self.counts.pieces.counted
        head = self.counts.words(self.split.findall(pieces[0]))
        self.texts, tokens = [], []
        for i in range(0, len(pieces), self.leaf):
            run = pieces[i : i + self.leaf]
            joined = " ".join(run)
            self.texts.append(" " + joined if i else joined)
            inside = run if i else run[1:]
            tokens.append(sum(map(counted.__getitem__, inside)) + (0 if i else head))
        self._sum(tokens)

    def _sum(self, tokens: list[int]) -> None:
        size = 1
        while size < len(self.texts):
            size *= 2
        self.size = size
        self.tokens = [0] * size + tokens + [0] * (size - len(tokens))
        self.chars = [0] * size + [len(t) for t in self.texts] + [0] * (size - len(self.texts))
        for i in range(size - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the leaf's first character."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = leaf + self.size
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` of the current text."""
        self.edit_many([(start, end, new)])

    def edit_many(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits in order, apart from each other, in places of the text as it is now.

        Edits that lie in the same leaves are made together.
        """
        moved, k, at = 0, 0, 0
        for start, end, _ in edits:
            if not at <= start <= end <= self.chars[1]:
                raise IndexError(f"edit {start}:{end} outside {self.chars[1]} characters or out of order")
            at = end
        while k < len(edits):
            group: list[tuple[int, int, str]] = []
            start = edits[k][0] + moved
            first, begin = self._find(start)
            last, stop = first, begin + len(self.texts[first])
            while k < len(edits) and (not group or edits[k][0] + moved < stop):
                a, b, new = edits[k]
                group.append((a + moved, b + moved, new))
                if b + moved > stop:
                    last, low = self._find(b + moved - 1)
                    stop = low + len(self.texts[last])
                k += 1
            self._apply(first, begin, last, group)
            moved += sum(len(new) - (b - a) for a, b, new in group)

    def _apply(self, first: int, begin: int, last: int, edits: list[tuple[int, int, str]]) -> None:
        """Make edits inside the leaves from ``first``, which begins at ``begin``, to ``last``."""
        start, end = edits[0][0], edits[-1][1]
        stop = begin + sum(map(len, self.texts[first : last + 1]))
        while first and start - begin < 4 * CONTEXT:
            first -= 1
            begin -= len(self.texts[first])
        while last + 1 < len(self.texts) and stop - end < 4 * CONTEXT:
            last += 1
            stop += len(self.texts[last])
        while True:
            old = "".join(self.texts[first : last + 1])
            words = self.split.findall(old)
            places = list(accumulate(map(len, words), initial=0))
            near = min(bisect_right(places, start - begin - CONTEXT), len(words)) - 1
            while near >= 0 and old[places[near] : min(start - begin, places[near] + 64)].isspace():
                near -= 1
            safe = (near, places[near])
            if near < 0:
                if first:
                    first -= 1
                    begin -= len(self.texts[first])
                    continue
                safe = (0, 0)
            parts, at = [], 0
            for a, b, new in edits:
                parts += (old[at : a - begin], new)
                at = b - begin
            made = "".join(parts) + old[at:]
            shift = len(made) - len(old)
            # Where old pre-tokens start at or after the edits, in places of the new text.
            starts = {places[i] + shift: i for i in range(bisect_left(places, end - begin), len(words))}
            fresh, stop = [], len(words)
            synced = last + 1 >= len(self.texts)
            for match in self.split.finditer(made, safe[1]):
                if match.start() in starts:
                    stop, synced = starts[match.start()], True
                    break
                fresh.append(match.group())
            if synced:
                break
            last += 1  # no common start inside these leaves
        self.encoded += len(fresh)
        # The leaves share the new words evenly; words that were there have known counts.
        words = [*words[: safe[0]], *fresh, *words[stop:]]
        share = max(1, -(-len(words) // (last - first + 1)))
        parts = leaf_words(words, share)
        for i in range(first, last + 1):
            part = parts[i - first] if i - first < len(parts) else []
            self._set(i, "".join(part), self.counts.words(part))
        if share > 16 * self.leaf:
            self._rebuild()

    def _rebuild(self) -> None:
        """Cut leaves that edits have filled, and build the tree over the leaves anew."""
        texts, tokens = [], []
        for i, text in enumerate(self.texts):
            words = self.split.findall(text)
            if len(words) <= 4 * self.leaf:
                texts.append(text)
                tokens.append(self.tokens[self.size + i])
                continue
            for part in leaf_words(words, self.leaf):
                texts.append("".join(part))
                tokens.append(self.counts.words(part))
        self.texts = texts
        self._sum(tokens)


@dataclass(frozen=True)
class Rule:
    """Every match of ``pattern``, as ``re`` reads it, becomes ``new``; rules follow each other.

    A text without any of ``needs`` has no match; none given: every text is searched.
    """

    pattern: str
    new: str
    needs: tuple[str, ...] = ("",)


# Masked addresses and long numbers, emptied shouting, and lines without end spaces.
RULES = (
    Rule(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+", "<email>", ("@",)),
    Rule(r"[0-9]{5,}+", "<number>"),
    Rule(r"[!?*#&$%|]{2,}+", ""),
    Rule(r"[ \t]+(?=\n)", "", (" \n", "\t\n")),
)


def count_after_edits(docs: DataFrame, content: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, n_tokens, n_edits, n_reencoded (pre-tokens), n_tokens_edited.

    ``content`` is a vocabulary in the JSON form of the tokenizers library.  Null and
    empty texts have no tokens and no edits; texts with special tokens are counted as
    ordinary text; repeated rows count alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(content)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start() -> Callable[[pa.RecordBatch], dict]:
        counts = PieceCounts(plain_encoder(sent.value))
        compiled = [(re.compile(r.pattern), r.new, r.needs) for r in rules]

        @uncollected()
        def step(batch: pa.RecordBatch) -> dict:
            many = texts(batch)
            limit_memory(counts)
            for k in range(0, len(many), 500):
                counts.learn({p for t in many[k : k + 500] for p in pieces_of(t)[1:]})
            out: dict[str, list] = {n: [] for n in ("n_tokens", "n_edits", "n_reencoded", "n_tokens_edited")}
            for text in many:
                edited = EditedText(text, counts)
                out["n_tokens"].append(edited.n_tokens)
                edits = 0
                for pattern, new, needs in compiled:
                    if not any(x in text for x in needs):
                        continue
                    found = [(*m.span(), new) for m in pattern.finditer(text)]
                    if found:
                        edited.edit_many(found)
                        edits += len(found)
                        text = edited.text
                out["n_edits"].append(edits)
                out["n_reencoded"].append(edited.encoded)
                out["n_tokens_edited"].append(edited.n_tokens)
            return out | {"doc_id": batch.column("doc_id")}

        return step

    return map_batches(
        docs.select("doc_id", "text"),
        f"doc_id {kind}, n_tokens long, n_edits long, n_reencoded long, n_tokens_edited long",
        start,
    )


def plain_encoder(content: str) -> PieceEncoder:
    """An encoder that takes special tokens in a text for ordinary text."""
    import json

    data = json.loads(content)
    data["added_tokens"] = []
    return encoder(json.dumps(data))


def limit_memory(counts: PieceCounts) -> None:
    counts.pieces.counted.trim(REMEMBERED)
