"""Byte-level BPE encoding and decoding by prefix sharing.

Words are cut from a text as the vocabulary's pre-tokenizer does.  The distinct words not
seen before are walked in sorted order, which is a depth-first walk of their trie: every
prefix is a trie node, and a node's state is the *last token* of that prefix's encoding.

The encoding of a prefix is the encoding of a shorter prefix plus one token, and only one
token that ends the prefix fits: the one whose pair with the shorter prefix's last token
would survive the merges.  So each node costs a few lookups, shared prefixes are computed
once, and the tokens of a word are read off by following the states backwards.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandloom.llm.common import kept, map_batches, texts

# The split pattern of byte-level vocabularies.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
LOOSE = re.compile(r"(?:\A|\s) ")  # a space that may not open a word of its own
PIECES = 300_000  # remembered per Python worker, and as many older ones; up to 150 MB
WORDS = 300_000
TEXTS = 1000


@contextmanager
def uncollected():
    """No search for cycles meanwhile: the many tuples and bytes made here form none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def byte_letters() -> dict[str, int]:
    """The letter by which such vocabularies write each byte: printable Latin-1 bytes
    stand for themselves, the others get the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        letters = byte_letters()
        plain = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        self.id_of: dict[bytes, int] = {}
        for text, number in model["vocab"].items():
            self.bytes_of[number] = plain[text]
            self.id_of[plain[text]] = number
        for text, number in self.special.items():
            self.bytes_of[number] = text.encode()
        self.sizes = list(map(len, self.bytes_of))
        # A token is made by one merge; its halves and the time of that merge.
        self.made: list[tuple[int, int, int]] = [(-1, -1, -1)] * size
        self.merge: dict[tuple[int, int], int] = {}
        for time, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = model["vocab"][a], model["vocab"][b]
            whole = model["vocab"][a + b]
            if self.made[whole][0] >= 0:
                raise ValueError(f"two merges make token {whole}")
            self.merge[left, right] = time
            self.made[whole] = (time, left, right)
        self.numbers = [str(i) for i in range(size)]
        # Beginnings of tokens, by number; the walk of a word is at the longest one that ends
        # where it is.  Steps and the tokens that end there, longest first, fill with use.
        self.begun: dict[bytes, int] = {b"": 0}
        for token in self.id_of:
            for i in range(1, len(token) + 1):
                self.begun.setdefault(token[:i], len(self.begun))
        self.prefixes = list(self.begun)
        self._steps: dict[int, int] = {}
        self._ending: dict[int, tuple[tuple[int, int], ...]] = {}
        self.split = regex.compile(SPLIT)
        self.special_split = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self._fits: dict[tuple[int, int], bool] = {}
        self._words: dict[bytes, tuple[int, ...]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side as they are."""
        known = self._fits.get((left, right))
        if known is None:
            known = self._fits[left, right] = self._survives(left, right)
        return known

    def _survives(self, a: int, b: int) -> bool:
        """Go back in time, taking apart the token made last on either side of the cut.

        A merge across the cut happens if its time comes while its two tokens lie there:
        before the token that is still whole was made, and after the parts were.  Of two
        merges of the same time the left one goes first.
        """
        until = (len(self.merge), 0)  # the tokens at the cut lie there until this time
        while True:
            time = self.merge.get((a, b))
            if time is not None and (time, 0) < until:
                # A merge across the cut stands left of the right token's own merge and
                # right of the left token's own merge of the same time.
                return False
            made_a, made_b = self.made[a], self.made[b]
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            if made_a[0] > made_b[0]:
                until, a = (made_a[0], 0), made_a[2]
            else:
                until, b = (made_b[0], 1), made_b[1]

    def _step(self, step: int) -> int:
        """The longest beginning of a token that ends behind this place and byte."""
        walked = self.prefixes[step >> 8] + bytes((step & 255,))
        while walked not in self.begun:
            walked = walked[1:]
        place = self._steps[step] = self.begun[walked]
        if place not in self._ending:
            tails = [walked[i:] for i in range(len(walked))]
            self._ending[place] = tuple((len(t), self.id_of[t]) for t in tails if t in self.id_of)
        return place

    def encode_words(self, words: set[bytes]) -> None:
        """Encode words not seen before, each shared prefix once."""
        fits, sizes, known = self._fits, self.sizes, self._words
        steps, ending = self._steps, self._ending
        state: list[int] = []
        places = [0]
        before = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del state[shared:], places[shared + 1 :]
            place = places[shared]
            for end in range(shared, len(word)):
                step = place << 8 | word[end]
                place = steps.get(step)
                if place is None:
                    place = self._step(step)
                places.append(place)
                for size, token in ending[place]:
                    if size > end:
                        state.append(token)
                        break
                    pair = state[end - size], token
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = self._survives(*pair)
                    if fit:
                        state.append(token)
                        break
            tokens, end = [], len(word)
            while end:
                token = state[end - 1]
                tokens.append(token)
                end -= sizes[token]
            known[word] = tuple(tokens[::-1])
            before = word

    def trim(self) -> None:
        """Forget words and pairs when there are many."""
        if len(self._words) > WORDS:
            self._words.clear()
        if len(self._fits) > 4 * WORDS:
            self._fits.clear()

    def words_of(self, piece: str) -> list[bytes | int]:
        """Words of a piece of text; a special token stands as its id."""
        if self.special_split is None:
            return [w.encode() for w in self.split.findall(piece)]
        out: list[bytes | int] = []
        for i, part in enumerate(self.special_split.split(piece)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(w.encode() for w in self.split.findall(part))
        return out


def pieces_of(text: str) -> list[str]:
    """Cut a text before spaces that follow no white space.

    A word always starts at such a space, so pieces can be encoded one by one.
    All pieces but the first have lost that space.
    """
    pieces = text.split(" ")
    if not LOOSE.search(text):
        return pieces
    out, held = [], None
    for i, piece in enumerate(pieces):
        held = piece if held is None else f"{held} {piece}"
        # A space at the very start of the text opens the first real piece.
        if held and not held[-1].isspace():
            out.append(held)
            held = None
        elif i == 0 and not held:
            out.append(held)
            held = None
    if held is not None:
        out.append(held)
    return out


class Recent(dict):
    """A memory that forgets what has not been asked for since it was last full."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def missing(self, wanted: set) -> set:
        """What is not known; known older entries become recent."""
        # ``difference`` would walk the whole memory, as this is not quite a dict.
        new = set(filterfalse(self.__contains__, wanted))
        if self.older:
            kept = {p for p in new if p in self.older}
            self.update((p, self.older[p]) for p in kept)
            new -= kept
        return new

    def trim(self, limit: int) -> None:
        if len(self) > limit:
            self.older = dict(self)
            self.clear()


class PieceEncoder:
    """Encodes texts piece by piece, remembering the ids of pieces already met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.inner = Recent()
        self.counted = Recent()  # numbers of tokens alone, see ``token_counts``

    @uncollected()
    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        v = self.vocabulary
        cut = {p: v.words_of(p) for p in pieces}
        v.encode_words({w for ws in cut.values() for w in ws if type(w) is bytes and w not in v._words})
        out = {}
        for p, ws in cut.items():
            ids: list[int] = []
            for w in ws:
                if type(w) is bytes:
                    ids.extend(v._words[w])
                else:
                    ids.append(w)
            out[p] = array("I", ids).tobytes()
        v.trim()
        return out

    def encode(self, many: list[str]) -> list[np.ndarray]:
        if len(many) > TEXTS:  # the pieces of a few texts at a time are enough to share
            return [ids for k in range(0, len(many), TEXTS) for ids in self.encode(many[k : k + TEXTS])]
        if any(" " in s for s in self.vocabulary.special):
            learned = self._learn(set(many))
            return [np.frombuffer(learned[t], "<u4") for t in many]
        cut = [pieces_of(t) for t in many]
        first = self._learn({p[0] for p in cut})
        inner = self.inner
        inner.trim(PIECES)
        missing: set[str] = set()
        for p in cut:
            missing.update(p[1:])
        learned = self._learn({" " + p for p in inner.missing(missing)})
        inner.update((p[1:], ids) for p, ids in learned.items())
        return [
            np.frombuffer(first[p[0]] + b"".join(map(inner.__getitem__, p[1:])), "<u4") for p in cut
        ]


def encoder(content: str) -> PieceEncoder:
    """The encoder of a vocabulary, kept for the life of the Python worker."""
    return kept(("encoder", content), lambda: PieceEncoder(Vocabulary(content)))


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """Text of a list of ids; ids without a token are skipped, broken UTF-8 is replaced."""
    table, size = vocabulary.bytes_of, len(vocabulary.bytes_of)
    try:
        return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
    except IndexError:
        return b"".join(table[i] for i in ids if i < size).decode("utf-8", "replace")


@dataclass(frozen=True)
class Bpe:
    """Encoding and decoding over DataFrames with the vocabulary file ``path``.

    Null and empty texts have no ids.  Repeated rows are encoded alike, each on its own.
    The vocabulary, a file of fixed size, is sent to the tasks; rows never move.
    """

    path: str

    def content(self) -> str:
        with open(self.path, encoding="utf-8") as file:
            return file.read()

    def encode(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id_col`` and ``ids`` (array of int) of every row."""
        sent = df.sparkSession.sparkContext.broadcast(self.content())
        kind = df.schema[id_col].dataType.simpleString()

        def start():
            made = encoder(sent.value)

            def step(batch: pa.RecordBatch) -> dict:
                found = made.encode(texts(batch, "text"))
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found) if found else np.empty(0, "<u4")
                return {
                    id_col: batch.column(id_col),
                    "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype("<i4"))),
                }

            return step

        rows = df.select(df[id_col], df[text_col].alias("text"))
        return map_batches(rows, f"`{id_col}` {kind}, ids array<int>", start)

    def decode(self, df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        """``id_col`` and ``text`` of every row of ids; null ids give the empty text."""
        sent = df.sparkSession.sparkContext.broadcast(self.content())
        kind = df.schema[id_col].dataType.simpleString()

        def start():
            vocabulary = encoder(sent.value).vocabulary

            def step(batch: pa.RecordBatch) -> dict:
                lists = batch.column("ids").to_pylist()
                return {id_col: batch.column(id_col), "text": [decode(vocabulary, x or []) for x in lists]}

            return step

        rows = df.select(df[id_col], df[ids_col].alias("ids"))
        return map_batches(rows, f"`{id_col}` {kind}, text string", start)

    def round_trip(self, df: DataFrame) -> DataFrame:
        """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, decoded from the ids."""
        sent = df.sparkSession.sparkContext.broadcast(self.content())

        def start():
            made = encoder(sent.value)
            vocabulary = made.vocabulary
            numbers = vocabulary.numbers

            def step(batch: pa.RecordBatch) -> dict:
                out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                for ids in map(np.ndarray.tolist, made.encode(texts(batch))):
                    out["n_tokens"].append(len(ids))
                    joined = ",".join(map(numbers.__getitem__, ids))
                    out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    back = decode(vocabulary, ids).encode()
                    out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                return out | {"doc_id": batch.column("doc_id")}

            return step

        kind = df.schema["doc_id"].dataType.simpleString()
        return map_batches(
            df.select("doc_id", "text"),
            f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
            start,
        )
