"""Text operators against plain versions on small tables."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandloom.llm import (
    bloom,
    bpe,
    common,
    decontaminate,
    line_dedup,
    perplexity,
    pii,
    quality_rules,
    simhash,
    token_counts,
    token_output,
    url_filter,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Names that operators use inside or return.
CLASHES = ("key", "fp", "ranges", "row", "ids", "n_words", "spans", "component_id", "h1", "limit", "middle", "n", "hash",
           "_key", "_maybe", "_share", "_ranges", "_id", "_k", "_lines", "_removed", "_row", "_spans", "_first")


def docs_of(spark, texts, clash=False, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def table(df):
    return {r["doc_id"]: r for r in df.collect()}


def prose(seed, words, sentence=8):
    rng = random.Random(seed)
    stems = ["lo", "mi", "ra", "ten", "so", "quil", "ba", "ner", "du", "pel"]
    made = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("." if i % sentence == sentence - 1 else "") for i, w in enumerate(made))


ODD = [None, "", " ", "\n\n", "word", "a" * 30_000, "tie tie", "tie tie", "né\u2003à  la\tfin \x1e x", "<|endoftext|> y"]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.Bpe(PATH).content())


# --- encoding -----------------------------------------------------------------


def test_encoder_equals_the_library_on_random_text(library, vocabulary):
    rng = random.Random(3)
    letters = [*"ab  \n\t 　'streé1٣中😀.!\x1c\x85"] + ["<|endoftext|>", " the", "'re", "   "]
    many = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["ab" * 500, " " * 99]
    for text, ids in zip(many, bpe.PieceEncoder(vocabulary).encode(many)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert bpe.decode(vocabulary, ids.tolist()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_no_neighbours_that_the_merges_would_change(library, vocabulary):
    rng = random.Random(5)
    for _ in range(2000):
        a, b = (rng.randrange(50_000) for _ in range(2))
        raw = vocabulary.bytes_of[a] + vocabulary.bytes_of[b]
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if len(vocabulary.split.findall(text)) == 1 and text.isalpha():
            assert vocabulary.fits(a, b) == (library.encode(text).ids == [a, b])


def test_round_trip_over_rows(spark, library):
    got = table(bpe.Bpe(PATH).round_trip(docs_of(spark, ODD, clash=True)))
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    made = bpe.Bpe(PATH)
    kept = table(made.decode(made.encode(docs_of(spark, ODD))))
    assert [kept[i].text for i in range(len(ODD))] == [t or "" for t in ODD]


# --- binary output ------------------------------------------------------------


def test_packed_ranks_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (2, 256, 257, 65_536, 1 << 24, 1 << 32):
            ranks = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            control, data = token_output.pack(ranks)
            assert len(control) == -(-n // 4)
            assert (token_output.unpack(control, data, n) == ranks).all()
    control, data = token_output.pack(np.array([1, 256, 65_536, 1 << 24, 255], np.uint32))
    assert control == bytes([0b11100100, 0]) and len(data) == 11


def test_token_files(spark, library, tmp_path):
    texts = ODD + [prose(i, 50) for i in range(40)]
    ids = [(7 * i) % len(texts) for i in range(len(texts))]
    path = str(tmp_path / "tokens")
    token_output.write(docs_of(spark, texts, clash=True, ids=ids), path, bpe.Bpe(PATH).content(), block_ids=100)
    got = table(token_output.read(spark, path))
    start = 0
    for doc_id, text in sorted(zip(ids, texts)):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        row = got[doc_id]
        assert (row.start, row.n_tokens) == (start, len(want))
        assert row.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    counts = [r.n for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()]
    assert counts == sorted(counts, reverse=True) and sum(counts) == start


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    token_output.write(docs_of(spark, []), path, bpe.Bpe(PATH).content())
    assert token_output.read(spark, path).count() == 0


def test_pieces_at_line_beginnings_are_encoded_once(library, monkeypatch):
    given = []
    encode = token_output.LibraryEncoder._encode
    monkeypatch.setattr(token_output.LibraryEncoder, "_encode", lambda self, many: given.extend(many) or encode(self, many))
    words = [prose(i, 1).strip(".") + chr(97 + i) for i in range(26)]
    texts = [" ".join(f"{a}.\n{b}" for b in words) for a in words]
    got = token_output.LibraryEncoder(bpe.Bpe(PATH).content()).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(given) < 100  # 676 pairs of words meet at a line feed


def test_ids_of_cut_texts(library, monkeypatch):
    rng = random.Random(9)
    gaps = [" "] * 12 + ["\n"] * 4 + ["\n\n", "\n\n\n", "  ", " \n", "\n ", "\t", "\r\n", "\u00a0", "\x1c", ""]
    words = [
        "the", "Then", "word.", "it's", "'s", "a,", "b!?", "caf\u00e9", "\u00e9t\u00e9,", "\u043c\u0438\u0440.", "\u4e16\u754c", "12", "3.5",
        "x\u00b2.", "<|endoftext|>", "a<|endoftext|>.", "\U0001f600", "\u0120", "\u010a", "A|", "|", "_a", "e\u0301",
    ]
    texts = ["", " ", "\n", "\n\n", "a", "a\n", "\na", " a", "a ", *(
        "".join(rng.choice(words) + rng.choice(gaps[: rng.choice([12, 16, 17, 26])]) for _ in range(rng.randrange(1, 30)))
        for _ in range(1500)
    )]
    monkeypatch.setattr(token_output, "HELD", 40)
    monkeypatch.setattr(token_output, "TEXTS", 50)
    got = token_output.LibraryEncoder(bpe.Bpe(PATH).content()).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_a_memory_is_not_walked_to_look_pieces_up():
    class Walked(bpe.Recent):
        def __iter__(self):
            raise AssertionError("walked")

    held = Walked()
    held["a"] = b""
    assert held.missing({"a", "b"}) == {"b"}


# --- near duplicates ----------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    texts = list(ODD)
    for i in range(25):
        words = prose(i, 200).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    got = table(simhash.near_duplicates(docs_of(spark, texts, clash=True)))
    prints = [plain_fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == plain_components(prints)
    kept = simhash.drop_near_duplicates(docs_of(spark, texts, clash=True))
    assert {r.doc_id for r in kept.collect()} == set(plain_components(prints))
    assert kept.columns == docs_of(spark, [], clash=True).columns


@pytest.mark.parametrize("bucket, levels", [(2048, 3), (3, 3), (3, 1)])
def test_links_lose_nothing_in_crowded_buckets(spark, bucket, levels):
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df, bucket=bucket, levels=levels).collect()]
    place = {v: i for i, v in enumerate(signed)}
    root = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups, want = {}, {}
    for v, c in zip(signed, plain_components(values)):
        want.setdefault(c, set()).add(v)
        groups.setdefault(root.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert len(edges) < 31 * 3 * len(place)  # stars, not pairs


def test_masks_cover_every_small_difference():
    rng = random.Random(1)
    masks = [m % (1 << 64) for m in simhash.masks(4, 0)]
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & x == 0 for m in masks)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (5, 5)]
    rng = random.Random(4)
    rng.shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == got[1002] == 1000


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


# --- decontamination ----------------------------------------------------------


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_hits(text, items):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        k = min(10, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit.update(range(j, j + k))
                    if name is not None:
                        names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 200])
def test_decontamination_against_plain_search(spark, block_chars):
    items = [(i, prose(100 + i, 14)) for i in range(6)] + [(6, "Short one, here"), (7, None), (8, "..."), (None, prose(3, 12)), (0, prose(100, 14))]
    texts = ODD + [prose(i, 30) for i in range(6)]
    texts += [f"{prose(50, 9)} {items[0][1].upper()} {prose(51, 9)}", "a short--ONE here b short one here", prose(102, 14) + " " + prose(103, 14)]
    texts += [prose(3, 12), " ".join(prose(104, 14).split()[2:13])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(0))
    found = table(decontaminate.scan(docs_of(spark, texts, clash=True), bench, block_chars=block_chars))
    for i, text in enumerate(texts):
        n, hit, names = plain_hits(text, items)
        spans = [(s["start"], s["end"]) for s in found[i]["spans"]]
        assert (found[i].n_words, sum(b - a for a, b in spans), found[i]["items"]) == (n, hit, names)
    clean = decontaminate.decontaminate(docs_of(spark, texts, clash=True), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if not plain_hits(t, items)[1]}
    cut = table(decontaminate.decontaminate(docs_of(spark, texts), bench, mode="spans"))
    assert plain_hits(cut[len(ODD) + 6].text, items)[1] == 0 and prose(50, 9)[:-1] in cut[len(ODD) + 6].text


# --- line dedup ---------------------------------------------------------------


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_decontamination_is_the_same_in_blocks(spark, mode):
    items = [prose(800 + i, 14) for i in range(6)]
    texts = [f"{prose(i, 20)} {items[i % 6]} {prose(50 + i, 20)}" if i % 2 else prose(i, 40) for i in range(12)] + [None, ""]
    docs = docs_of(spark, texts, clash=True, ids=[None, None, 7, 7, *range(20, 30)])
    table_of = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = decontaminate.decontaminate(docs, table_of, mode=mode)
    parts = decontaminate.decontaminate(docs, table_of, mode=mode, block_chars=200)
    assert parts.columns == docs.columns
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))


def test_lines_together_are_the_text():
    for text in [t or "" for t in ODD] + ["\na. b\n\n c! d? e", prose(1, 90) + "\n" + prose(2, 40)]:
        assert "".join(line_dedup.lines_of(text)) == text


def test_repeated_passages_go_once(spark):
    passage = prose(9, 80)
    texts = ODD + [f"{prose(20 + i, 60)} {passage} {prose(40 + i, 60)}" for i in range(12)] + [prose(70 + i, 90) for i in range(6)]
    texts.append(texts[len(ODD)])  # a whole copy
    docs = docs_of(spark, texts, clash=True)
    got = table(line_dedup.clean(docs))
    first = len(ODD)
    for i in range(first):
        assert got[i].text == texts[i]
    assert got[first].text == texts[first]
    for i in range(first + 1, first + 12):
        assert passage not in got[i].text and got[i]["_removed_"] >= 7
        assert prose(20 + i - first, 60)[:100] in got[i].text and prose(40 + i - first, 60)[-100:] in got[i].text
    for i in range(first + 12, first + 18):
        assert got[i].text == texts[i]
    assert got[len(texts) - 1].text == ""
    kept = line_dedup.drop_repeated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts) - 1))


def sentences(seed, words, lines):
    made = prose(seed, words, 10**9).split()
    cuts = [words * k // lines for k in range(lines + 1)]
    return " ".join(" ".join(made[a:b]) + "." for a, b in zip(cuts, cuts[1:]))


def test_passages_of_few_lines_are_found_between_other_text(spark):
    passages = [sentences(9000 + i, 52 + i % 9, 1 + i % 8) for i in range(64)]
    texts = [f"{prose(100 * i + k, 64)} {p} {prose(100 * i + k + 10, 64)}" for i, p in enumerate(passages) for k in range(2)]
    got = table(line_dedup.clean(docs_of(spark, texts)))
    for i, p in enumerate(passages):
        assert got[2 * i].text == texts[2 * i]
        assert got[2 * i + 1]["_removed"] == 1 + i % 8
        assert got[2 * i + 1].text == texts[2 * i + 1].replace(f" {p} ", " ")


def test_nothing_of_a_long_passage_remains(spark, monkeypatch):
    # The first of its group holds a part of an earlier passage, and the filter lets all through.
    full = bloom.Bloom(np.full((1, 8), 2**32 - 1, np.uint32))
    monkeypatch.setattr(bloom, "build", lambda *args, **more: full)
    passage = sentences(77, 300, 30)
    inner = " ".join(f"{x}." for x in passage.split(". ")[10:18])
    texts = [f"{prose(1, 64)} {inner} {prose(2, 64)}"]
    texts += [f"{prose(10 + i, 64)} {passage} {prose(30 + i, 64)}" for i in range(4)]
    got = table(line_dedup.clean(docs_of(spark, texts)))
    assert [got[i]["_removed"] for i in range(5)] == [0, 8, 30, 30, 30]


def test_what_no_other_document_has_stays(spark):
    license, own = prose(3, 800), prose(4, 40)
    kept = table(line_dedup.drop_repeated(docs_of(spark, [license, f"{license} {own}", license, "", None])))
    assert {i: r.text for i, r in kept.items()} == {0: license, 1: own, 3: "", 4: None}


def test_every_removed_line_stays_somewhere(spark):
    rng = random.Random(6)
    parts = [prose(i, 24) for i in range(12)]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for bits in (128, 6):  # with six bits most chunks collide
        got = table(line_dedup.clean(docs_of(spark, texts), line_dedup.Settings(hash_bits=bits)))
        left = {x.strip() for r in got.values() for x in line_dedup.lines_of(r.text)}
        assert {x.strip() for t in texts for x in line_dedup.lines_of(t)} == left
        assert sum(len(r.text) for r in got.values()) < 0.6 * sum(map(len, texts))


def test_windows_are_compared_where_they_meet(spark, monkeypatch):
    """Python runs to cut texts into windows, and not again over each of the repeated ones."""
    passes, plain = [], line_dedup.map_batches
    monkeypatch.setattr(line_dedup, "map_batches", lambda df, schema, *rest: passes.append(schema) or plain(df, schema, *rest))
    mark = line_dedup.MARK
    shared = f"{prose(1, 12, 99)} \x1c\n\n\u2003{prose(2, 12, 99)}{mark}end\n{prose(3, 12, 99)}"
    texts = [f"{prose(10 + i, 12, 99)}\n{shared}\n{prose(20 + i, 12, 99)}" for i in range(3)]
    ranges = {r.doc_id: r.ranges for r in line_dedup.removals(docs_of(spark, texts)).collect()}
    assert len(passes) == 2 and passes[0] == "h1 long, h2 long"
    assert sorted(ranges) == [1, 2]
    gone = {line for place in ranges[1] for line in range(place & 0xFFFF, (place & 0xFFFF) + (place >> 40))}
    assert gone == {1, 2, 3}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.report(docs_of(spark, [])).count() == 0


# --- quality classifier -------------------------------------------------------


def plain_kneser_ney(train, order, discounts):
    """Probability of a byte after a context, by the definition."""
    counts = {n: {} for n in range(1, order + 1)}
    for text in train:
        s = bytes([2]) * (order - 1) + text
        for i in range(order, len(s) + 1):
            counts[order][s[i - order : i]] = counts[order].get(s[i - order : i], 0) + 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 256
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        d = [0, *discounts[n]]
        total = sum(same.values())
        weight = sum(d[min(c, 3)] for c in same.values()) / total
        own = same.get(gram, 0)
        return max(own - d[min(own, 3)], 0) / total + weight * p(gram[1:])

    return p


@pytest.mark.parametrize("shard_rows", [4_000_000, 60])
def test_perplexity_against_the_definition(spark, shard_rows):
    train = [b"abracadabra ab cab", b"banana band", "né cab\u00e9 nada".encode()] * 2 + [b"x"]
    df = spark.createDataFrame([(t.decode(),) for t in train], "text string")
    tables = perplexity.model(df, 3)
    plain = [b" ".join(t.split()) for t in train]
    counts = perplexity.count_ngrams(df, 3)
    discounts = {}
    for n in (3, 2, 1):
        discounts[n] = perplexity._discounts(counts)
        counts = counts.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)).alias("key")).agg(F.count("*").alias("n"))
    p = plain_kneser_ney(plain, 3, discounts)
    texts = ["abra", "zzz né", None, "", "cab banana 12"]
    settings = perplexity.Settings(order=3, shard_rows=shard_rows)
    got = table(perplexity.score(docs_of(spark, texts), tables, settings))
    for i, text in enumerate(texts):
        s = bytes([2, 2]) + b" ".join((text or "").encode().translate(perplexity.DIGITS).split())
        want = sum(np.log(p(s[k - 3 : k])) for k in range(3, len(s) + 1))
        assert got[i].n_bytes == len(s) - 2
        assert got[i].log_p == pytest.approx(want, rel=1e-4)
    total = sum(p(b"ab" + bytes([c])) for c in range(256))
    assert total == pytest.approx(1)


def test_classifier_rejects_held_out_junk(spark):
    good = [prose(i, 120) for i in range(400)]
    junk = [" ".join(f"{w.upper()}!!%%" for w in prose(1000 + i, 120).split()) for i in range(20)]
    texts = good + junk + [None, "", "lo mi ra."]
    docs = docs_of(spark, texts, clash=True)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(410, 0, 0), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = table(perplexity.classify(docs, labels))
    assert sum(not got[i].kept for i in range(400)) <= 2
    assert not any(got[i].kept for i in range(400, 420))
    assert all(got[i].kept for i in range(420, 423))
    kept = perplexity.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())


def test_few_odd_words_are_found_in_long_texts(spark):
    good = [prose(i, 200 + 5 * (i % 40)) for i in range(440)]
    foul = []
    for i in range(20):
        words = prose(2000 + i, 600).split()
        words[50 * (i % 10) + 7] = "xyzzyx"
        words[500] = "kwjgvk"
        foul.append(" ".join(words))
    docs = docs_of(spark, good + foul)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = table(perplexity.classify(docs, labels))
    assert sum(got[i].kept for i in range(440, 460)) == 0
    assert sum(not got[i].kept for i in range(440)) <= 18
    again = table(perplexity.classify(docs, labels, perplexity.Settings(shard_rows=3000)))
    assert [got[i].kept for i in range(460)] == [again[i].kept for i in range(460)]


def test_worst_windows_stay_inside_documents():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, 200)
    blocks = rng.random(int(counts.sum()))
    want = []
    for part in np.split(blocks, np.cumsum(counts)[:-1]):
        w = perplexity.WIDTH
        want.append(max((part[i : i + w].sum() for i in range(len(part) - w + 1)), default=part.sum()))
    assert np.allclose(perplexity.worst_windows(blocks, counts), want)


def test_classifier_without_trusted_text_keeps_all(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = perplexity.classify(docs_of(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(r.kept and r.limit is None for r in got)
    assert perplexity.classify(docs_of(spark, []), labels).count() == 0


# --- quality rules ------------------------------------------------------------


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_statistics_against_plain_counts(spark):
    texts = ODD + [prose(i, 60) for i in range(5)]
    texts += [prose(1, 20) + "\n" + prose(1, 20) + "\nx\n \nx\n#*$ %&|<>", " ".join(["a b c d e f g h i"] * 4), "z " * 200]
    got = table(quality_rules.document_statistics(docs_of(spark, texts, clash=True)))
    for i, text in enumerate(texts):
        if len(text or "") < 20_000:
            assert [got[i][n] for n in quality_rules.BASE] == plain_statistics(text), text


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.normal(size=3000) < 0.6).astype(float)
    trees = quality_rules.fit(x, y, [-1, 0, 0], quality_rules.Settings())
    fresh = rng.random((3000, 3))
    truth = fresh[:, 0] + 0.3 * np.sin(9 * fresh[:, 1]) < 0.6
    assert ((trees.score(fresh) > 0.5) == truth).mean() > 0.9
    steps = np.linspace(0, 1, 50)
    for row in fresh[:200]:
        grid = np.repeat(row[None], 50, 0)
        grid[:, 0] = steps
        assert (np.diff(trees.score(grid)) <= 1e-12).all()
    assert quality_rules.fit(x, np.ones(3000), [0, 0, 0]) is None


def test_rules_keep_clean_text(spark):
    good = [prose(i, 100) for i in range(150)]
    bad = [" ".join(w.upper() + "!!" if i % 2 else w + "%%%" for w in prose(500 + i, 100).split()) for i in range(60)]
    docs = docs_of(spark, good + bad + ODD, clash=True)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210, 3)] + [(0, 1, 1)], "doc_id long, quality int, toxic int")
    got = table(quality_rules.judge(docs, labels))
    assert len(got) == 220
    assert sum(got[i].kept for i in range(150)) >= 147 and sum(got[i].kept for i in range(150, 210)) <= 3
    assert all(got[i].base_failed and not got[i].kept for i in range(210, 220))
    alone = table(quality_rules.judge(docs, labels.where("false")))
    assert alone[0].kept and alone[0].score is None


# --- personal data ------------------------------------------------------------


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) < 256 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_patterns_against_plain_expressions():
    rng = random.Random(8)
    parts = [*"a@.+-(1 2 9 .0 @b.co 4111 1111 1111 1111 1.2.3.4 256 +1 (555) 123-4567 x", "4111111111111111", "10.0.0.1", "+1 (555) 123-4567", "me.x@ab.co.uk"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.pattern_spans(text) == plain_spans(text), text
    assert pii.pattern_spans("1" * 50_000 + "." * 10 + "a" * 50_000 + "@") == []


def test_field_makes_repeated_numbers_one_kind(spark):
    rng = random.Random(1)
    texts = []
    for i in range(120):
        number = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        texts.append(f"{prose(i, 12)} call +1 {number} now {prose(i + 500, 10)} year {1900 + i} page {i}.")
    texts.append("call +1 (888) 555-4321 now, " + prose(1, 20) + " again 555-4321 there. In 1999 page 7")
    docs = docs_of(spark, texts + ODD, clash=True)
    got = table(pii.find(docs))
    last = got[120]
    assert last.n_phone == 1 and last.n_added == 1
    begin = texts[120].rindex("555-4321")
    assert f"phone:{begin}:{begin + 8}" in last.spans.split(",")
    assert sum(got[i].n_added for i in range(120)) == 0
    for i, text in enumerate(texts + ODD):
        want = pii.listed(plain_spans(text or ""))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert pii.find(docs_of(spark, [])).count() == 0
    assert pii.redact("a b@c.de f", pii.pattern_spans("a b@c.de f")) == "a <email> f"


def test_field_decides_without_pattern_spans():
    weights = pii.Weights(np.zeros((pii.SHAPES, pii.LABELS)), np.zeros((5, 5)), np.zeros((5, 5)))
    weights.unary[18, 0] = 9.0  # a token with @ is an e-mail address
    bare, beside = "write user@localhost or user@localhost", "at 10.0.0.1 write user@localhost or user@localhost"
    got = [[bare[a:b] for a, _, b in spans] for _, spans in pii.all_spans([bare], weights, pii.Settings())]
    assert got == [["user@localhost"] * 2]
    assert len(pii.all_spans([beside], weights, pii.Settings())[0][1]) == 3
    assert pii.all_spans(["", "no node"], weights, pii.Settings()) == [([], []), ([], [])]


def test_many_repeats_of_a_number_are_one_kind():
    weights = pii.Weights(np.zeros((pii.SHAPES, pii.LABELS)), np.zeros((5, 5)), 5.0 * np.eye(5))
    weights.unary[0, pii.NONE] = 1.0
    for place in (0, 30, 59):
        parts = [f"word{chr(97 + i % 26)} 555-4321 said" for i in range(60)]
        parts[place] = "call +1 (888) 555-4321 said"
        text = " . ".join(parts)
        (base, spans), = pii.all_spans([text], weights, pii.Settings())
        assert len(base) == 1 and len(spans) == 60 and {k for _, k, _ in spans} == {3}
        graph = pii.graph_of(text, base)
        assert len(graph.skip) <= 3 * len(graph.shapes)


def test_loopy_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(2)
    weights = pii.Weights(rng.normal(size=(pii.SHAPES, pii.LABELS)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    weights.chain, weights.skip = weights.chain + weights.chain.T, weights.skip + weights.skip.T
    graph = pii.Graph([[0, 3], [0, 5], [0, 7], [0, 2]], [-1, 2, -1, -1], [(0, 1)] * 4, [(0, 1), (1, 2)], [(0, 3)])
    got = pii.beliefs([graph], weights, pii.Settings(rounds=60))
    want = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        if labels[1] != 2:
            continue
        z = sum(weights.unary[graph.shapes[i], labels[i]].sum() for i in (0, 2, 3))
        z += weights.chain[labels[0], labels[1]] + weights.chain[labels[1], labels[2]] + weights.skip[labels[0], labels[3]]
        for i in range(4):
            want[i, labels[i]] += np.exp(z)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


# --- URL filter ---------------------------------------------------------------


def test_url_filter_against_plain_rules(spark):
    urls = [
        None, "", "no scheme/x", "http://A.Example.com/en/a?x#y", "https://www.example.com/en/a", "http://x.net/es/1",
        "http://net/fr/", "ftp://x.org/p/", "http://x.org/p", "HTTP://X.ORG/p.html#f", "http://y.org/q", "://z", "http://com",
        "http://evilexample.com/en/", "http://notnet/es/", "http://x.net/de/1", "http://x.net/de/1/", "a://b.org/?://", "http://x.net/es/1",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("hash", F.lit(1))
    listed = url_filter.repeated_urls(pages)
    assert {r.url for r in listed.collect()} == {"x.org/p", "x.net/es/1", "x.net/de/1"}
    got = {r.page_id: r for r in url_filter.filter_pages(pages, listed).collect()}
    assert len(got) == len(urls)

    def plain(url):
        if not url or "://" not in url:
            return "", "", None, None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.lower()
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        return host, path, best and best.text, best and best.verdict

    for i, url in enumerate(urls):
        host, path, rule, verdict = plain(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].listed else "allow"))
    assert [got[i].verdict for i in (7, 8, 9, 10)] == ["block", "block", "block", "allow"]


def test_bloom_never_misses_and_stays_bounded(spark):
    entries = spark.range(5000).select(F.xxhash64("id").alias("hash"))
    inside = np.array([r.hash for r in entries.collect()])
    outside = np.array([r.h for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).collect()])
    made = bloom.build(entries, "hash", 5000)
    assert made.passes(inside).all() and made.passes(outside).mean() < 0.02
    small = bloom.build(entries, "hash", 5000, max_blocks=4)
    assert len(small.table) == 4 and small.passes(inside).all()
    pages = spark.createDataFrame([(i, f"u{i % 40}") for i in range(400)] + [(999, None)], "page_id long, url string")
    listed = spark.createDataFrame([(f"u{i}",) for i in range(20)] + [(None,), ("u1",)], "url string")
    for blocks in (1, 1 << 20):
        got = url_filter.listed_urls(pages, listed, max_blocks=blocks).collect()
        assert len(got) == 401 and all(r["_listed"] == (r.url is not None and int(r.url[1:]) < 20) for r in got)


# --- token counts -------------------------------------------------------------


def test_counts_follow_random_edits(vocabulary):
    rng = random.Random(11)
    plain = bpe.PieceEncoder(vocabulary)
    counts = token_counts.PieceCounts(plain)
    letters = [*"ab  \n\t'stre1.!é中", " the", "'re", "\n\n", "   "]

    def some(n):
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))

    for _ in range(250):
        text = some(120) + prose(rng.random(), rng.randint(0, 90)) + some(40)
        counts.learn(set(bpe.pieces_of(text)[1:]))
        edited = token_counts.EditedText(text, counts, leaf=rng.choice([1, 2, 8]))
        for _ in range(8):
            start = rng.randint(0, len(text))
            end = min(len(text), start + rng.choice([0, 0, 1, 3, 30]))
            new = some(6)
            edited.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert edited.text == text
            assert edited.n_tokens == sum(len(x) for x in plain.encode([text]))
    with pytest.raises(IndexError):
        edited.edit(0, len(text) + 1, "")


def test_few_words_are_encoded_again(vocabulary):
    counts = token_counts.PieceCounts(bpe.PieceEncoder(vocabulary))
    text = prose(5, 5000)
    counts.learn(set(bpe.pieces_of(text)[1:]))
    edited = token_counts.EditedText(text, counts)
    edited.edit(20_000, 20_003, "other")
    assert edited.encoded < 12


def test_counts_after_rules(spark, library):
    content = bpe.Bpe(PATH).content()
    texts = [t for t in ODD if t != ODD[-1]] + ["write me@ab.co now!!! or 1234567 \n x", "!!", "me@ab.co"]
    got = table(token_counts.count_after_edits(docs_of(spark, texts, clash=True), content))
    for i, text in enumerate(texts):
        new = text or ""
        assert got[i].n_tokens == len(library.encode(new, add_special_tokens=False).ids)
        edits = 0
        for r in token_counts.RULES:
            new, n = re.subn(r.pattern, r.new, new)
            edits += n
        assert got[i].n_edits == edits
        assert got[i].n_tokens_edited == len(library.encode(new, add_special_tokens=False).ids), text


def test_texts_that_cannot_match_a_rule_are_not_searched(spark):
    """What a rule needs changes no count, and no default rule misses a match by it."""
    everywhere = tuple(token_counts.Rule(r.pattern, r.new) for r in token_counts.RULES)
    texts = ["a@b.co", "a \n", "a\t\n", " \t \n@", "plain 12345 !!", "\n a", None]
    content = bpe.Bpe(PATH).content()
    found = [table(token_counts.count_after_edits(docs_of(spark, texts), content, r)) for r in (everywhere, token_counts.RULES)]
    assert found[0] == found[1]
    assert [found[0][i].n_edits for i in range(7)] == [1, 1, 1, 1, 2, 0, 0]
    missed = (token_counts.Rule("a", "b", ("z",)),)
    assert {r.n_edits for r in token_counts.count_after_edits(docs_of(spark, texts), content, missed).collect()} == {0}


# --- helpers ------------------------------------------------------------------


def test_bounded_sample_is_bounded_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    one, two = ({r.doc_id for r in common.bounded(df, 100, "doc_id").collect()} for _ in range(2))
    assert one == two and 50 < len(one) <= 100


def test_words_walk_along_the_beginnings_of_tokens():
    """Each byte of a word is one step, however many token endings lie behind it."""
    letters = [c for c, _ in sorted(bpe.byte_letters().items(), key=lambda x: x[1])]
    long = ["a" * n for n in (2, 4, 8, 16)]
    names = [*letters, *long, "ab", "aab"]
    content = json.dumps({"model": {
        "vocab": {name: n for n, name in enumerate(names)},
        "merges": [["a", "a"], ["aa", "aa"], ["aaaa", "aaaa"], ["a" * 8, "a" * 8], ["a", "b"], ["a", "ab"]],
    }})
    v = bpe.Vocabulary(content)
    asked = []

    class Steps(dict):
        def get(self, key, default=None):
            asked.append(key)
            return dict.get(self, key, default)

    v._steps = Steps()
    words = [b"a" * n + tail for n in range(1, 40) for tail in (b"", b"b", b"bb", b"ca")]
    for word in words:
        asked.clear()
        v.encode_words({word})
        assert len(asked) == len(word)
        tokens = v._words[word]
        assert b"".join(v.bytes_of[t] for t in tokens) == word
        assert all(v.fits(a, b) for a, b in zip(tokens, tokens[1:]))
