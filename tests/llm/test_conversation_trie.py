import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strandloom.llm import conversation_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NAMES = ("c", "k", "p", "h", "place", "q1", "q2", "depth", "n_convs", "words", "saved", "_s", "id", "_part", "_row", "n")
STAGES = 90


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in NAMES}).repartition(3)


def plain(rows):
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append(((turn is not None, turn or 0), role or "", text or ""))
    given = {c: [t[1:] for t in sorted(turns)] for c, turns in given.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = given.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(below[x][0] for x in children[node]) if children[node] else 1
        saved = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below[node] = leaves, saved + sum(below[x][1] for x in children[node])
    for node, convs in members.items():
        listed = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(convs), len(node), parent, len(convs), len(children[node]), *below[node], hashlib.sha256(listed.encode()).hexdigest())
        )
    return sorted(out, key=lambda r: (r[1], r[0]))


def check(spark, rows):
    out = T.trie(table(spark, rows))
    assert out.columns == COLUMNS
    got = sorted(map(tuple, out.collect()), key=lambda r: (r[1], r[0]))
    assert got == plain(rows)
    return got


def conversations(seed, count=60, longest=12):
    """Conversations that often follow another one for a while."""
    rng, seqs, rows = random.Random(seed), [], []
    for c in rng.sample(range(4 * count), count):
        seq = list(rng.choice(seqs))[: rng.randrange(longest)] if seqs and rng.random() < 0.7 else []
        while len(seq) < rng.randrange(1, longest):
            seq.append((rng.choice(["user", "assistant"]), " ".join(rng.choices(["a", "b c", "d\te"], k=rng.randrange(3)))))
        seqs.append(seq)
        rows += [(c, t, *turn) for t, turn in enumerate(seq)]
    rng.shuffle(rows)
    return rows


def test_equals_a_plain_trie(spark):
    check(spark, conversations(1, 150))


def test_long_conversations_over_several_spans(spark, monkeypatch):
    monkeypatch.setattr(T, "SPAN", 3)
    monkeypatch.setattr(T, "CHUNK", 2)
    rows = [(c, t, "user", f"turn {min(t, 40 + c // 3)}") for c in range(20, 32) for t in range(30 + 5 * (c % 4))]
    check(spark, rows)


def test_common_first_turn_and_copies(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 8)
    rows = [(c, t, "user", "hello there" if t < 2 else f"copy {t}" if c % 2 else f"{c} {t}") for c in range(300) for t in range(5)]
    got = check(spark, rows)
    assert got[0][3] == 300


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody"),
        (0, None, "user", "first"),
        (0, 1, None, None),
        (0, 1, "user", "tie"),
        (0, 1, "user", "tie"),
        (1, 0, "user", ""),
        (1, 1, "", "x"),
        (45, 0, "user", "base is absent"),
        (46, 5, "user", " \t "),
        (47, None, None, None),
    ]
    check(spark, rows)
    assert T.trie(table(spark, [])).collect() == []
    assert T.trie(table(spark, [(None, 1, "user", "x")])).collect() == []


def test_only_turnless_conversations(spark):
    """Conversations whose own turns are all skipped and that find no one to take turns from."""
    ids = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "gone") for c in ids]
    got = check(spark, rows)
    assert got == [(ids[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_blocks_that_do_not_split_are_not_refined(spark):
    """Copies of one conversation are looked at turn by turn once, not for each copy."""
    rows = [(1000 + 20 * c, t, "user", f"turn {t}") for c in range(50) for t in range(8)]
    numbered = T.stage(T.numbered_turns(table(spark, rows)), "numbered")
    turns, _ = T.rebuilt(numbered)
    turns = T.stage(turns, "rebuilt")
    assert T.refined(turns, *T.block_groups(turns)).count() == 8


def test_long_conversations_are_spread(spark, monkeypatch):
    """The way without a task per family gives the same rows."""
    monkeypatch.setattr(T, "LONG", 3)
    rows = conversations(5) + [(c, t, "user", f"turn {t}") for c in (9_980, 9_987, 10_000, 10_003) for t in range(5)]
    assert T.has_long(table(spark, rows))
    check(spark, rows)
    monkeypatch.setattr(T, "LONG", 100)
    assert not T.has_long(table(spark, rows))
    check(spark, rows)


def test_few_stages_for_short_conversations(spark):
    """Every exchange costs a task per partition, however small the table."""
    df = table(spark, conversations(3))
    context = spark.sparkContext
    context.setJobGroup("trie", "trie")
    try:
        T.trie(df).collect()
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("trie")]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = {k for j in jobs for k in j.stageIds}
    assert 10 < len(stages) < STAGES
