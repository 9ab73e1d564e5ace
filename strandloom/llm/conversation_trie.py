"""Trie of conversations that share their first turns, found by digests of blocks of turns.

A turn is known by two hashes of its role, text and place, and a run of turns by the
exclusive or of these.  Blocks of ``BLOCK`` turns are grouped first, by the digest of
everything before them: where all conversations that reach a block go through it alike, one
of them stands for all and its turns become nodes as they are.  Turn boundaries are looked
at, for every conversation, only inside blocks where siblings diverge.

The smallest member of a node owns it, so the nodes a conversation owns are the end of its
path.  A sum over a subtree is then the sum, over the members of the node, of what each of
them owns, less what the node's own conversation owns above it: one grouped sum, with no
pairs of nodes and ancestors.

Only hashes and word counts are shuffled.  Where a conversation has more than ``LONG`` turns,
running values are taken within spans and over spans, so no task needs a whole conversation.
Else one task can hold all of a family, and numbering, rebuilding and running values take
one exchange each instead of a chain of joins.  Joins split hot keys.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import map_batches, to_unique
from strandloom.staging import dense_ids, stage, with_bound

BLOCK = 4
SPAN = 256  # places of a conversation that one window runs over
LONG = 10_000  # turns of a conversation up to which one task takes it whole
CHUNK = 1024  # range of conversation ids that are listed in one string
HEADS = 4  # a conversation takes fewer turns than this from another
FAMILY = 20  # conversations that take their first turns from the same one
_NODE = ["depth", "q1", "q2"]
_GROUP = ["k", "p1", "p2"]


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _before(rows: DataFrame, key: str, place: str, values: dict[str, str], aggregate, combine, long: bool = True) -> DataFrame:
    """Add, per new name, the aggregate of a column over the rows of ``key`` at earlier places."""
    if not long:
        ahead = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({n: F.coalesce(aggregate(c).over(ahead), F.lit(0).cast("long")) for n, c in values.items()})
    rows = rows.withColumn("_s", F.floor(F.col(place) / SPAN))
    spans = rows.groupBy(key, "_s").agg(*[aggregate(c).alias(f"_{new}") for new, c in values.items()])
    earlier = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = spans.select(key, "_s", *[F.coalesce(aggregate(f"_{n}").over(earlier), zero).alias(f"_{n}") for n in values])
    inside = Window.partitionBy(key, "_s").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(spans, [key, "_s"])
    return out.select(
        *[c for c in rows.columns if c != "_s"],
        *[combine(F.col(f"_{n}"), F.coalesce(aggregate(c).over(inside), zero)).alias(n) for n, c in values.items()],
    )


def _hashed(conversations: DataFrame) -> DataFrame:
    """Turns of conversations with an id: c, turn, role, hashes a and b, and words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").alias("c"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit(1), role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def has_long(conversations: DataFrame) -> bool:
    """Whether a conversation has too many turns for one task."""
    sizes = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) > LONG


def _heads(c: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(c.cast("string")) % HEADS


def _base(c: Column) -> Column:
    return c - c % FAMILY


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """c, place (from 0), hashes a and b, and words of every turn of a conversation with an id.

    Turns are ordered by turn (null first); ties by role, then by hash.
    """
    turns = dense_ids(_hashed(conversations), ["c", "turn", "role", "a", "b"], "id", "turns")
    first = turns.groupBy("c").agg(F.min("id").alias("first"))
    placed = to_unique(turns, first, ["c"])
    return placed.select("c", (F.col("id") - F.col("first")).alias("place"), "a", "b", "words")


def rebuilt_families(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``rebuilt`` makes of ``numbered_turns``, for conversations that are not long.

    The few conversations of a family meet in one task, so its first one hands its turns on there.
    """
    rows = _hashed(conversations).withColumn("base", _base(F.col("c"))).repartition("base")
    own = Window.partitionBy("base", "c")
    family = Window.partitionBy("base")
    is_base = F.col("c") == F.col("base")
    rows = rows.select(
        "c",
        (F.row_number().over(own.orderBy("turn", "role", "a", "b")) - 1).cast("long").alias("place"),
        "a",
        "b",
        "words",
        F.count("*").over(own).alias("n"),
        F.count_if(is_base).over(family).alias("nb"),
        F.collect_set("c").over(family).alias("members"),
        is_base.alias("is_base"),
    )
    lends = F.col("is_base") & (F.col("place") < HEADS)
    rows = stage(rows.withColumn("members", F.when(lends, F.col("members"))), "families")
    rows = rows.withColumn("h", _heads(F.col("c"))).withColumn("taken", F.least("h", "nb"))
    kept = rows.where("place >= h").select("c", (F.col("place") - F.col("h") + F.col("taken")).alias("p"), "a", "b", "words")
    lent = rows.where("members is not null").select(F.explode("members").alias("c"), F.col("place").alias("p"), "a", "b", "words")
    lent = lent.where(F.col("p") < _heads(F.col("c")))
    return _placed(kept.unionByName(lent)), rows.where("place = 0").select("c", _new_size().alias("n"))


def _placed(turns: DataFrame) -> DataFrame:
    return turns.select("c", "p", F.xxhash64("p", "a", "b").alias("x1"), F.xxhash64("b", "p", "a").alias("x2"), "words")


def _new_size() -> Column:
    return F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each took its first turns from the first of its family.

    ``turns`` are numbered.  The result has a turn's place ``p`` and place-bound hashes; the
    conversations have their new number of turns in ``n``.
    """
    sizes = turns.groupBy("c").agg(F.count("*").alias("n"))
    convs = sizes.select("c", "n", _heads(F.col("c")).alias("h"), _base(F.col("c")).alias("base"))
    heads = sizes.select(F.col("c").alias("base"), F.col("n").alias("nb"))
    taken = F.least(F.col("h"), F.coalesce(F.col("nb"), F.lit(0)))
    convs = stage(convs.join(heads, "base", "left").select("c", "base", "n", "h", taken.alias("taken")), "conversations")
    own = to_unique(turns, convs, ["c"]).where("place >= h")
    lent = turns.where(F.col("place") < HEADS).withColumnRenamed("c", "base").join(convs, "base").where("place < taken")
    out = own.select("c", (F.col("place") - F.col("h") + F.col("taken")).alias("p"), "a", "b", "words").unionByName(
        lent.select("c", F.col("place").alias("p"), "a", "b", "words")
    )
    return _placed(out), convs.select("c", _new_size().alias("n"))


def block_groups(turns: DataFrame, long: bool = True) -> tuple[DataFrame, DataFrame]:
    """(blocks, groups): blocks of every conversation, and groups of those that follow the same turns."""
    turns = turns if long else turns.repartition("c")
    blocks = turns.groupBy("c", F.floor(F.col("p") / BLOCK).alias("k")).agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.count("*").alias("m")
    )
    blocks = stage(_before(blocks, "c", "k", {"p1": "x1", "p2": "x2"}, F.bit_xor, _xor, long), "blocks")
    alike = [F.min(c) == F.max(c) for c in ("x1", "x2", "m")]
    groups = blocks.groupBy(*_GROUP).agg(
        F.count("*").alias("weight"), F.min("c").alias("least"), (~(alike[0] & alike[1] & alike[2])).alias("split")
    )
    return blocks, stage(groups, "groups")


def refined(turns: DataFrame, blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Turns that make nodes: all inside blocks that split, those of one conversation elsewhere.

    q1 and q2 tell the turns up to and with this one, o1 and o2 those before it.
    """
    stands = to_unique(with_bound(blocks.drop("x1", "x2", "m"), blocks._row_bound), groups, _GROUP).where("split or c = least")
    stands = stands.withColumn("weight", F.when(F.col("split"), 1).otherwise(F.col("weight"))).drop("least")
    inside = Window.partitionBy("c", "k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("k", F.floor(F.col("p") / BLOCK)).join(stands, ["c", "k"])
    q1, q2 = (_xor(F.col(f"p{i}"), F.bit_xor(f"x{i}").over(inside)) for i in "12")
    rows = rows.select(
        "c", *_GROUP, "split", "weight", (F.col("p") + 1).alias("depth"), q1.alias("q1"), q2.alias("q2"), "x1", "x2", "words"
    )
    return rows.withColumn("o1", _xor(F.col("q1"), F.col("x1"))).withColumn("o2", _xor(F.col("q2"), F.col("x2"))).drop("x1", "x2")


def listed_ends(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """Node and SHA-256 of the sorted ids of the conversations that end there.

    Ids are listed in chunks, by ranges of ids; one task hashes the chunks of a node one after
    the other, as that hash has to be taken in order.
    """
    last = convs.where("n > 0").withColumn("k", F.floor((F.col("n") - 1) / BLOCK))
    ends = last.join(blocks, ["c", "k"]).select(
        F.col("n").alias("depth"), _xor(F.col("p1"), F.col("x1")).alias("q1"), _xor(F.col("p2"), F.col("x2")).alias("q2"), "c"
    )
    zero = F.lit(0).cast("long")
    ends = ends.unionByName(convs.where("n = 0").select(F.col("n").alias("depth"), zero.alias("q1"), zero.alias("q2"), "c"))
    ids = ends.withColumn("part", F.col("c") - F.pmod(F.col("c"), F.lit(CHUNK)))
    names = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")))
    chunks = ids.groupBy(*_NODE, "part").agg(names.alias("names"))
    ordered = chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "part")

    def start():
        key, digest = None, None

        def step(batch: pa.RecordBatch | None) -> dict | None:
            nonlocal key, digest
            done = []
            for *own, names in zip(*[batch.column(c).to_pylist() for c in (*_NODE, "names")]) if batch else ():
                if own == key:
                    digest.update(b",")
                else:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                digest.update(names.encode())
            if batch is None and key:
                done.append((*key, digest.hexdigest()))
            return dict(zip((*_NODE, "ends_sha256"), map(list, zip(*done)))) if done else None

        return step

    return map_batches(ordered.select(*_NODE, "names"), "depth long, q1 long, q2 long, ends_sha256 string", start, finish=True)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Null roles and texts are empty; turns are ordered by turn, null first, ties by role and
    then by hash, so that equal rows stay two turns.  Rows without conv_id belong to no
    conversation.  Texts are hashed whole.  Columns beyond the four read are ignored.  An
    empty table has no root and gives no rows.
    """
    long = has_long(conversations)
    if long:
        turns, convs = rebuilt(stage(numbered_turns(conversations), "numbered"))
        turns, convs = stage(turns, "rebuilt"), stage(convs, "lengths")
    else:
        turns, convs = rebuilt_families(conversations)
    blocks, groups = block_groups(turns, long)
    picked = stage(refined(turns, blocks, groups), "picked")
    # The sums below a node are those of its members: of its block's group unless that splits.
    nodes = stage(
        picked.groupBy(*_NODE, "o1", "o2").agg(
            F.sum("weight").alias("n_convs"),
            F.min("c").alias("conv_id"),
            F.min("words").alias("words"),
            F.bool_and("split").alias("split"),
            *[F.min(c).alias(c) for c in _GROUP],
        ),
        "nodes",
    )
    above = [(F.col("depth") - 1).alias("depth"), F.col("o1").alias("q1"), F.col("o2").alias("q2")]
    known = [c for c in nodes.columns if c not in _NODE]
    child = nodes.select(*above, *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in known], F.lit(1).alias("child"))
    nodes = nodes.withColumn("child", F.lit(0)).unionByName(child).groupBy(*_NODE)
    nodes = nodes.agg(*[F.max(c).alias(c) for c in known], F.sum("child").alias("n_children")).where("conv_id is not null")
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("words")

    # What each conversation owns, and the sum of that over the members of every node.
    nodes = stage(nodes, "nodes-counted") if long else nodes  # read twice
    nodes = _before(nodes, "conv_id", "depth", {"over": "saved"}, F.sum, lambda a, b: a + b, long)
    nodes = stage(nodes, "nodes-with-children")
    owned = nodes.groupBy(F.col("conv_id").alias("c")).agg(
        F.sum("saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    owned = stage(owned, "owned")
    whole = blocks.join(groups.where("not split").select(*_GROUP), _GROUP, "left_semi").select("c", F.lit(False).alias("split"), *_GROUP)
    turnwise = picked.where("split").select("c", "split", *[F.col(a).alias(b) for a, b in zip(_NODE, _GROUP)])
    parts = with_bound(turnwise.unionByName(whole), picked._row_bound + blocks._row_bound)
    sums = to_unique(parts, owned, ["c"]).groupBy("split", *_GROUP)
    sums = sums.agg(F.sum("saved").alias("all_saved"), F.sum("leaves").alias("n_leaves"))
    key = [F.when(F.col("split"), F.col(a)).otherwise(F.col(b)).alias(b) for a, b in zip(_NODE, _GROUP)]
    nodes = nodes.select(*[c for c in nodes.columns if c not in _GROUP], *key).join(sums, ["split", *_GROUP])
    nodes = nodes.withColumn("saved_tokens", F.col("all_saved") - F.col("over"))

    total = owned.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).first()
    tops = nodes.where("depth = 1").agg(F.count("*").alias("n_children"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0").join(F.broadcast(tops))
    zero = F.lit(0).cast("long")
    root = root.select(
        *[zero.alias(c) for c in (*_NODE, "o1", "o2")],
        "conv_id",
        "n_convs",
        "n_children",
        F.lit(1 if total.leaves is None else total.leaves).cast("long").alias("n_leaves"),
        F.lit(total.saved or 0).cast("long").alias("saved_tokens"),
    )
    nodes = stage(nodes.select(*root.columns).unionByName(root), "subtrees")
    parents = nodes.select(
        F.col("depth").alias("pd"), F.col("q1").alias("o1"), F.col("q2").alias("o2"), F.col("conv_id").alias("parent_conv_id")
    )
    nodes = with_bound(nodes.withColumn("pd", F.col("depth") - 1), nodes._row_bound)
    nodes = to_unique(nodes, parents, ["pd", "o1", "o2"], "left_outer")
    return nodes.join(listed_ends(blocks, convs), _NODE, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
