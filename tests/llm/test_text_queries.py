"""The registered text queries on the given tables, and the pipeline on planted cases."""

import hashlib
import os

import public_tokenizers
import pytest
from test_text_operators import PATH, docs_of, plain_components, plain_fingerprint, plain_hits, plain_spans, plain_statistics, prose
from tokenizers import Tokenizer

import corpus_pipeline
from strandloom.llm import line_dedup
from strandloom.llm.catalog import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    from compare import database

    return database(SF_DIR)


@given
@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, con, name):
    from compare import difference, types

    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0
    assert difference(df, con, SQL[name]) == ""
    assert types(df, con, SQL[name]) == {}


@given
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n != "op11_embedding_whitening"])
def test_query_covers_its_table(spark, name):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES[name](spark, SF_DIR).collect()}
    assert sorted(got) == sorted(docs)
    if name.startswith("op2_"):
        ids = sorted(docs)
        prints = [plain_fingerprint(docs[i]) for i in ids]
        assert [int(got[i].fingerprint, 16) for i in ids] == prints
        assert [got[i].component_id for i in ids] == [ids[c] for c in plain_components(prints)]
    if name.startswith("op3_"):
        for i, text in docs.items():
            if len(text) < 5000:
                base = plain_statistics(text)
                assert [got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == base
                assert got[i].base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
                assert not (got[i].base_failed and got[i].kept)
    if name.startswith("op4_"):
        for i, text in docs.items():
            spans = plain_spans(text)
            listed = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)
            assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert [got[i][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(x[1] == k for x in spans) for k in range(4)]


def write_tables(spark, folder, texts, items, labels):
    docs_of(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_on_planted_cases(spark, tmp_path):
    clean = [prose(i, 150) for i in range(300)]
    junk = [" ".join(f"{w.upper()}!!%%" for w in prose(1000 + i, 150).split()) for i in range(10)]
    copies = [clean[3], clean[3], clean[7]]
    # Every sentence changed a little: no common lines, but nearly the same shingles.
    near = [" ".join(w if k % 40 else "mira" for k, w in enumerate(clean[i].split())) for i in (20, 21)]
    items = [(i, prose(5000 + i, 20)) for i in range(4)]
    leaks = [f"{prose(2000 + i, 70)} {items[i][1]} {prose(3000 + i, 70)}" for i in range(4)]
    passage = prose(9000, 80)
    sharing = [f"{prose(6000 + i, 70)}\n{passage}\n{prose(7000 + i, 70)}" for i in range(5)]
    texts = clean + junk + copies + near + leaks + sharing
    at = {"junk": 300, "copies": 310, "near": 313, "leaks": 315, "sharing": 319}
    write_tables(spark, tmp_path, texts, items, [(i, 1, 0) for i in range(0, 300)] + [(305, 0, 0)])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding",
    ]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{len(kept)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    first = set(kept[0])
    assert not first & set(range(at["junk"], at["copies"]))
    assert len(first & set(range(300))) >= 297
    # Copies are gone after the lines are; what others share stays in its first document.
    assert not set(kept[1]) & set(range(at["copies"], at["near"]))
    holders = [i for i, text in kept[1].items() if passage[:60] in text]
    assert holders == [at["sharing"]]
    lines = {x.strip() for t in kept[1].values() for x in line_dedup.lines_of(t)}
    assert {x.strip() for i in first for x in line_dedup.lines_of(texts[i])} == lines
    ids = sorted(kept[1])
    roots = plain_components([plain_fingerprint(kept[1][i]) for i in ids])
    assert sorted(kept[2]) == [ids[r] for r in sorted(set(roots))]
    assert sorted(kept[3]) == [i for i in sorted(kept[2]) if not plain_hits(kept[2][i], items)[1]]
    assert not set(kept[3]) & set(range(at["leaks"], at["sharing"]))
    made = Tokenizer.from_file(PATH)
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(final) == sorted(kept[3])
    for i, text in kept[3].items():
        ids = made.encode(text, add_special_tokens=False).ids
        assert final[i].n_tokens == len(ids)
        assert final[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert final[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_on_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_vocabulary_is_not_copied_here():
    assert not public_tokenizers.path("byte_bpe_50k.json").startswith(os.path.dirname(corpus_pipeline.__file__))
