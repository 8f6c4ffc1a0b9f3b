"""The pipeline's stages against plain versions on a small corpus."""

import random

import corpus_pipeline
from tests.llm.test_operators import _linked, _shuffled
from tidemark.llm import parity_join
from tidemark.llm.common import shingle_hashes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _corpus(spark, folder, extra=""):
    draw = random.Random(21)
    english, french = [f"{a}{b}" for a in ("the", "and", "ing", "ter") for b in ("ea", "ou", "st", "an", "er")], [f"{a}{b}" for a in ("qui", "eau", "ré", "mon") for b in ("ez", "aix", "elle", "é", "on")]
    docs, labels = [], []
    for i in range(240):
        words = [draw.choice(french if i % 4 == 0 else english) for _ in range(draw.randint(40, 90))]
        if i % 6 == 1:
            words[draw.randrange(20)] = "vilest"
        if i % 6 == 2:
            words = [w + "###" for w in words]
        text = " ".join(words)
        if i % 6 == 3 and i > 6:
            text = docs[i - 3][1].replace(" ", "  ", 2) if docs[i - 3][1] else text
        if i % 10 == 5:
            text += ' password: "hunter2hunter2"'
        docs.append((i, text, "fr" if i % 4 == 0 else "en", "s", len(text)))
        labels.append((i, 0 if i % 6 == 2 else 1, 1 if i % 6 == 1 else 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "12345 67890 !!!", None, "s", 15), (None, " ".join(english * 3), "en", "s", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels[:160], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {d[0]: d for d in docs}


def test_stages(spark, tmp_path):
    source = _corpus(spark, tmp_path)
    frames, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        frames.append(docs)
    good, known, distinct, clean, packed = frames
    assert all(df.columns == COLUMNS for df in frames[:4])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in frames]
    assert not any(i is not None and i < 240 and i % 6 in (1, 2) for i in ids[0]) and not ids[0] & {900, 901}
    assert sum(1 for i in ids[0] if i is not None and i < 240) > 0.9 * sum(1 for i in range(240) if i % 6 not in (1, 2))
    assert 902 not in ids[1] and ids[0] - ids[1] <= {902} and None in ids[1]
    texts = {r.doc_id: r.text for r in known.collect() if r.doc_id is not None}
    linked = _linked(texts, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY)
    assert ids[2] == {i for i, (_, c) in linked.items() if c == i} | {None} and len(ids[2]) < len(ids[1])
    assert ids[3] == ids[2] and not any("hunter2" in r.text for r in clean.collect()) and all(r.n_chars == len(r.text) for r in clean.collect() if r.n_chars is not None)
    assert all(r.text == source[r.doc_id][1] for r in clean.collect() if r.doc_id is not None and r.doc_id % 10 != 5)
    assert {r.doc_id for r in packed.collect()} == ids[3]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in rows) == sum(r.length for r in packed.collect()) and len({(r.doc_id, r.start) for r in rows}) == len(rows)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_bands_hold_every_linked_pair():
    bands = parity_join.Bands(85)
    for a in range(1, 3000):
        b = a * 100 // 85
        assert bands.of(b) - bands.of(a) in (0, 1)
        assert bands.parts(bands.of(a)) > bands.difference(bands.of(a)) >= (15 * (a + b)) // 185 - 1


def test_near_duplicates_shuffle_few_bytes_for_a_key(spark, tmp_path):
    """Before, this stage shuffled each part key as a row of sixteen bytes and more, twice where many buckets are shared."""
    draw, bands = random.Random(22), parity_join.Bands(corpus_pipeline.SIMILARITY)
    texts = [" ".join(f"w{draw.randrange(10**9)}" for _ in range(3_000)) for _ in range(60)]
    texts += [f"{texts[0]} and more", texts[1]]
    n = sum(len(parity_join.part_keys(shingle_hashes(t, corpus_pipeline.SHINGLE_WORDS), bands)) for t in texts)
    docs, before = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"), _shuffled(spark)
    assert {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, str(tmp_path)).collect()} == set(range(60))
    assert n > 80_000 and _shuffled(spark) - before < 9 * n


def test_pairs_are_verified_with_a_broadcast_and_without(spark, monkeypatch):
    """Nodes are not shuffled for few pairs; the links are the same, also of a leader that is copied for salts."""
    draw = random.Random(23)
    base = [f"w{draw.randrange(10**9)}" for _ in range(120)]
    texts = [" ".join([*base[:-1], f"z{i}"]) for i in range(12)] + [" ".join(f"w{draw.randrange(10**9)}" for _ in range(50)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(parity_join, "SALT_PAIRS", 3)
    found = []
    for most in (1_000_000, 0):
        monkeypatch.setattr(parity_join, "BROADCAST_IDS", most)
        found.append({r.doc_id: r.component_id for r in parity_join.link(docs, 5, 80).collect()})
    assert found[0] == found[1] == {i: 0 if i < 12 else i for i in range(17)}


def test_rows_are_dropped_by_their_own_group(spark, tmp_path):
    long = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, long("a")), (2, long("a")), (2, long("b")), (3, long("c")), (3, long("c")), (4, None), (4, None), (None, long("a")), (5, long("b") + " z")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.distinct_documents(spark, docs, str(tmp_path))
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == COLUMNS and found == sorted([(1, long("a")), (2, long("b")), (3, long("c")), (4, None), (4, None), (None, long("a"))], key=str)
