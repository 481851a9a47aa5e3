"""The stages in turn, each held against what brute force says of its own input."""

import corpus_pipeline as P
from helpers import near_copy, rng, words

from glossa.llm.mixing import quotas, sized
from test_jaccard import brute


def write(spark, folder, n=240):
    rnd, rows, labels = rng(7), [], []
    base = [" ".join(words(rnd, 60, 3000)) for _ in range(n)]
    for i in range(n):
        text = base[i] if i % 4 else near_copy(rnd, base[i // 8], 0.03)
        if i % 5 == 2:
            text += " " + " ".join(rnd.choice(["scum", "idiot", "moron"]) for _ in range(3))
        rows.append((i, text, "en", rnd.choice(["a", "b", "b"]), len(text)))
        labels.append((i, 0, int(i % 5 == 2)))
    rows.append((999, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    clean = P.drop_toxic(spark, docs, folder)
    ids = {r["doc_id"] for r in clean.collect()}
    toxic = {i for i, t, *_ in rows if t and any(w in t.split() for w in ("scum", "idiot", "moron"))}
    assert clean.columns == names and ids == {i for i, *_ in rows} - toxic
    single = P.drop_near_duplicates(spark, clean, folder)
    groups = brute([(i, t) for i, t, *_ in rows if i in ids], 0.55)
    kept = {r["doc_id"] for r in single.collect()}
    assert single.columns == names and kept == {k for k, (c, *_) in groups.items() if c == k}
    mixed = P.mix_sources(spark, single, folder)
    taken = sum(r["mix_taken"] for r in quotas(sized(single)).collect())
    assert mixed.columns == names and sum(len(r["text"].split()) for r in mixed.collect()) == taken
    packed = P.pack_sequences(spark, mixed, folder)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    whole = P.run(spark, folder)
    key = lambda r: tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32"))
    assert sum(r["length"] for r in whole.collect()) == sum(r["length"] for r in packed.collect())
    assert {r["doc_id"] for r in whole.collect()} <= kept and key(whole.first())


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
