import random

import corpus_pipeline
from quern.llm.op08_simhash import simhash


def test_stages(spark, tmp_path):
    r = random.Random(0)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(600)]
    line = lambda: " ".join(r.choice(words) for _ in range(25)) + "."
    texts = ["\n".join(line() for _ in range(5)) for _ in range(150)]
    shared = line()
    texts += [texts[0], texts[1].replace(texts[1].split()[3], "other", 1), texts[2] + "\n" + shared, texts[3] + "\n" + shared]
    texts += [" ".join(w.upper() + "!!" for w in line().split()) + "\n" + line().upper() for _ in range(60)] + ["", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 154 <= i < 214 else 1, 0) for i in range(214)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.collect())
    good, cut, unlike, mixed, packed = kept
    ids = {x.doc_id for x in good}
    assert set(range(154)) <= ids and not ids & set(range(154, 214))
    by = {x.doc_id: x for x in cut}
    assert len(cut) == len(good) and by[0].text == texts[0] and by[150].text == "" and by[152].text == shared and by[153].text == "" and by[152].n_chars == len(shared)
    left = [simhash((x.text or "").encode()) for x in unlike]
    assert all(bin(a ^ b).count("1") > 3 for i, a in enumerate(left) for b in left[:i]) and by.keys() >= {x.doc_id for x in unlike}
    assert {x.doc_id for x in mixed} <= {x.doc_id for x in unlike if x.text}
    at = {}
    for x in sorted(packed, key=lambda x: (x.sequence_id, x.offset)):
        assert at.get(x.sequence_id, 0) == x.offset
        at[x.sequence_id] = x.offset + x.length
    assert max(at.values()) <= 1024 and sum(1 for x in packed if x.start == 0) == len(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
