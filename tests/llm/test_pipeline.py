import random

import corpus_pipeline
from tests.llm.test_text import closure, sets_of


def test_pipeline_keeps_and_changes_what_it_should(spark, tmp_path):
    r = random.Random(3)
    words = [f"wort{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(300):
        w = [r.choice(words) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            w[r.randrange(60)] = "grusel" + r.choice("abcdef")
        if i % 10 == 3:
            w[5] = "bob.jones@mail1.example.com"
        if 250 <= i and not bad:
            w = rows[i - 249][1].split()
            w[-1] = "anders"
        rows.append((i, " ".join(w), "en", "ab"[i % 2], 0))
        labels.append((i, int("grusel" in rows[-1][1]), 1))
    rows.append((900, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen[name] = kept.collect()
    clean = {i: t for i, t, *_ in rows if not t or "grusel" not in t}
    first = {x.doc_id for x in seen["toxicity"]}
    assert len(first ^ set(clean)) <= 3
    left = {x.doc_id: x.text for x in seen["toxicity"]}
    assert {x.doc_id for x in seen["ngram_jaccard_join"]} == set(closure(sets_of(left, 5), 80).values())
    assert not any("bob.jones" in (x.text or "") for x in seen["pii"])
    before = {x.doc_id: x.text for x in seen["ngram_jaccard_join"]}
    assert all(x.text == before[x.doc_id] for x in seen["pii"] if x.text and "@" not in x.text)
    assert all((x.n_chars or 0) == len(x.text or "") for x in seen["mixing"])
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert len(last) == len(seen["mixing"]) and all(x.parity and x.round_trip for x in last)
